"""Decisions must not get lost."""

import pytest

from assaykit.operators import review


def test_changes_that_are_not_made_are_refused():
    for changes in ({"question": "Why?"}, {"display": "5"}, {"evidence": []}, {"value_num": "much"}, {"unit": None}):
        with pytest.raises(review.ReviewError):
            review.check_decision("modify", "me", changes)
    assert review.check_decision("modify", "me", {"value_num": 5, "unit": "mg"}) == "modify"
