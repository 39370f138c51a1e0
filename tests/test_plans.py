"""Plans that samples take at size."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from assaykit.operators import mine
from assaykit.plans import render


def test_no_filter_repeats_the_prose_rules(spark):
    """Candidates that are no results are left out by their column; no filter stands below the rules with all of them in its condition."""
    rows = spark.createDataFrame([(1, 7, 1, 5.0), (2, 8, 2, 6.0)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    docs = render.order_documents(rows)
    found = mine.candidates(docs, "result_focused")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "ambient" in plan  # a word of the rules
    assert not [line for line in re.split(r"\n(?=[ :]*[+:]- )", plan) if re.match(r"[ :+-]*Filter ", line) and "ambient" in line]
    want = mine.candidates(docs, "full").select("id", "core").collect()
    assert sorted(r.id for r in found.select("id").collect()) == sorted(r.id for r in want if r.core)


def test_only_rows_whose_verdict_holds(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "n int, ok boolean")
    kept = mine._only(rows.withColumn("m", F.col("n") + 1), "ok")
    assert kept.columns == ["n", "ok", "m"] and sorted(r.n for r in kept.collect()) == [1, 4]
