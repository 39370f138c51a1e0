"""Values, texts and prose against literals."""

import pytest
from pyspark.sql import functions as F

from assaykit.functions import prose, text as tx, units
from assaykit.operators import mine, review
from assaykit.operators.verify import ReplayError, arithmetic
from assaykit.sources import figures, formats, layout, remote


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


TEXTS = ["IC50 was 12.5 ± 0.3 μM", "Figure 9C and ImageJ 1.54g", "85 % at 37 C under 2 kPa for 3 day", "α5 uM é7 mg x 3 mg/mL, 4 mg/mL²", "", "1.25e-5 M and 2M and -3 mL", "12 µM 5ug/mL.", None]


def test_spans_agree_with_python(spark):
    got = column(spark, TEXTS, units.spans)
    for t, rows in zip(TEXTS, got, strict=True):
        want = units.find_spans(t) if t is not None else []
        assert [tuple(r) for r in rows] == want
        assert all(t[s:e].strip() for s, e, *_ in want)


def test_every_unit_parses_to_itself(spark):
    assert len(units.REGISTRY) == 58
    got = column(spark, [f"2 {u}" for u in units.REGISTRY], units.number_unit)
    assert [(r.value, r.unit) for r in got] == [(2.0, u) for u in units.REGISTRY]
    assert column(spark, ["5 parsec", "five mg", "1 2", None], units.number_unit) == [None] * 4


@pytest.mark.parametrize(("value", "unit", "target", "want"), [(250, "nM", "uM", 0.25), (2, "μm", "m", 2e-6), (37, "°C", "K", 310.15), (310.15, "K", "C", 37.0), (1, "J", "eV", None), (1, "mg", "s", None)])
def test_convert(spark, value, unit, target, want):
    got = spark.range(1).select(units.convert(F.lit(float(value)), F.lit(unit), F.lit(target))).first()[0]
    assert got == (None if want is None else pytest.approx(want))
    if want is None:
        with pytest.raises(units.UnitError):
            units.convert_value(value, unit, target)
    else:
        assert units.convert_value(value, unit, target) == pytest.approx(want)


def test_float_text(spark):
    values = [1.25e-05, 12345678.0, 0.1, 1e16, 1e-300, 0.0001, 1e22, -2.5e-07, 123456789.125, 0.0, 7.6, 0.00025]
    assert column(spark, values, tx.float_text, "double") == [repr(v) for v in values]


def test_relations(spark):
    got = column(spark, ["The drug was significantly increased in cells.", "Alpha showed higher mean values than B", "the increased x", "nothing here"], tx.relation)
    assert tuple(got[0]) == ("increased", "The drug", "in cells") and got[1].value == "higher" and got[1].object == "B" and got[2] is None and got[3] is None


def test_licenses(spark):
    texts = ["Creative Commons Attribution License", "CC BY-NC-SA 4.0", "cc0", "Creative Commons Attribution-ShareAlike", "all rights reserved"]
    assert column(spark, texts, tx.license_label) == ["CC-BY-4.0", "CC-BY-NC-SA", "public-domain", "CC-BY-SA-4.0", "unknown"] == [formats.license_of(t) for t in texts]


def bound(spark, *cases):
    """What :func:`prose.interpret` says of (text, display, unit), each."""
    rows = [(k, t, "p1", t.index(d), t.index(d) + len(d), u) for k, (t, d, u) in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, text string, id string, start int, end int, unit string")
    df = df.select("n", "text", "id", F.struct("start", "end", "unit").alias("span"))
    return sorted(prose.interpret(df).collect(), key=lambda r: r.n)


def test_prose_binding(spark):
    ic50 = "The IC50 was 13 μM in MCF-7 cells and 16 μM in MDA‐MB‐231 cells."
    cases = [
        ("Batch A achieved a yield of 85 % at last.", "85 %", "%", "yield", "Batch A"),
        (ic50, "13 μM", "μM", "IC50", "MCF-7"),
        (ic50, "16 μM", "μM", "IC50", "MDA-MB-231"),
        ("Cells were treated with 20 uM for 6 h.", "20 uM", "uM", "treatment concentration", "6 h"),
        ("Cells were treated with 20 uM for 6 h.", "6 h", "h", "treatment duration", None),
        ("The measured duration was 2 day.", "2 day", "day", "duration", "The measured"),
        ("It was 37 C.", "37 C", "C", "temperature", None),
        ("We saw 5 mg.", "5 mg", "mg", "numeric result", None),
        ("The highest concentration of 5 uM was used.", "5 uM", "uM", "treatment concentration", "The highest"),
        ("The cell viability reduction of the sample reached 40 %.", "40 %", "%", "cell viability reduction", "sample"),
        ("The proportion of early apoptosis of SW480 cells was 12 %.", "12 %", "%", "apoptosis proportion", "SW480"),
        ("The percentage of S phase of HT29 cells was 30 %.", "30 %", "%", "cell-cycle proportion", "HT29"),
        ("Its wavelength was 500 nm for the red dye, as said.", "500 nm", "nm", "length", "the red dye"),
        ("The drug mix (IC50 13 uM) and the new mix (viability 80 %).", "80 %", "%", "cell viability", "drug mix (IC50 13 uM) and the new mix"),
    ]
    for r, (_, _, _, metric, entity) in zip(bound(spark, *[c[:3] for c in cases]), cases, strict=True):
        assert (r.metric, r.entity) == (metric, entity), r
        assert r.question == (f"What {metric} was reported for {r.entity}?" if r.entity else f"What {metric} is reported in paragraph p1?")


def test_conditions_do_not_echo(spark):
    t = "Sample 2 had a yield of 85 %; temperature was 37 C and pressure was 2 kPa, measured using HPLC."
    first, second = bound(spark, (t, "85 %", "%"), (t, "37 C", "C"))
    assert {f.k: f.v for f in first.fields} == {"sample_or_entity": "Sample 2", "temperature": "37 C", "pressure": "2 kPa", "method": "HPLC", "assay_or_method": "HPLC"}
    assert first.condition == "sample_or_entity=Sample 2; temperature=37 C; pressure=2 kPa; method=HPLC; assay_or_method=HPLC"
    assert "temperature" not in {f.k for f in second.fields}


def test_settings_are_no_results(spark):
    cases = [("incubated at 37 C", "37 C", "C"), ("the temperature was 37 C", "37 C", "C"), ("viability at 20 uM", "20 uM", "uM"), ("IC50 at 5 uM", "5 uM", "uM"), ("The IC50 was 5 uM", "5 uM", "uM")]
    assert [r.core for r in bound(spark, *cases)] == [False, True, False, False, True]


def test_arithmetic():
    assert arithmetic("2 * (3 + 4) ** 2 / -7") == -14.0
    for bad in ("__import__('os')", "2 ** 21", "1 / 0", "True + 1", "x", "(-1) ** 0.5", "1" * 257):
        with pytest.raises(ReplayError):
            arithmetic(bad)


def test_figures():
    f = {"axes": {"x": {"label": "time", "unit": "h"}, "y": "%"}, "series": [{"name": "a", "points": [[0, 1], {"x": 1, "y": None}, {"x": 2, "y": "82 ± 1"}]}]}
    s = figures.series_of(f)
    assert s["y_axis"]["unit"] == "%" and [(p["index"], p["y_shown"], p["x_shown"]) for p in s["series"][0]["points"]] == [(0, "1 %", "0 h"), (2, "82 ± 1 %", "2 h")]


def test_html_modes():
    page = b"<title>T</title><p>a <b>b</b> c</p><table><tr><th>S</th><th></th></tr><tr><td>1</td></tr></table>"
    assert formats.from_html(page, "x.html", {})["paragraphs"][0]["text"] == "c"
    repaired = formats.from_html(page, "x.html", {}, strict=False)
    assert repaired["paragraphs"][0]["text"] == "a b c" and repaired["tables"][0]["columns"] == ["S", "column_2"]


def test_pages_and_blocks():
    assert [(p["id"], p["page"]) for p in formats.from_pages("a\n\nb\f\n\nc\n\nd")] == [("p1", 1), ("p2", 1), ("p3", 2), ("p4", 2)]
    assert [p["id"] for p in formats.from_text(b"\n\na\n\nb", "x.txt", {})["paragraphs"]] == ["p2", "p3"]


def test_layout_spans_and_headers():
    cells = [{"row": 0, "col": 0, "text": "Sample", "col_span": 2}, {"row": 1, "col": 0, "text": "a"}, {"row": 1, "col": 1, "text": "5 mg"}]
    assert layout.dense(cells) == [["Sample", "Sample"], ["a", "5 mg"]]
    out = layout.from_export({"texts": [{"text": " x  y ", "prov": [{"page_no": 3}]}], "tables": [{"data": {"table_cells": cells}}]})
    assert out["paragraphs"][0]["text"] == "x y" and out["paragraphs"][0]["page"] == 3 and len(out["tables"][0]["rows"]) == 1
    with pytest.raises(formats.FormatError):
        layout.LayoutAdapter().load(b"", "x.pdf", {})


class Answer:
    def __init__(self, data):
        self.data = data

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def read(self, n):
        return self.data[:n]


def test_remote():
    hits = b'{"resultList": {"result": [{"pmcid": "PMC1", "isOpenAccess": "Y"}, {"title": "no id"}]}}'
    assert [h["pmcid"] for h in remote.search("x", opener=lambda url: Answer(hits))] == ["PMC1"]
    for call in (lambda: remote.search("", opener=None), lambda: remote.full_text("../x", opener=None), lambda: remote.fetch("file:///etc/passwd", opener=None), lambda: remote.fetch("http://x", opener=lambda u: Answer(b"12345"), limit=4)):
        with pytest.raises(remote.SourceError):
            call()
    assert len(remote.fetch("http://x", opener=lambda u: Answer(b"1"))[1]["source_hash"]) == 64


def test_review_decisions():
    assert review.check_decision(" Accept ", "me", None) == "accept"
    for args in (("maybe", "me", None), ("accept", " ", None), ("modify", "me", {}), ("accept", "me", {"unit": "x"}), ("modify", "me", {"source.doc_id": 1})):
        with pytest.raises(review.ReviewError):
            review.check_decision(*args)
    assert review.set_path({"a": {"b": 1}}, "a.c.d", 2) == {"a": {"b": 1, "c": {"d": 2}}}


def test_row_labels(spark):
    rows = [[("x", "1"), ("Sample", "")], [("name", "n"), ("Sample", "s")]]
    got = column(spark, rows, lambda v: mine.row_label(v, F.lit(4)), "array<struct<name:string,value:string>>")
    assert got == ["row 5", "s"]


def test_groups_of_a_match_alone(spark):
    """Numbers, errors and units are read from each match alone, and are those that it has in its text."""
    texts = ["x5 mg 5 mg, 1.5 ± 0.2 mM and 3 + 4 uM; 5mg 5M 5 M -3e5 K", "µ 2 µM/h 7 μg/mL. .5 mm 5. mm 1.2.3 mg", "", "5 mg\n6 kg"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", units.spans(F.col("t")).alias("s"))
    for r in df.collect():
        assert [tuple(x) for x in r.s] == units.find_spans(r.t)


def test_noun_after_the_last_stop(spark):
    """The search for the noun of a metric reads the text after the last stop alone, whatever stands before it."""
    text = "a; b. " * 60 + "one, the big one had a yield of 4 %"
    df = spark.createDataFrame([("p1", text)], "id string, text string").select("*", F.explode(units.spans(F.col("text"))).alias("span"))
    plan = prose.interpret(df).select("entity")
    assert [r.entity for r in plan.collect()] == ["the big one"] and "_last" in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["duplicate_groups", "conflict_groups"])
def test_grouped_samples_are_mined_once(spark, name):
    """Line items are read for the candidates and for their provenance, and not for the facts of groups once more."""
    from assaykit.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2
