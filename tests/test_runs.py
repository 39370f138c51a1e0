"""Documents of every format through whole runs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from assaykit.operators import curate, publish, review, score
from assaykit.operators.verify import replay
from assaykit.plans import runs
from assaykit.sources import readers

PACKAGE = {
    "doc_id": "demo", "title": "Demo", "year": 2024, "license": "CC-BY-4.0",
    "paragraphs": [{"id": "p1", "page": 1, "text": "Compound X showed improved response over compound Y."}, {"id": "p2", "page": 1, "text": "Methods are standard."}],
    "tables": [{"id": "Table 1", "page": 2, "caption": "Values after 2 h", "rows": [{"Sample": "S1", "IC50": "12 uM", "Max response": "80 %"}, {"Sample": "S2", "IC50": "n/a", "Max response": "75 ± 2 %"}, {"Sample": "S3", "IC50": "1.5 uM", "Max response": "60 %"}]}],
    "figures": [{"id": "f1", "axes": {"x": {"label": "time", "unit": "h"}, "y": {"label": "viability", "unit": "%"}}, "series": [{"name": "a", "points": [[0, 100], [1, "82 ± 1"], [2, 61.5]]}]}],
}
CONFLICT = {
    "doc_id": "clash", "title": "Clash", "year": 2024, "license": "MIT",
    "tables": [{"id": f"T{k}", "page": 1, "rows": [{"Sample": "S1", "IC50": f"{v} uM"}]} for k, v in ((1, 10), (2, 12))],
}
CSV = "﻿Sample,IC50,Max response\nS1,5 nM,70 %\nS2,6 nM,n/a\n"
HTML = "<html><title>Page</title><p>Batch A achieved a yield of 85 %.</p><table><tr><th>Sample</th><th>Mass (mg)</th></tr><tr><td>A</td><td>5</td></tr></table></html>"
JATS = """<article><front><article-meta><article-id pub-id-type="pmcid">DEMO</article-id><title-group><article-title>An article</article-title></title-group>
<pub-date><year>2021</year></pub-date><permissions><license><license-p>Creative Commons Attribution License</license-p></license></permissions></article-meta></front>
<body><sec><title>Results</title><p>The yield <i>rose</i> to a yield of 40 % for sample B.</p>
<table-wrap><label>Table 1</label><caption>Cells for 48 h</caption><table><thead><tr><th rowspan="2">Sample</th><th colspan="2">IC50</th></tr><tr><th>24 h</th><th>36 h</th></tr></thead>
<tbody><tr><td>HT29</td><td>3 uM</td><td>2 uM</td></tr></tbody></table></table-wrap>
<fig id="F1"><label>Fig 1</label><alt-text>Response of 12 % seen</alt-text></fig></sec></body></article>"""


def xlsx():
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Sample</t></si><si><t>Mass (mg)</t></si><si><t>A</t></si></sst>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="s"><v>2</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("documents")
    files = {"demo.json": json.dumps(PACKAGE), "clash.json": json.dumps(CONFLICT), "m.csv": CSV, "page.html": HTML, "a.nxml": JATS, "notes.txt": "\n\nFirst block.\n\nSample 4 had a yield of 9 %.", "broken.xml": "<a>", "odd.bin": "?"}
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    (folder / "book.xlsx").write_bytes(xlsx())
    d = readers.read_documents(spark, str(folder)).withColumn("name", F.substring_index("path", "/", -1))
    return d.cache()


@pytest.fixture(scope="module")
def samples(docs):
    return runs.run_documents(docs.filter("error IS NULL"), "multimodal").cache()


def test_formats(docs):
    d = {r.name: r for r in docs.collect()}
    assert d["broken.xml"].error and d["odd.bin"].error and sum(r.error is None for r in d.values()) == 7
    a = d["a.nxml"]
    assert (a.doc_id, a.title, a.year, a.license) == ("PMCDEMO", "An article", 2021, "CC-BY-4.0")
    assert a.paragraphs[0].text == "The yield rose to a yield of 40 % for sample B." and a.paragraphs[0].section_path == ["Results"]
    assert a.tables[0].columns == ["Sample", "IC50 / 24 h", "IC50 / 36 h"] and a.figures[0].alt_text == "Response of 12 % seen"
    assert d["page.html"].title == "Page" and d["m.csv"].tables[0].columns == ["Sample", "IC50", "Max response"]
    assert [p.id for p in d["notes.txt"].paragraphs] == ["p2", "p3"] and d["book.xlsx"].tables[0].rows[0][1].value == "7"
    assert len(d["demo.json"].source_hash) == 64


def test_run(docs, samples):
    rows = samples.collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    demo = by["demo"]
    assert len(demo) == 5 + 1 + 3 and all(r.status == "pass" and r.bucket == "gold" for r in demo)  # cells, a relation, points
    assert {r.condition for r in demo if r.evidence[0].modality == "table"} == {"2 h"}
    assert {r.condition for r in by["PMCDEMO"] if r.card_metric == "IC50"} == {"24 h", "36 h"}
    assert {r.failure_mode for r in by["clash"]} == {"conflicting_values"} and {r.bucket for r in by["clash"]} == {"silver"} and len({r.conflict_group_id for r in by["clash"]}) == 1
    csv = next(v for k, v in by.items() if "m.csv" in k)
    assert len(csv) == 3 and all(r.bucket == "silver" and r.failure_mode == "license_unknown" for r in csv)
    assert publish.run_summary(samples).first().path_reproducibility == 1.0
    asked = publish.ask_samples(samples, "What IC50 was reported for S1?", 2).collect()
    assert len(asked) == 2 and asked[0].score >= asked[1].score


def test_interpreter_agrees_with_joins(docs, samples):
    out = replay(samples.select("id", "doc_id", "path", "value_num", "unit"), docs.filter("error IS NULL")).collect()
    assert out and all(r.replay_error is None for r in out)
    assert all(r.value_num is None or (r.replay_value, r.replay_unit) == (r.value_num, r.unit) for r in out)


def test_contamination(docs, samples):
    gold = samples.filter("doc_id = 'demo'")
    report = {r.case: r for r in runs.contamination(gold, docs.filter("error IS NULL")).collect()}
    assert {k: r.observed_mode for k, r in report.items()} == dict(score.CASES) and all(r.rejected for r in report.values())
    assert sum(r.selected_without_verifier for r in report.values()) == 3


def test_repeats_and_precedence(samples):
    demo = samples.filter("doc_id = 'demo'").drop("dup_mode", "license_mode", "failure_mode", "needs_review", "bucket", "duplicate_group_id", "duplicate_status", "conflict_group_id", "conflict_mode")
    twice = demo.unionByName(demo.withColumn("ord", F.transform("ord", lambda x: x + 1)))
    out = runs.finish(twice).groupBy("failure_mode", "status").count().collect()
    assert {(r.failure_mode, r.status): r["count"] for r in out} == {(None, "pass"): 9, ("duplicate_sample", "fail"): 9}


def test_review(spark, samples, tmp_path):
    log = str(tmp_path / "log")
    ids = [r.id for r in samples.filter("doc_id = 'clash'").orderBy("ord").collect()]
    for key, decision in ((ids[0], "reject"), (ids[0], "accept"), (ids[1], "reject")):
        last = review.record(spark, log, key, decision, "me")
    assert last.startswith("decision-000003-")
    out = {r.id: r for r in review.apply_decisions(samples, spark.read.parquet(log)).collect()}
    assert (out[ids[0]].bucket, out[ids[1]].bucket, out[ids[1]].failure_mode) == ("gold", "rejected", "human_rejected")
    queue = review.queue(samples).collect()
    assert [r.rank for r in queue] == list(range(1, len(queue) + 1)) and queue[0].failure_mode == "conflicting_values"


def test_changed_samples_are_verified_again(spark, samples, docs, tmp_path):
    log = str(tmp_path / "log")
    numbers = samples.filter("doc_id = 'demo' AND value_num IS NOT NULL AND bucket = 'gold'").orderBy("ord").collect()
    wrong, right, away = numbers[:3]
    review.record(spark, log, wrong.id, "modify", "me", changes={"value_num": 999999.0}, before={"value_num": wrong.value_num, "unit": wrong.unit})
    review.record(spark, log, right.id, "modify", "me", changes={"condition": "said so"})
    review.record(spark, log, away.id, "modify", "me", changes={"value_num": away.value_num})
    decisions = spark.read.parquet(log)
    logged = json.loads(decisions.filter(F.col("sample_id") == wrong.id).first().after)
    assert logged == {"value_num": 999999.0, "unit": wrong.unit}
    plain = {r.id: r for r in review.apply_decisions(samples, decisions).collect()}
    assert {(plain[x.id].status, plain[x.id].bucket, plain[x.id].failure_mode) for x in (wrong, right, away)} == {("unverified", "silver", review.UNVERIFIED)}
    good = docs.filter("error IS NULL")
    done = {r.id: r for r in runs.apply_review(samples, decisions, good).collect()}
    assert len(done) == len(plain) and (done[wrong.id].status, done[wrong.id].failure_mode, done[wrong.id].bucket) == ("fail", "answer_mismatch", "silver")
    assert (done[right.id].status, done[right.id].bucket, done[right.id].condition) == ("pass", "gold", "said so") and done[away.id].bucket == "gold"
    without = {r.id: r for r in runs.apply_review(samples, decisions, good.filter("doc_id <> 'demo'")).collect()}
    assert without[wrong.id].failure_mode == review.UNVERIFIED


def test_replay_keeps_rows_of_one_id_apart(samples, docs):
    some = samples.filter("doc_id = 'demo'")
    twice = some.unionByName(some.withColumn("id", F.lit("same")).withColumn("path", F.slice("path", 1, 1)))
    out = replay(twice, docs.filter("error IS NULL")).collect()
    assert len(out) == 2 * some.count() and sum(r.id == "same" for r in out) == some.count() and all(r.replay_error is None for r in out)
    nowhere = replay(some.withColumn("doc_id", F.lit("gone")), docs.filter("error IS NULL")).collect()
    assert {r.replay_error for r in nowhere} == {"no such document"}


def test_documents_without_claims_count(spark, samples):
    claim = [("demo", "table", "Table 1", "S1", "IC50", "12")]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("task_type", "string"), ("condition", "string"), ("uncertainty", "double"), ("unit", "string"), ("metric", "string"), ("entity", "string"), ("paragraph_id", "string"), ("subject", "string"), ("object", "string"))]
    expected = spark.createDataFrame([*claim, ("nobody", *claim[0][1:])], "doc_id string, kind string, table_id string, row string, col string, value string").select("*", *none)
    asked = spark.createDataFrame([("demo",), ("silent",)], "doc_id string")
    scored = score.score_documents(samples, expected, asked)
    out = {r.doc_id: r for r in scored.collect()}
    assert set(out) == {r.doc_id for r in samples.select("doc_id").distinct().collect()} | {"demo", "nobody", "silent"}
    assert (out["nobody"].expected_claims, out["nobody"].predicted_claims, out["nobody"].claim_recall) == (1, 0, 0.0) and out["silent"].predicted_claims == 0
    total = sum(r.predicted_claims for r in out.values())
    assert score.score_strategies(scored).first().claim_precision == round(1 / total, 4)
    entries = spark.createDataFrame([("demo", (samples.filter("doc_id = 'demo'").count(), None, 0)), ("silent", (1, 0, None))], "doc_id string, expected struct<candidates:int,gold:int,silver:int>")
    matches = score.count_matches(samples, entries)
    assert {r.doc_id: r.candidates_match for r in matches.collect()} == {"demo": True, "silent": False}
    assert score.count_accuracy(matches).first().candidates_accuracy == 0.5


def test_scoring_and_ablation(spark, samples):
    claim = lambda kind="table", **k: [k.get(c) for c in ("doc_id",)] + [kind] + [k.get(c) for c in ("table_id", "row", "col", "task_type", "condition", "value", "uncertainty", "unit", "metric", "entity", "paragraph_id", "subject", "object")]
    names = "doc_id string, kind string, table_id string, row string, col string, task_type string, condition string, value string, uncertainty double, unit string, metric string, entity string, paragraph_id string, subject string, object string"
    rows = [claim(doc_id="demo", table_id="Table 1", row=r, col=c, value=v, condition=k) for r, c, v, k in (("S1", "IC50", "12", "2 h"), ("S2", "Max response", "75.0", "2 h"), ("S3", "IC50", "1.4", "3 h"))]
    rows.append(claim("relation", doc_id="demo", paragraph_id="p1", value="improved", subject="compound x showed", object="response over compound y"))
    rows.append(claim("relation", doc_id="demo", paragraph_id="p1", value="improved", subject="Compound X", object="Response over compound Y"))
    expected = spark.createDataFrame(rows, names)
    r = score.score_documents(samples, expected).filter("doc_id = 'demo'").first()
    assert (r.expected_claims, r.matched_claims, r.condition_match_rate, r.table_value_match_rate) == (5, 4, 0.6667, 0.6667)
    a = {x.variant: x.selected_count for x in score.ablate(samples, expected).collect()}
    assert a["all_gates"] < a["without_license_gate"] and a["all_gates"] < a["without_quality_gate"]


def test_write(samples, docs, tmp_path, spark):
    runs.write_run(samples, docs.filter("error IS NULL"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/samples").count() == samples.count()
    assert spark.read.json(f"{tmp_path}/data_card").count() > 5 and curate.GATES
