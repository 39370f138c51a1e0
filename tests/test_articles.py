"""

ASSAYKIT_MANIFESTS names the folder; without it these tests are skipped, as the articles are no part of this repository."""

import os

import pytest
from pyspark.sql import functions as F

from assaykit.operators import score
from assaykit.plans import runs

FOLDER = os.environ.get("ASSAYKIT_MANIFESTS", "")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="ASSAYKIT_MANIFESTS names no folder")


def test_strategies_on_two_articles(spark):
    by_document, by_strategy = runs.evaluate(spark, f"{FOLDER}/p0-gold-manifest.json")
    got = {r.strategy: r for r in by_strategy.collect()}
    rates = {k: (r.claim_recall, r.claim_precision) for k, r in got.items()}
    assert rates == {"table_only": (0.1154, 1.0), "full": (1.0, 0.3152), "result_focused": (1.0, 1.0)}
    agreement = {k: (r.candidates_accuracy, r.gold_accuracy) for k, r in got.items()}
    assert agreement == {"table_only": (0.0, 0.0), "full": (0.0, 0.0), "result_focused": (1.0, 1.0)}
    r = got["result_focused"]
    assert (r.table_value_match_rate, r.locator_precision, r.locator_recall, r.condition_match_rate) == (1.0, 1.0, 1.0, 1.0)
    deltas = {x.strategy: (x.claim_recall_delta, x.claim_precision_delta) for x in score.strategy_deltas(by_strategy).collect()}
    assert deltas == {"full": (0.8846, -0.6848), "result_focused": (0.8846, 0.0)}
    assert by_document.count() == 6


def test_buckets_ablation_and_contamination(spark):
    docs, samples, expected = runs.run_manifest(spark, f"{FOLDER}/p0-gold-manifest.json")
    samples = samples.cache()
    assert {r.bucket: r["count"] for r in samples.groupBy("bucket").count().collect()} == {"gold": 46, "silver": 6}
    kept = {r.variant: (r.selected_count, r.claim_recall, r.claim_precision) for r in score.ablate(samples, expected).collect()}
    less = (46, 0.8846, 1.0)
    assert kept == {"all_gates": less, "without_quality_gate": (52, 1.0, 1.0), "without_verifier": less, "without_license_gate": less, "without_evidence_path_gate": less}
    assert {r.gate: r.rejected for r in score.gate_rejections(samples).collect()} == {"quality": 6, "verifier": 0, "license": 0, "evidence": 0, "acquisition_path": 0}
    report = runs.contamination(samples, docs)
    assert all(r.observed_mode == r.expected_mode for r in report.collect())
    s = score.adversarial_summary(report).first()
    assert (s.cases, s.rejected, s.rejection_rate, s.bypass, s.bypass_rate) == (5, 5, 1.0, 3, 0.6)
    groups = samples.filter("duplicate_group_id IS NOT NULL").agg(F.count_distinct("duplicate_group_id").alias("g"), F.count("*").alias("n")).first()
    assert (groups.g, groups.n) == (6, 12)


def test_four_articles(spark):
    docs, samples, _ = runs.run_manifest(spark, f"{FOLDER}/real-smoke-manifest.json")
    got = samples.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "gold").alias("gold"))
    counts = sorted((r.n, r.gold) for r in docs.select("doc_id").join(got, "doc_id", "left").fillna(0).collect())
    assert counts == [(0, 0), (23, 23), (29, 23), (140, 140)]


def test_mixed_formats(spark):
    _, samples, expected = runs.run_manifest(spark, f"{FOLDER}/manifest.json")
    kept = {r.variant: r.selected_count for r in score.ablate(samples, expected).collect()}
    assert (kept["all_gates"], kept["without_license_gate"]) == (36, 41)
    assert {r.gate: r.rejected for r in score.gate_rejections(samples).collect()}["license"] == 5
