"""Whole runs: documents to curated samples, evaluation, ablation, contamination, and what they write."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import curate, mine, publish, review, score
from assaykit.operators.verify import replay, verify
from assaykit.sources import readers
from assaykit.sources.package import stored, with_ordinal

# The strategy to try after one that found too little.
FALLBACKS = {"table_only": "result_focused", "result_focused": "multimodal", "multimodal": "full", "full": "multimodal"}


def run_documents(docs: DataFrame, strategy: str = "result_focused", order: str = "batch", rel: float = 0.02) -> DataFrame:
    """Curated samples of documents: mine, verify, enrich, contract, groups and repeats in the order asked for, settle."""
    docs = docs if "doc_ordinal" in docs.columns else with_ordinal(docs, "doc_id")
    s = curate.to_samples(mine.candidates(docs, strategy), docs)
    return finish(curate.contract(curate.enrich(verify(s, docs, rel))), order)


def finish(samples: DataFrame, order: str = "batch") -> DataFrame:
    """Groups, then repeats, which ask nothing of each other: what groups are made of is not shuffled by id again. ``order``
    decides which mode counts first."""
    return curate.settle(curate.mark_repeats(curate.group_claims(samples)), order)


VERIFIED = (
    "status", "verify_mode", "recomputed", "evidence_checked", "enrich_mode", "contract_mode", "contract_errors", "result_type", "operations", "difficulty", "modalities", "duplicate_group_id",
    "duplicate_status", "conflict_group_id", "conflict_mode", "dup_mode", "license_mode", "failure_mode", "needs_review", "bucket",
)


def reverify(samples: DataFrame, docs: DataFrame) -> DataFrame:
    """Samples verified against their sources, enriched, checked against the contract and settled once more."""
    return finish(curate.contract(curate.enrich(verify(samples.drop(*VERIFIED), docs))))


def apply_review(samples: DataFrame, decisions: DataFrame, docs: DataFrame) -> DataFrame:
    """Samples after their latest decisions, those that were changed verified again. A changed sample whose document is not
    among ``docs`` stays as ``review.apply_decisions`` left it."""
    done = review.apply_decisions(samples, decisions)
    changed = F.coalesce(F.col("review_decision") == "modify", F.lit(False))
    known = docs.select(F.col("doc_id").alias("_known")).distinct()
    there = done.filter(changed).join(known, F.col("doc_id") == F.col("_known"), "left_semi")
    away = done.filter(changed).join(known, F.col("doc_id") == F.col("_known"), "left_anti")
    again = reverify(there, docs)
    return done.filter(~changed).unionByName(away).unionByName(again.select(*done.columns))


def run(spark: SparkSession, paths: list[str] | str, strategy: str = "result_focused", metadata: DataFrame | None = None, folder: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(documents, samples) of files. One document is a batch of one. Files are parsed once (see ``package.stored``)."""
    docs = stored(readers.read_documents(spark, paths, metadata, **options).filter("error IS NULL"), folder)
    docs = with_ordinal(docs, "path")
    return docs, run_documents(docs, strategy)


def read_entries(spark: SparkSession, path: str, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, expected claims, entries with doc_id and expected counts) of a manifest, its files parsed once."""
    entries = readers.read_manifest(spark, path)
    paths = [r.path for r in entries.select("path").distinct().collect()]  # the file names that one manifest file lists
    parsed = readers.read_documents(spark, paths, entries.select("path", "metadata").dropDuplicates(["path"])).filter("error IS NULL")
    docs = stored(parsed.join(entries.select("path", F.col("entry_ordinal").alias("doc_ordinal")), "path"), folder)
    known = docs.select("path", "doc_id").dropDuplicates(["path"]).join(entries.select("path", "expected", "expected_claims"), "path")
    return docs, known.select("doc_id", F.explode("expected_claims").alias("c")).select("doc_id", "c.*"), known.select("doc_id", "expected")


def run_manifest(spark: SparkSession, path: str, strategy: str = "result_focused") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, samples, expected claims) of a manifest."""
    docs, expected, _ = read_entries(spark, path)
    return docs, run_documents(docs, strategy), expected


def evaluate(spark: SparkSession, manifest: str, strategies: tuple[str, ...] = ("table_only", "full", "result_focused")) -> tuple[DataFrame, DataFrame]:
    """(per document and strategy, per strategy): claims, locators, conditions and values, and whether the numbers of samples
    are those that the manifest expects."""
    docs, expected, entries = read_entries(spark, manifest)
    samples = None
    for strategy in strategies:
        s = run_documents(docs, strategy).withColumn("strategy", F.lit(strategy))
        samples = s if samples is None else samples.unionByName(s)
    samples = stored(samples)
    matches = score.count_matches(samples, entries)
    by_document = score.score_documents(samples, expected, entries).join(matches, ["strategy", "doc_id"], "left")
    return by_document, score.score_strategies(by_document).join(score.count_accuracy(matches), "strategy")


def contamination(samples: DataFrame, docs: DataFrame) -> DataFrame:
    """The five contamination cases, verified: the report of ``score.adversarial_report``."""
    cases = score.contaminate(samples)
    kept = cases.drop("status", "verify_mode", "recomputed", "evidence_checked", "failure_mode", "needs_review", "license_mode")
    done = verify(kept, docs)
    unknown = F.when(F.col("verify_mode").isNull() & ~curate.known_license(F.col("license")), "license_unknown")
    done = done.withColumn("failure_mode", F.coalesce("verify_mode", unknown)).withColumn("needs_review", F.col("failure_mode").isNotNull())
    return score.adversarial_report(done)


def write_run(samples: DataFrame, docs: DataFrame, folder: str) -> None:
    """The run's tables under ``folder``: samples by bucket, their JSON lines, review queue, cards, data card, summary."""
    samples.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/samples")
    stored = samples.sparkSession.read.parquet(f"{folder}/samples")
    stored.select(F.to_json(F.struct(*sorted(stored.columns))).alias("value")).write.mode("overwrite").text(f"{folder}/all_jsonl")
    review.queue(stored).write.mode("overwrite").json(f"{folder}/review_queue")
    publish.result_cards(stored).write.mode("overwrite").option("header", True).csv(f"{folder}/result_cards_csv")
    for name, table in (("data_card", publish.data_card), ("summary", publish.run_summary), ("failure_modes", publish.failure_modes), ("splits", publish.split_summary)):
        table(stored).coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    publish.document_counts(docs, stored).write.mode("overwrite").json(f"{folder}/documents")


def resolve(paths: list[str], roots: list[str]) -> list[str]:
    """Local inputs of an earlier run where they are now: as written, else under the first of ``roots`` that has them. Paths
    with a scheme stay as they are. One that is nowhere is an error."""
    out = []
    for path in paths:
        places = [path] if "://" in path else [p for p in (path, *(os.path.join(r, path.lstrip("/")) for r in roots), *(os.path.join(r, os.path.basename(path)) for r in roots)) if os.path.exists(p)]
        if not places:
            raise FileNotFoundError(f"{path} is neither here nor under {roots}")
        out.append(places[0])
    return out


def retry(spark: SparkSession, paths: list[str] | str, strategy: str, previous_summary: dict, metadata: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Run again with the fallback strategy; metadata carries over, and the lineage names the summary that was retried."""
    docs, samples = run(spark, paths, FALLBACKS[strategy], metadata)
    digest = hashlib.sha256(json.dumps(previous_summary, sort_keys=True, default=str).encode()).hexdigest()
    return docs, samples, {"retried_strategy": strategy, "strategy": FALLBACKS[strategy], "previous_summary_sha256": digest}


__all__ = ["FALLBACKS", "apply_review", "contamination", "evaluate", "finish", "read_entries", "replay", "resolve", "retry", "reverify", "run", "run_documents", "run_manifest", "write_run"]
