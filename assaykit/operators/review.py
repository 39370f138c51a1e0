"""Human review: the queue, decisions as an append-only log, and what they make of the samples."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaykit.operators import curate

# Failure modes by priority of review; others have DEFAULT_PRIORITY.
PRIORITIES = {
    "conflicting_values": 100, "evidence_mismatch": 95, "evidence_not_found": 95, "missing_evidence": 90, "path_execution_error": 90, "answer_mismatch": 85,
    "missing_acquisition_path": 80, "schema_contract_error": 75, "license_unknown": 60, "underspecified_relation": 50, "underspecified_question": 45, "duplicate_sample": 40,
}
DEFAULT_PRIORITY = 30
DECISIONS = ("accept", "modify", "reject")
#: Failure mode of a sample that was changed and not verified since.
UNVERIFIED = "review_revalidation_unavailable"
# What apply_decisions() changes.
EDITABLE = ("value_num", "unit", "metric", "entity", "condition")
IMMUTABLE = ("id", "doc_id", "source_hash", "local_path", "source.doc_id", "source.source_hash", "source.local_path")


class ReviewError(ValueError):
    """A decision that may not be recorded."""


def priority(mode: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, mode), F.lit(DEFAULT_PRIORITY))


def queue(samples: DataFrame) -> DataFrame:
    """Samples that need review and are not rejected, ranked by priority, document and id.

    The rank is global, as reviewers see one list; the window sorts the queue alone, not the samples."""
    q = samples.filter(F.col("needs_review") & (F.coalesce("failure_mode", F.lit("")) != "human_rejected"))
    q = q.withColumn("failure_mode", F.coalesce(F.nullif("failure_mode", F.lit("")), F.lit("unclassified"))).withColumn("priority", priority(F.col("failure_mode")))
    kept = [c for c in ("question", "title", "year", "license", "display", "card_metric", "card_entity", "evidence", "path", "status") if c in samples.columns]
    if "ord" in samples.columns:
        # The one global order is over keys alone; what reviewers read joins its rank afterwards.
        keys = q.select("priority", "doc_id", "id", "ord")
        ranks = keys.select(F.row_number().over(Window.orderBy(F.desc("priority"), "doc_id", "id", "ord")).alias("rank"), F.col("ord").alias("_ord"), F.col("id").alias("_id"))
        q = q.join(ranks, (F.col("id") == F.col("_id")) & (F.col("ord") == F.col("_ord")))
    else:
        q = q.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), "doc_id", "id")))
    return q.select("rank", F.col("id").alias("sample_id"), "doc_id", "failure_mode", "priority", action(F.col("failure_mode")).alias("recommended_action"), *kept).orderBy("rank")


def action(mode: Column) -> Column:
    rules = (("conflicting", "compare the sources and keep one value"), ("evidence|missing", "locate the evidence in the source"), ("path|answer|schema", "correct the claim and verify it again"), ("license", "confirm the license"), ("underspecified", "name the metric, entity or sides"), ("duplicate", "drop the repeat"))
    out = F.lit("inspect the sample")
    for pattern, text in reversed(rules):
        out = F.when(mode.rlike(pattern), F.lit(text)).otherwise(out)
    return out


def check_decision(decision: str, reviewer: str, changes: dict | None) -> str:
    """The decision in its usual spelling, or an error."""
    d = str(decision).strip().casefold()
    if d not in DECISIONS:
        raise ReviewError(f"a decision is one of {DECISIONS}")
    if not str(reviewer).strip():
        raise ReviewError("a decision names its reviewer")
    if (d == "modify") != bool(changes):
        raise ReviewError("modify, and only modify, brings changes")
    for path in changes or {}:
        if not str(path).strip() or any(path == p or path.startswith(p + ".") for p in IMMUTABLE):
            raise ReviewError(f"{path!r} is provenance and stays")
        if path not in EDITABLE:
            raise ReviewError(f"{path!r} is none of {EDITABLE}, which a decision can change")
        value = changes[path]
        number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
        if not (number if path == "value_num" else isinstance(value, str)):
            raise ReviewError(f"{path!r} does not take {value!r}")
    return d


def set_path(record: dict, path: str, value: object) -> dict:
    """``record`` with the value at a dotted path; missing parents appear, parents that are no objects are an error."""
    head, _, rest = path.partition(".")
    if not rest:
        return record | {head: value}
    child = record.get(head, {})
    if not isinstance(child, dict):
        raise ReviewError(f"{head} holds no object")
    return record | {head: set_path(child, rest, value)}


LOG = "seq bigint, decision_id string, sample_id string, decision string, reviewer string, comment string, changes string, before string, after string, recorded_at timestamp"


def record(spark: SparkSession, log: str, sample_id: str, decision: str, reviewer: str, comment: str = "", changes: dict | None = None, before: dict | None = None) -> str:
    """Append one decision to the log (a parquet folder); returns its id.

    ``before`` is the sample as the reviewer saw it; it is logged, and so is what the changes make of it. Two reviewers may
    record at once: their decisions may share a number, never an id, and :func:`latest` orders them by number, time and id."""
    d = check_decision(decision, reviewer, changes)
    try:
        n = (spark.read.schema(LOG).parquet(log).agg(F.max("seq")).first()[0] or 0) + 1
    except AnalysisException as error:  # the first decision makes the log
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        n = 1
    key = f"decision-{n:06d}-{uuid.uuid4().hex[:12]}"
    after = dict(before or {})
    for path, value in (changes or {}).items():
        after = set_path(after, path, value)
    row = spark.createDataFrame([(n, key, sample_id, d, reviewer.strip(), comment, json.dumps(changes or {}), json.dumps(before or {}), json.dumps(after))], LOG.rsplit(",", 1)[0])
    row.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(log)
    return key


def latest(decisions: DataFrame) -> DataFrame:
    """The last decision of each sample: by sequence, not by arrival; of equal numbers the later, then the larger id."""
    order = F.struct("seq", *[c for c in ("recorded_at", "decision_id") if c in decisions.columns])
    last = F.max_by(F.struct("decision", "reviewer", "comment", "changes"), order).alias("d")
    return decisions.groupBy("sample_id").agg(last, F.count("*").alias("n_decisions")).select("sample_id", "n_decisions", "d.*")


def apply_decisions(samples: DataFrame, decisions: DataFrame) -> DataFrame:
    """Samples after their latest decisions. Acceptance lifts a review flag, never the verifier or a license. Changes to
    value_num, unit, metric, entity or condition are made, and what was verified before holds no longer: such a sample is
    ``unverified`` and silver, with failure mode UNVERIFIED, until ``runs.apply_review`` has verified it again."""
    d = latest(decisions).select(F.col("sample_id").alias("_id"), F.col("decision").alias("review_decision"), "reviewer", "changes")
    s = samples.join(d, F.col("id") == F.col("_id"), "left").drop("_id")
    accept, reject, modify = (F.coalesce(F.col("review_decision") == k, F.lit(False)) for k in ("accept", "reject", "modify"))
    passed, license_only = F.col("status") == "pass", F.col("failure_mode") == "license_unknown"
    mode = F.when(accept & ~passed, "human_accept_unverified").when(accept & license_only, F.col("failure_mode")).when(accept, F.lit(None)).when(reject, "human_rejected").when(modify, UNVERIFIED).otherwise(F.col("failure_mode"))
    change = lambda c: F.get_json_object("changes", f"$['{c}']")
    edited = {c: F.when(modify & change(c).isNotNull(), change(c).cast(dict(samples.dtypes)[c])).otherwise(F.col(c)) for c in EDITABLE if c in samples.columns}
    s = s.withColumn("_mode", mode).withColumn("status", F.when(modify, "unverified").otherwise(F.col("status"))).withColumns(edited)
    s = s.withColumn("needs_review", F.when(accept | reject, F.lit(False)).when(modify, F.lit(True)).otherwise(F.col("needs_review"))).withColumn("failure_mode", F.col("_mode")).drop("_mode", "changes")
    return s.withColumn("bucket", F.when(reject, "rejected").when(modify, "silver").otherwise(curate.bucket()))


def rejected(samples: DataFrame) -> DataFrame:
    return samples.filter("failure_mode = 'human_rejected'")


def active(samples: DataFrame, rejected_ids: DataFrame) -> DataFrame:
    """Samples without those whose ids were rejected."""
    return samples.join(rejected_ids.select(F.col("id").alias("_r")), F.col("id") == F.col("_r"), "left_anti")
