"""From verified candidates to curated samples: labels, contract, groups, gates and the order of failure modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.functions.text import known_license

# Leads that say a relation's side is no subject or object.
NOISE = ("as shown", "to determine", "to explore", "when ", "compared with", ",", "as the concentration")
# Failure modes that gates other than the quality gate own.
OWNED = (
    "license_unknown", "missing_evidence", "evidence_mismatch", "evidence_not_found", "unsupported_evidence_modality", "missing_acquisition_path", "path_execution_error", "answer_mismatch", "human_accept_unverified",
)
GATES = ("quality", "verifier", "license", "evidence", "acquisition_path")
PRECEDENCE = {
    "single": ("dup_mode", "conflict_mode", "contract_mode", "enrich_mode", "license_mode", "verify_mode"),
    "batch": ("conflict_mode", "dup_mode", "contract_mode", "enrich_mode", "license_mode", "verify_mode"),
}


def to_samples(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with their document's provenance, split and the fallbacks of a result card."""
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    src = docs.select(F.col("doc_id").alias("_doc"), "title", "year", "license", "local_path", F.col("source_hash") if "source_hash" in docs.columns else F.lit(None).cast("string").alias("source_hash"), meta("domain").alias("domain"))
    modality = F.get("evidence", 0)["modality"]
    fallback = F.when(modality == "table", "column_header").when(modality == "figure", "figure_axis").otherwise("local_text")
    return candidates.join(src.hint("shuffle_hash"), F.col("doc_id") == F.col("_doc")).drop("_doc").withColumns(
        {
            "split": tx.split_name(F.col("doc_id")),
            "card_entity": F.coalesce(F.nullif("entity", F.lit("")), F.nullif("rel_subject", F.lit("")), F.col("subject")),
            "card_metric": F.coalesce("metric", F.when(F.col("task_type") == "relation", "relation")),
            "condition_status": F.when(F.coalesce("condition", F.lit("")) != "", "explicit").otherwise("not_extracted"),
            "condition_source": F.when(F.coalesce("condition", F.lit("")) == "", "not_extracted").otherwise(F.coalesce("condition_source", fallback)),
            "domain": F.coalesce("domain", F.lit("scientific_data")),
            "value_text": F.coalesce("value_text", tx.float_text(F.col("value_num"))),
        }
    )


def enrich(samples: DataFrame) -> DataFrame:
    """Result type, modalities, operations, difficulty, and enrich_mode where a claim says too little."""
    numeric, relation = F.col("task_type") == "numeric_qa", F.col("task_type") == "relation"
    modalities = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["modality"])))
    derived = F.exists("path", lambda p: p["action"].isin("unit_convert", "arith_eval"))
    has = lambda m: F.array_contains(F.col("modalities"), m)
    steps = F.array_compact(F.array(F.when(has("text"), "text_span_extraction"), F.when(has("table"), "table_cell_extraction"), F.lit("number_unit_parsing"), F.when(derived, "derived_value_computation")))
    sides = (F.coalesce("rel_subject", F.lit("")) != "") & (F.coalesce("rel_object", F.lit("")) != "")
    effort = F.when(numeric, F.lit(0.15) + F.lit(0.08) * F.size("path") + F.when(derived, 0.15).otherwise(0.0)).when(relation, F.when(sides, 0.45).otherwise(0.35)).otherwise(0.5)
    s = samples.withColumn("modalities", modalities)
    low = lambda c: tx.casefold(F.trim(F.coalesce(F.col(c), F.lit(""))))
    noisy = F.lit(False)
    for lead in NOISE:
        noisy = noisy | low("rel_subject").startswith(lead) | low("rel_object").startswith(lead)
    words = lambda c: F.size(F.filter(F.split(low(c), r"\s+"), lambda w: w != ""))
    weak_relation = ~sides | noisy | (words("rel_subject") > 20) | (words("rel_object") > 24)
    weak_number = has("text") & ((F.col("metric") == "numeric result") | (F.coalesce("entity", F.lit("")) == ""))
    return s.withColumns(
        {
            "result_type": F.when(numeric, "measurement").when(relation, "comparison_relation").otherwise("scientific_claim"),
            "operations": F.when(numeric, steps).when(relation, F.array(F.lit("evidence_span_extraction"), F.lit("relation_normalization"))).otherwise(F.array(F.lit("evidence_span_extraction"))),
            "difficulty": F.round(F.least(effort, F.lit(1.0)), 4),
            "enrich_mode": F.when(numeric & weak_number, "underspecified_question").when(relation & weak_relation, "underspecified_relation"),
        }
    )


def contract_errors() -> Column:
    """array<string> of what a sample lacks; empty where it is whole."""
    need = lambda name, ok: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    present = [need(f"{n} is required", F.col(n).isNotNull()) for n in ("id", "doc_id", "title", "license", "local_path", "question", "task_type", "unit", "display", "status")]
    rules = [
        need("year must be an integer", F.col("year").isNotNull()),
        need("page_span must be a non-empty list", F.col("page").isNotNull()),
        need("source_hash must be a lowercase SHA-256 hex string", F.col("source_hash").rlike("^[0-9a-f]{64}$")),
        need("value is required", F.col("value_num").isNotNull() | F.col("value_text").isNotNull()),
        need("evidence must be a non-empty list", F.size("evidence") > 0),
        need("acquisition_path must be a non-empty list", F.size("path") > 0),
        need("a passing sample must have evidence_checked", (F.col("status") != "pass") | F.col("evidence_checked")),
        need("split must be train, dev or test", F.col("split").isin("train", "dev", "test")),
    ]
    return F.filter(F.array(*present, *rules), lambda e: e.isNotNull())


def contract(samples: DataFrame) -> DataFrame:
    s = samples.withColumn("contract_errors", contract_errors()).withColumn("contract_mode", F.when(F.size("contract_errors") > 0, "schema_contract_error"))
    return s.withColumn("status", F.when(F.col("contract_mode").isNotNull(), "fail").otherwise(F.col("status")))


def _folded(c: str | Column) -> Column:
    return tx.casefold(tx.text_or_none(F.col(c) if isinstance(c, str) else c))


def _condition_text() -> Column:
    return tx.text_or_none(F.col("condition"))


def context_key() -> Column:
    """The coarsest evidence that can support a conflict: a table row, or a paragraph, supplement or figure."""
    ev = F.get("evidence", 0)
    loc = ev["locator"]
    of_table = F.concat_ws("|", ev["modality"], loc["table_id"], F.coalesce(loc["row_index"].cast("string"), loc["row"]))
    return F.when(ev["modality"] == "table", of_table).otherwise(F.concat_ws("|", ev["modality"], F.coalesce(loc["paragraph_id"], loc["supplement_id"], loc["figure_id"])))


def group_claims(samples: DataFrame) -> DataFrame:
    """Duplicate and conflict groups: equal claims, and claims that differ in value between contexts of one document.

    Both keys start with the document, so each group lies in it, and both are windows that need no other shuffle than one by
    document; samples are neither made twice nor collected. Ids are short hashes, which groups of different documents can share
    at size: groups are counted by doc_id and id."""
    relation = F.col("task_type") == "relation"
    value = F.col("value_text")
    dup = F.when(relation, tx.group_key(F.col("doc_id"), F.lit("relation"), _folded("value_text"), _folded("rel_subject"), _folded("rel_object")))
    dup = dup.otherwise(tx.group_key(F.col("doc_id"), _folded("card_metric"), _folded("card_entity"), value, _folded("unit")))
    clash = tx.group_key(F.col("doc_id"), _folded("card_metric"), _folded("card_entity"), _folded("unit"), tx.casefold(_condition_text()))
    s = samples.withColumns({"_dup": dup, "_clash": clash, "_context": context_key()})
    own = Window.partitionBy("_clash", "doc_id")  # rows sort by hashes, whose first bytes differ
    differ = lambda c: F.coalesce(F.min(c).over(own) != F.max(c).over(own), F.lit(False))
    s = s.withColumns({"_apart": differ("value_text") & differ("_context"), "_first": F.min_by(F.struct("doc_id", "card_metric", "card_entity", "unit", "condition"), "ord").over(own)})
    f = lambda k: F.col(f"_first.{k}")
    s = s.withColumn("conflict_group_id", F.when(F.col("_apart"), F.concat(F.lit("conflict-"), tx.group_hash(f("doc_id"), f("card_metric"), f("card_entity"), f("unit"), f("condition")))))
    many = F.count("*").over(Window.partitionBy("_dup", "doc_id")) > 1
    clashes = F.col("conflict_group_id").isNotNull()
    return s.withColumns(
        {
            "duplicate_group_id": F.concat(F.lit("dup-"), F.substring("_dup", 1, 12)),
            "duplicate_status": F.when(clashes, "conflict").when(many, "cross_evidence_consistent").otherwise("single"),
            "conflict_mode": F.when(clashes, "conflicting_values"),
        }
    ).drop("_dup", "_clash", "_context", "_apart", "_first")


def mark_repeats(samples: DataFrame) -> DataFrame:
    """Later rows of an id fail as ``duplicate_sample``; the first in order stays."""
    nth = F.row_number().over(Window.partitionBy("_id_hash", "id").orderBy("ord"))  # ids begin alike, so that sorting by them is slow
    s = samples.withColumn("_id_hash", F.xxhash64("id")).withColumn("dup_mode", F.when(nth > 1, "duplicate_sample")).drop("_id_hash")
    return s.withColumn("status", F.when(F.col("dup_mode").isNotNull(), "fail").otherwise(F.col("status")))


def settle(samples: DataFrame, order: str = "batch") -> DataFrame:
    """failure_mode, needs_review and bucket. Modes are columns until here, so precedence is one coalesce in either order."""
    unknown = ~known_license(F.col("license"))
    s = samples.withColumn("license_mode", F.when(F.col("verify_mode").isNull() & unknown, "license_unknown"))
    s = s.withColumn("failure_mode", F.coalesce(*PRECEDENCE[order])).withColumn("needs_review", F.col("failure_mode").isNotNull())
    return s.withColumn("bucket", bucket())


def bucket() -> Column:
    return F.when((F.col("status") == "pass") & known_license(F.col("license")) & ~F.col("needs_review"), "gold").otherwise("silver")


def gate_states() -> dict[str, Column]:
    """Five independent gates; the quality gate leaves other gates' failures to them and never passes a rejected sample."""
    mode = F.coalesce("failure_mode", F.lit(""))
    return {
        "quality": (mode.isin(*OWNED) | ~F.col("needs_review")) & (mode != "human_rejected"),
        "verifier": F.col("status") == "pass",
        "license": known_license(F.col("license")),
        "evidence": F.coalesce(F.size("evidence"), F.lit(0)) > 0,
        "acquisition_path": F.coalesce(F.size("path"), F.lit(0)) > 0,
    }


def with_gates(samples: DataFrame) -> DataFrame:
    return samples.withColumns({f"gate_{k}": v for k, v in gate_states().items()})
