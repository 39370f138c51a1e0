"""Scoring samples against expected claims, gate ablation, and contamination cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import text as tx
from assaykit.operators import curate

SEP = "\x1f"
VARIANTS = {
    "all_gates": curate.GATES,
    "without_quality_gate": tuple(g for g in curate.GATES if g != "quality"),
    "without_verifier": tuple(g for g in curate.GATES if g != "verifier"),
    "without_license_gate": tuple(g for g in curate.GATES if g != "license"),
    "without_evidence_path_gate": tuple(g for g in curate.GATES if g not in ("evidence", "acquisition_path")),
}
#: name, mode that the verifier must find
CASES = (
    ("tampered_answer", "answer_mismatch"),
    ("tampered_evidence", "evidence_mismatch"),
    ("missing_evidence", "missing_evidence"),
    ("missing_acquisition_path", "missing_acquisition_path"),
    ("invalid_path_action", "path_execution_error"),
)


def rate(n: Column, d: Column) -> Column:
    """n / d to four places, 0 where d is 0."""
    return F.coalesce(F.round(F.try_divide(n, d), 4), F.lit(0.0))


def _key(*parts: Column) -> Column:
    return F.concat_ws(SEP, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _named(c: str | Column) -> Column:
    return tx.casefold(tx.text_or_none(F.col(c) if isinstance(c, str) else c))


def claim_signature() -> Column:
    """What a sample claims: a cell, a relation, or a number of a paragraph (its value as text)."""
    ev = F.get("evidence", 0)
    loc = ev["locator"]
    cell = _key(F.lit("table"), F.col("task_type"), loc["table_id"], loc["row"], loc["col"])
    triple = _key(F.lit("relation"), loc["paragraph_id"], tx.casefold(F.col("value_text")), tx.casefold(F.col("rel_subject")), tx.casefold(F.col("rel_object")))
    number = _key(F.lit("text_number"), loc["paragraph_id"], F.col("value_text"), F.col("unit"), _named("metric"), _named("entity"))
    return F.when(ev["modality"] == "table", cell).when(F.col("task_type") == "relation", triple).otherwise(number)


def locator_signature() -> Column:
    ev = F.get("evidence", 0)
    loc = ev["locator"]
    place = F.coalesce(loc["paragraph_id"], loc["supplement_id"], loc["figure_id"])
    return F.when(ev["modality"] == "table", _key(F.lit("table"), loc["table_id"], loc["row"], loc["col"])).otherwise(_key(ev["modality"], place))


def expected_signature() -> Column:
    cell = _key(F.lit("table"), F.coalesce("task_type", F.lit("numeric_qa")), F.col("table_id"), F.col("row"), F.col("col"))
    triple = _key(F.lit("relation"), F.col("paragraph_id"), tx.casefold(F.col("value")), tx.casefold(F.col("subject")), tx.casefold(F.col("object")))
    number = _key(F.lit("text_number"), F.col("paragraph_id"), F.col("value"), F.col("unit"), _named("metric"), _named("entity"))
    return F.when(F.col("kind") == "table", cell).when(F.col("kind") == "relation", triple).when(F.col("kind") == "text_number", number)


def expected_locator() -> Column:
    return F.when(F.col("kind") == "table", _key(F.lit("table"), F.col("table_id"), F.col("row"), F.col("col"))).otherwise(_key(F.lit("text"), F.col("paragraph_id")))


def signed(samples: DataFrame) -> DataFrame:
    return samples.withColumns({"sig": claim_signature(), "loc": locator_signature()})


def condition_matches(actual: Column, expected: Column) -> Column:
    return tx.casefold(tx.squeeze(F.coalesce(actual, F.lit("None")))) == tx.casefold(tx.squeeze(expected))


def table_value_matches(value: Column, text: Column, expected: Column) -> Column:
    """Numbers within a millionth, else equal texts."""
    number = expected.try_cast("double")
    close = F.abs(value - number) <= F.greatest(F.lit(1e-9), F.abs(number) * 1e-6)
    return F.when(value.isNotNull() & number.isNotNull(), close).otherwise(F.coalesce(tx.casefold(F.trim(text)) == tx.casefold(F.trim(expected)), F.lit(False)))


def matched(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct claims that are both expected and predicted: doc_id, sig."""
    return expected.select("doc_id", expected_signature().alias("sig")).distinct().join(signed(samples).select("doc_id", "sig").distinct(), ["doc_id", "sig"], "left_semi")


def unmatched(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct predicted claims that nobody expected."""
    return signed(samples).select("doc_id", "sig").distinct().join(expected.select("doc_id", expected_signature().alias("sig")), ["doc_id", "sig"], "left_anti")


#: Measures of a document, and the counts that each takes.
MEASURES = {
    "claims": ("expected_claims", "predicted_claims", "matched_claims"),
    "locators": ("expected_locators", "predicted_locators", "right_locators", "found_locators"),
    "conditions": ("condition_claims", "condition_matches"),
    "table_values": ("table_value_claims", "table_value_matches"),
}


def score_documents(samples: DataFrame, expected: DataFrame, documents: DataFrame | None = None, measures: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """Per document (and whatever other keys ``samples`` carries in ``strategy``): recall, precision, locators, conditions,
    table values. Claims count once, predicted locators as often as predicted.

    A document that has claims only, samples only, or (with ``documents``, column doc_id) neither, has its row too. Samples
    are reduced to narrow rows first; each count is a row of one union, which is summed once. Each of the ``measures`` reads
    the samples once more, so that a caller who needs claims alone mines once; claims are always among them, as they tell
    all documents."""
    if "claims" not in measures or set(measures) - set(MEASURES):
        raise ValueError(f"measures must be claims and others of {tuple(MEASURES)}")
    counts = [c for m in MEASURES if m in measures for c in MEASURES[m]]
    keys = ["strategy", "doc_id"] if "strategy" in samples.columns else ["doc_id"]
    s = signed(samples).select(*keys, "sig", "loc", "condition", "value_num", "value_text", "unit", "metric", "entity", "uncertainty")
    e = expected.withColumns({"sig": expected_signature(), "loc": expected_locator()})
    given = documents.select("doc_id").distinct() if documents is not None else None
    if "strategy" in keys:
        names = F.broadcast(samples.select("strategy").distinct())  # a row for each strategy
        e = e if "strategy" in e.columns else e.crossJoin(names)
        given = given.crossJoin(names) if given is not None else None
    parts = [] if given is None else [given.select(*keys)]

    def both(column: str) -> DataFrame:
        want = e.select(*keys, column, F.lit(1).alias("want"), F.lit(0).alias("had"))
        return want.unionAll(s.select(*keys, column, F.lit(0), F.lit(1))).groupBy(*keys, column).agg(F.max("want").alias("want"), F.sum("had").alias("had"))

    wanted, had = F.col("want") > 0, F.col("had") > 0
    count = lambda c: F.count_if(c)
    parts.append(both("sig").groupBy(*keys).agg(count(wanted).alias("expected_claims"), count(had).alias("predicted_claims"), count(wanted & had).alias("matched_claims")))
    located = both("loc").groupBy(*keys).agg(count(wanted).alias("expected_locators"), F.sum("had").alias("predicted_locators"), F.sum(F.when(wanted, F.col("had")).otherwise(0)).alias("right_locators"), count(wanted & had).alias("found_locators"))
    parts += [located] if "locators" in measures else []
    # Claims that agree in all that is compared are one row with their number.
    stated = e.filter("condition IS NOT NULL").groupBy(*keys, "sig", F.col("condition").alias("want")).agg(F.count("*").alias("n"))
    met = stated.join(s.select(*keys, "sig", F.col("condition").alias("have")), [*keys, "sig"], "left")
    met = met.groupBy(*keys, "sig", "want", "n").agg(F.max(F.coalesce(condition_matches(F.col("have"), F.col("want")), F.lit(False))).alias("ok"))
    met = met.groupBy(*keys).agg(F.sum("n").alias("condition_claims"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("condition_matches"))
    parts += [met] if "conditions" in measures else []
    said = [F.col("value").alias("want"), *[F.col(c).alias(f"want_{c}") for c in ("unit", "metric", "entity", "uncertainty")]]
    cells = e.filter("kind = 'table' AND value IS NOT NULL").groupBy(*keys, "loc", *said).agg(F.count("*").alias("n"))
    agree = table_value_matches(F.col("value_num"), F.col("value_text"), F.col("want"))
    for c in ("unit", "metric", "entity"):
        agree = agree & (F.col(f"want_{c}").isNull() | (tx.casefold(F.trim(F.coalesce(c, F.lit("")))) == tx.casefold(F.trim(F.col(f"want_{c}")))))
    agree = agree & (F.col("want_uncertainty").isNull() | (F.abs(F.col("uncertainty") - F.col("want_uncertainty")) <= 1e-6))
    hit = cells.join(s.drop("sig", "condition"), [*keys, "loc"], "left").groupBy(*keys, *[c for c in cells.columns if c not in keys]).agg(F.max(F.coalesce(agree, F.lit(False))).alias("ok"))
    hit = hit.groupBy(*keys).agg(F.sum("n").alias("table_value_claims"), F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("table_value_matches"))
    parts += [hit] if "table_values" in measures else []
    every = None
    for p in parts:
        row = p.select(*keys, *[(F.col(c) if c in p.columns else F.lit(0)).cast("bigint").alias(c) for c in counts])
        every = row if every is None else every.unionAll(row)
    out = every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    c = F.col
    rates = {
        "claim_recall": rate(c("matched_claims"), c("expected_claims")),
        "claim_precision": rate(c("matched_claims"), c("predicted_claims")),
        "locator_precision": rate(c("right_locators"), c("predicted_locators")),
        "locator_recall": rate(c("found_locators"), c("expected_locators")),
        "condition_match_rate": F.when(c("condition_claims") > 0, rate(c("condition_matches"), c("condition_claims"))),
        "table_value_match_rate": F.when(c("table_value_claims") > 0, rate(c("table_value_matches"), c("table_value_claims"))),
    }
    of = {"claim": "claims", "locator": "locators", "condition": "conditions", "table": "table_values"}
    return out.withColumns({k: v for k, v in rates.items() if of[k.split("_")[0]] in measures})


LEVELS = ("candidates", "gold", "silver")


def count_matches(samples: DataFrame, entries: DataFrame) -> DataFrame:
    """Per document of ``entries`` (doc_id, expected: struct of candidates, gold and silver), and strategy: whether the numbers
    of samples are those expected; null where nothing is expected."""
    keys = ["strategy", "doc_id"] if "strategy" in samples.columns else ["doc_id"]
    actual = samples.groupBy(*keys).agg(F.count("*").alias("candidates"), *[F.count_if(F.col("bucket") == b).alias(b) for b in LEVELS[1:]])
    want = entries.select("doc_id", "expected")
    want = want.crossJoin(F.broadcast(samples.select("strategy").distinct())) if "strategy" in keys else want
    out = want.join(actual, keys, "left").fillna(0, list(LEVELS))
    return out.select(*keys, *[(F.col(f"expected.{x}") == F.col(x)).alias(f"{x}_match") for x in LEVELS])


def count_accuracy(matches: DataFrame) -> DataFrame:
    """The share of documents, of those that expect a number, that have it."""
    keys = ["strategy"] if "strategy" in matches.columns else []
    share = lambda x: F.round(F.avg(F.col(f"{x}_match").cast("int")), 4).alias(f"{x}_accuracy")
    return matches.groupBy(*keys).agg(*map(share, LEVELS))


def score_strategies(per_document: DataFrame) -> DataFrame:
    """Claims pooled over documents; the other rates are means of the documents' rounded rates, weighted by their counts.
    Measures that the documents do not have are left out."""
    keys = ["strategy"] if "strategy" in per_document.columns else []
    c = F.col
    mean = lambda r, n: rate(F.sum(c(r) * c(n)), F.sum(n))
    some = lambda r, n: F.when(F.sum(n) > 0, F.round(F.try_divide(F.sum(F.coalesce(c(r), F.lit(0.0)) * c(n)), F.sum(n)), 4))
    rates = {
        "claim_recall": rate(F.sum("matched_claims"), F.sum("expected_claims")),
        "claim_precision": rate(F.sum("matched_claims"), F.sum("predicted_claims")),
        "locator_precision": mean("locator_precision", "predicted_locators"),
        "locator_recall": mean("locator_recall", "expected_locators"),
        "condition_match_rate": some("condition_match_rate", "condition_claims"),
        "table_value_match_rate": some("table_value_match_rate", "table_value_claims"),
    }
    return per_document.groupBy(*keys).agg(F.count("*").alias("document_count"), *[v.alias(k) for k, v in rates.items() if k in per_document.columns])


def strategy_deltas(by_strategy: DataFrame, base: str = "table_only", measures: tuple[str, ...] = ("claim_recall", "claim_precision")) -> DataFrame:
    """Each strategy's measures less those of ``base``."""
    b = by_strategy.filter(F.col("strategy") == base).select(*[F.col(m).alias(f"_{m}") for m in measures])
    return by_strategy.filter(F.col("strategy") != base).crossJoin(F.broadcast(b)).select("strategy", *[F.round(F.col(m) - F.col(f"_{m}"), 4).alias(f"{m}_delta") for m in measures])


def ablate(samples: DataFrame, expected: DataFrame) -> DataFrame:
    """Per gate variant: what it keeps, and the precision and recall of that. Samples are mined once; variants are a
    five-row dimension of required gates."""
    gates = curate.gate_states()
    s = signed(samples).select("doc_id", "sig", F.array(*[F.when(gates[g], F.lit(g)) for g in curate.GATES]).alias("open"))
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), F.array(*map(F.lit, v)).alias("needs")) for k, v in VARIANTS.items()])
    kept = s.select("doc_id", "sig", "open", F.explode(variants).alias("v")).filter(F.size(F.array_except("v.needs", F.array_compact("open"))) == 0).select("v.variant", "doc_id", "sig")
    want = expected.select("doc_id", expected_signature().alias("sig")).distinct().withColumn("want", F.lit(1))
    total = want.agg(F.count("*").alias("expected"))
    distinct = kept.distinct().join(want, ["doc_id", "sig"], "left")
    by = distinct.groupBy("variant").agg(F.count("*").alias("predicted"), F.count("want").alias("matched"))
    out = kept.groupBy("variant").agg(F.count("*").alias("selected_count")).join(by, "variant")
    names = samples.sparkSession.createDataFrame([(v,) for v in VARIANTS], "variant string")
    out = names.join(out, "variant", "left").fillna(0).crossJoin(F.broadcast(total))
    c = F.col
    out = out.select("variant", "selected_count", "predicted", "matched", rate(c("matched"), c("expected")).alias("claim_recall"), rate(c("matched"), c("predicted")).alias("claim_precision"), (c("predicted") - c("matched")).alias("unmatched_claims"))
    whole = F.max(F.when(c("variant") == "all_gates", c("selected_count"))).over(Window.partitionBy())
    return out.withColumn("selected_delta", c("selected_count") - whole)


def gate_rejections(samples: DataFrame) -> DataFrame:
    gates = curate.gate_states()
    return samples.agg(*[F.count_if(~gates[g]).alias(g) for g in curate.GATES]).unpivot([], list(curate.GATES), "gate", "rejected")


def contaminate(samples: DataFrame) -> DataFrame:
    """One copy for each case, of the first sample in order that suits it and no earlier case has taken.

    Cases are five, so of the samples that suit a case five candidates decide; nothing else is collected."""
    first_number = samples.filter("value_num IS NOT NULL").orderBy("ord").select("ord").limit(1).collect()
    suited = {c: [r["ord"] for r in samples.filter(F.size(c) > 0).orderBy("ord").select("ord").limit(len(CASES)).collect()] for c in ("evidence", "path")}
    taken: list = [first_number[0]["ord"]] if first_number else []
    chosen = {CASES[0][0]: taken[0]} if taken else {}
    for name, _ in CASES[1:]:
        base = next((at for at in suited["evidence" if "evidence" in name else "path"] if at not in taken), None)
        if base is not None:
            taken.append(base)
            chosen[name] = base
    pick = F.lit(None).cast("string")
    for name, at in chosen.items():
        pick = F.when(F.col("ord") == F.array(*map(F.lit, at)), F.lit(name)).otherwise(pick)
    c = samples.withColumn("case", pick).filter("case IS NOT NULL")
    is_case = lambda name: F.col("case") == name
    worse = F.col("value_num") + F.when(F.col("value_num") == 0, 1.0).otherwise(F.abs(F.col("value_num")) * 0.5)
    lost = F.lit("evidence that no source holds")
    return c.withColumns(
        {
            "base_id": F.col("id"),
            "id": F.concat_ws("__", F.col("id"), F.lit("adversarial"), F.col("case")),
            "value_num": F.when(is_case("tampered_answer"), worse).otherwise(F.col("value_num")),
            "evidence": F.when(is_case("tampered_evidence"), F.transform("evidence", lambda e, i: F.when(i == 0, e.withField("span_text", lost)).otherwise(e))).when(is_case("missing_evidence"), F.slice("evidence", 1, 0)).otherwise(F.col("evidence")),
            "path": F.when(is_case("missing_acquisition_path"), F.slice("path", 1, 0)).when(is_case("invalid_path_action"), F.transform("path", lambda p, i: F.when(i == 0, p.withField("action", F.lit("not_allowlisted"))).otherwise(p))).otherwise(F.col("path")),
        }
    )


def adversarial_report(cases: DataFrame) -> DataFrame:
    """Per case (with no base_id where no sample suits it): the mode found, whether the verifier rejects it, and whether it would pass without the verifier."""
    gates = curate.gate_states()
    rest = gates["license"] & gates["evidence"] & gates["acquisition_path"] & gates["quality"]
    expected = F.element_at(F.create_map(*[F.lit(x) for c in CASES for x in c]), F.col("case"))
    found = cases.select("case", "base_id", F.col("failure_mode").alias("observed_mode"), (F.col("status") != "pass").alias("rejected"), rest.alias("selected_without_verifier"))
    names = cases.sparkSession.createDataFrame([(name,) for name, _ in CASES], "case string").withColumn("expected_mode", expected)
    return names.join(found, "case", "left").select("case", "base_id", "expected_mode", "observed_mode", "rejected", "selected_without_verifier")


def adversarial_summary(report: DataFrame) -> DataFrame:
    n = F.count("base_id")
    return report.agg(n.alias("cases"), F.count_if("rejected").alias("rejected"), rate(F.count_if("rejected"), n).alias("rejection_rate"), F.count_if("selected_without_verifier").alias("bypass"), rate(F.count_if("selected_without_verifier"), n).alias("bypass_rate"))
