"""Miners: documents to candidates, one DataFrame plan for each kind of evidence.

A candidate is a flat row (see CANDIDATE); its order, ``ord``, is (document, stage, place in the stage), as later steps keep
the first of equal rows and Spark keeps no order by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import prose, text as tx, units
from assaykit.sources import package as pk

LOCATOR = "struct<page:int,table_id:string,row:string,row_index:int,col:string,paragraph_id:string,figure_id:string,supplement_id:string,char_start:int,char_end:int,series_index:int,series:string,point_index:int,x:string,y_axis:string>"
EVIDENCE = f"array<struct<modality:string,locator:{LOCATOR},span_text:string>>"
STEP = "struct<step_id:int,action:string,tool:string,args:map<string,string>,output:string,depends_on:array<int>>"
CANDIDATE = {
    "id": "string", "doc_id": "string", "ord": "array<int>", "subject": "string", "task_type": "string", "question": "string", "value_num": "double", "value_text": "string", "unit": "string",
    "display": "string", "uncertainty": "double", "metric": "string", "entity": "string", "rel_subject": "string", "rel_object": "string", "condition": "string", "condition_source": "string",
    "condition_fields": "array<struct<k:string,v:string>>", "evidence": EVIDENCE, "path": f"array<{STEP}>", "page": "int", "section_path": "array<string>", "core": "boolean", "context": "string",
}
# Names of row labels, in order of preference; columns that are never values.
LABELS = (
    "Sample", "sample", "Sample ID", "sample_id", "Cell line", "cell line", "cell_line", "Compound", "compound", "Batch", "batch", "Group", "group", "Specimen", "specimen",
    "Material", "material", "Treatment", "treatment", "Condition", "condition", "Name", "name", "Analyte", "analyte", "hPMTs", "hPMT", "PTM", "ptm", "id",
)
NO_VALUES = ("sample", "compound", "name", "id")
# What a column measures, by the texts in its header; a caption decides only from ``ic50`` on.
COLUMN_METRICS = (
    ("p-value|p value", "p-value"), ("error", "standard error"), ("mean", "mean"), ("ic50", "IC50"), (r"\b(?:temperature|temp)\b", "temperature"), ("pressure", "pressure"),
    (r"\b(?:duration|time)\b", "duration"), ("yield", "yield"), ("purity", "purity"), ("efficien", "efficiency"), ("intensity", "intensity"), ("viability", "cell viability"), ("response", "response"),
)
TIME_SUFFIX = r"(?i)^\s*\d+(?:\.\d+)?\s*(?:ms|s|min|h|day|d)\s*$"
CAPTION_TIME = r"(?i)\b(?:after|for|at|incubated|collected)\s+(\d+(?:\.\d+)?)\s*(ms|s|min|h|day|d)\b"
HEADER_UNIT = r"(?U)(?:\(|/|\s)(%|°?[A-Za-zμµ]+(?:/[A-Za-zμµ]+)?)\)?"


def row_label(row: Column, index: Column) -> Column:
    """The first label that a row has, else its number."""
    values = F.map_from_entries(F.transform(row, lambda c: F.struct(c["name"], c["value"])))
    found = F.filter(F.transform(F.array(*map(F.lit, LABELS)), lambda k: F.try_element_at(values, k)), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(F.get(found, 0), F.concat(F.lit("row "), (index + 1).cast("string")))


def header_unit(column: Column) -> Column:
    return F.regexp_extract(column, HEADER_UNIT, 1)


def column_metric(column: Column, caption: Column) -> Column:
    head = tx.casefold(column)
    both = F.concat_ws(" ", head, tx.casefold(F.coalesce(caption, F.lit(""))))
    out = column
    for pattern, metric in reversed(COLUMN_METRICS[3:]):
        out = F.when(both.rlike(pattern), F.lit(metric)).otherwise(out)
    for pattern, metric in reversed(COLUMN_METRICS):
        out = F.when(head.rlike(pattern), F.lit(metric)).otherwise(out)
    return out


def caption_time(caption: Column) -> Column:
    number, unit = (F.regexp_extract(F.coalesce(caption, F.lit("")), CAPTION_TIME, k) for k in (1, 2))
    return F.when(number != "", F.concat_ws(" ", number, unit))


def header_time(column: Column) -> Column:
    """The part of a header after its first ``/``, where that part is a time."""
    tail = F.substring_index(column, " / ", -1)
    tail = F.when(F.instr(column, " / ") > 0, F.substr(column, F.instr(column, " / ") + 3)).otherwise(tail)
    return F.when((F.instr(column, " / ") > 0) & tail.rlike(TIME_SUFFIX), tail)


def _locator(**fields: Column) -> Column:
    names = [x.split(":")[0] for x in LOCATOR[7:-1].split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(LOCATOR)


def _evidence(modality: str, locator: Column, span: Column) -> Column:
    return F.array(F.struct(F.lit(modality).alias("modality"), locator.alias("locator"), span.alias("span_text"))).cast(EVIDENCE)


def _args(**fields: Column) -> Column:
    parts = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return F.create_map(*parts)


def _step(number: int, action: str, tool: str, args: Column, output: Column) -> Column:
    after = F.array(F.lit(number - 1)) if number > 1 else F.array().cast("array<int>")
    return F.struct(F.lit(number).alias("step_id"), F.lit(action).alias("action"), F.lit(tool).alias("tool"), args.alias("args"), output.cast("string").alias("output"), after.alias("depends_on")).cast(STEP)


def _shape(rows: DataFrame, stage: int, place: list[str], **columns: Column) -> DataFrame:
    """Candidate columns; what is not given is null."""
    base = {"doc_id": F.col("doc_id"), "subject": F.col("subject"), "core": F.lit(True), "ord": F.array(F.col("doc_ordinal"), F.lit(stage), *map(F.col, place))}
    every = base | columns
    return rows.select(*[every.get(n, F.lit(None)).cast(t).alias(n) for n, t in CANDIDATE.items()])


def _ready(docs: DataFrame) -> DataFrame:
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    docs = docs if "doc_ordinal" in docs.columns else docs.withColumn("doc_ordinal", F.lit(0))
    return docs if "subject" in docs.columns else docs.withColumn("subject", F.coalesce(meta("subject"), meta("domain"), F.lit("scientific_data")))


def table_candidates(docs: DataFrame) -> DataFrame:
    """One candidate for each cell that parses as a measurement under its column's unit."""
    return cell_candidates(pk.cells(_ready(docs)))


def cell_candidates(cells: DataFrame) -> DataFrame:
    """The table miner on cells: doc_id, doc_ordinal, subject, ordinal (of the table), table_id, page, caption, column_units,
    row_index, row, col_index, col, raw_value."""
    declared = F.try_element_at("column_units", F.col("col")) if "column_units" in cells.columns else F.lit(None).cast("string")
    c = cells.filter(~F.lower("col").isin(*NO_VALUES))
    c = c.withColumn("default_unit", F.coalesce(F.nullif(declared, F.lit("")), header_unit(F.col("col")))).withColumn("m", units.measurement(F.col("raw_value"), F.col("default_unit"))).filter("m IS NOT NULL")
    c = c.withColumns({"label": row_label(F.col("row"), F.col("row_index")), "shown": F.trim("raw_value"), "metric": column_metric(F.col("col"), F.col("caption")), "head": header_time(F.col("col")), "cap": caption_time(F.col("caption"))})
    condition = F.coalesce("head", "cap")
    fields = F.when(F.col("head").isNull() & F.col("cap").isNotNull(), F.array(F.struct(F.lit("exposure_time_or_duration").alias("k"), F.col("cap").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    at = {"page": F.col("page"), "table_id": F.col("table_id"), "row_index": F.col("row_index"), "col": F.col("col")}
    return _shape(
        c, 0, ["ordinal", "row_index", "col_index"],
        id=tx.candidate_id(F.col("doc_id"), F.col("table_id"), F.col("label"), F.col("col")), task_type=F.lit("numeric_qa"),
        question=F.concat(F.lit("What "), F.col("metric"), F.lit(" was reported for "), F.col("label"), F.coalesce(F.concat(F.lit(" under "), condition), F.lit("")), F.lit("?")),
        value_num=F.col("m.value"), unit=F.col("m.unit"), display=F.col("shown"), uncertainty=F.col("m.uncertainty"), metric=F.col("metric"), entity=F.col("label"), condition=condition,
        condition_source=F.when(F.col("head").isNotNull(), "column_header").when(F.col("cap").isNotNull(), "table_caption"), condition_fields=fields,
        evidence=_evidence("table", _locator(row=F.col("label"), **at), F.col("shown")),
        path=F.array(
            _step(1, "extract_table_cell", "table_parser", _args(row_key=F.col("label"), **at), F.col("shown")),
            _step(2, "parse_measurement", "number_unit_parser", _args(value_from=F.lit(1), default_unit=F.col("default_unit")), F.to_json("m")),
        ),
        page=F.col("page"), section_path=F.col("section_path") if "section_path" in cells.columns else F.lit(None), context=F.col("raw_value"),
        core=~(F.col("metric").isin(*prose.OUTCOMES) & F.col("m.unit").isin(*prose.SETTING_UNITS)),
    )


def _prose(rows: DataFrame, stage: int, modality: str, container: str, key: str, read: str, reader: str) -> DataFrame:
    """Candidates of all measurements of a text: rows have id, page and text."""
    # Exploded at once: a filter on a column of spans would have Spark find them twice.
    r = prose.interpret(rows.select("*", F.posexplode(units.spans(F.col("text"))).alias("n", "span")))
    r = r.withColumn("shown", F.trim(F.expr("substring(text, span.start + 1, span.end - span.start)")))
    here = {key: F.col("id")} | ({"page": F.col("page")} if modality == "text" else {})
    return _shape(
        r, stage, ["ordinal", "n"],
        id=tx.candidate_id(F.col("doc_id"), F.lit(container), F.col("id"), F.concat(F.lit("number-"), F.col("n").cast("string"))), task_type=F.lit("numeric_qa"), question=F.col("question"),
        value_num=F.col("span.value"), unit=F.col("span.unit"), display=F.col("shown"), uncertainty=F.col("span.uncertainty"), metric=F.col("metric"), entity=F.col("entity"),
        condition=F.col("condition"), condition_fields=F.col("fields"),
        evidence=_evidence(modality, _locator(char_start=F.col("span.start"), char_end=F.col("span.end"), **here), F.col("shown")),
        path=F.array(_step(1, read, reader, _args(**here), F.col("text")), _step(2, "extract_number_unit", "number_unit_parser", _args(text_from=F.lit(1), match_index=F.col("n")), F.to_json("span"))),
        page=F.col("page") if modality == "text" else F.lit(0), section_path=F.col("section_path"), core=F.col("core"), context=F.col("text"),
    )


def text_candidates(docs: DataFrame) -> DataFrame:
    return _prose(pk.paragraphs(_ready(docs)), 1, "text", "paragraph", "paragraph_id", "read_text_span", "text_parser")


def relation_candidates(docs: DataFrame) -> DataFrame:
    """The first relation of each paragraph."""
    r = pk.paragraphs(_ready(docs)).filter("id IS NOT NULL").withColumn("r", tx.relation(F.col("text"))).filter("r IS NOT NULL")
    here = {"paragraph_id": F.col("id"), "page": F.col("page")}
    return _shape(
        r, 2, ["ordinal"],
        id=tx.candidate_id(F.col("doc_id"), F.lit("paragraph"), F.col("id"), F.lit("relation")), task_type=F.lit("relation"),
        question=F.concat(F.lit("What relationship is reported between "), F.col("r.subject"), F.lit(" and "), F.col("r.object"), F.lit("?")),
        value_text=F.col("r.value"), unit=F.lit(""), display=F.col("r.value"), rel_subject=F.col("r.subject"), rel_object=F.col("r.object"), condition_fields=F.array(),
        evidence=_evidence("text", _locator(**here), F.col("text")),
        path=F.array(
            _step(1, "read_text_span", "text_parser", _args(**here), F.col("text")),
            _step(2, "extract_relation", "relation_parser", _args(text_from=F.lit(1), relation=F.col("r.value"), subject=F.col("r.subject"), object=F.col("r.object")), F.to_json("r")),
        ),
        page=F.col("page"), section_path=F.col("section_path"), context=F.col("text"),
    )


def supplement_candidates(docs: DataFrame) -> DataFrame:
    rows = pk.supplements(_ready(docs)).withColumn("page", F.lit(0)).filter("coalesce(text, '') <> ''")
    return _prose(rows, 3, "supplement", "supplement", "supplement_id", "read_supplement_text", "supplement_parser")


def figure_text_candidates(docs: DataFrame) -> DataFrame:
    rows = pk.figures(_ready(docs)).withColumn("text", F.coalesce("alt_text", F.lit("")))
    return _prose(rows, 4, "figure", "figure", "figure_id", "read_figure_alt_text", "figure_parser")


def point_candidates(docs: DataFrame) -> DataFrame:
    """Points of figure series, with the axis unit where a point has none."""
    p = pk.points(_ready(docs)).withColumn("m", units.measurement(F.col("y_shown"), F.col("y_axis.unit"))).filter("m IS NOT NULL AND y_shown <> ''")
    x, label = F.nullif(F.col("x_shown"), F.lit("")), tx.casefold(F.col("x_axis.label"))
    metric = column_metric(F.col("y_axis.label"), F.col("caption"))
    condition = F.concat(F.col("x_axis.label"), F.lit("="), x)
    timed = F.col("x_axis.unit").isin(*units.TIME_UNITS) | label.rlike("time|duration|hour|day")
    fields = F.when(x.isNotNull(), F.array(F.when(timed, F.struct(F.lit("exposure_time_or_duration").alias("k"), x.alias("v"))).otherwise(F.struct(F.lit("context").alias("k"), condition.alias("v"))))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    at = {"figure_id": F.col("figure_id"), "series_index": F.col("series_index"), "point_index": F.col("point_index")}
    slot = F.concat(F.lit("series-"), F.col("series_index").cast("string"), F.lit("-point-"), F.col("point_index").cast("string"))
    return _shape(
        p, 5, ["ordinal", "series_index", "point_index"],
        id=tx.candidate_id(F.col("doc_id"), F.lit("figure"), F.col("figure_id"), slot), task_type=F.lit("numeric_qa"),
        question=F.concat(F.lit("What "), metric, F.lit(" was reported for "), F.col("series_name"), F.coalesce(F.concat(F.lit(" at "), x), F.lit("")), F.lit("?")),
        value_num=F.col("m.value"), unit=F.col("m.unit"), display=F.col("y_shown"), uncertainty=F.col("m.uncertainty"), metric=metric, entity=F.col("series_name"), condition=condition,
        condition_source=F.when(x.isNotNull(), "figure_axis"), condition_fields=fields,
        evidence=_evidence("figure", _locator(series=F.col("series_name"), x=F.col("x"), y_axis=F.col("y_axis.label"), **at), F.col("y_shown")),
        path=F.array(
            _step(1, "extract_figure_point", "figure_parser", _args(value_axis=F.lit("y"), **at), F.col("y_shown")),
            _step(2, "parse_measurement", "number_unit_parser", _args(value_from=F.lit(1), default_unit=F.col("y_axis.unit")), F.to_json("m")),
        ),
        page=F.lit(0), section_path=F.col("section_path"), context=F.col("y_shown"), core=~(metric.isin("treatment duration", "treatment concentration", "time", "numeric result") | (metric.isin(*prose.OUTCOMES) & F.col("m.unit").isin(*prose.SETTING_UNITS))),
    )


# Words of sections and texts that the router looks for.
RESULT_SECTIONS = ("result", "finding", "outcome", "efficacy", "cytotoxicity", "activity", "performance", "evaluation", "measurement", "characterization", "analysis", "quantitative", "data", "observations")
METHOD_SECTIONS = ("method", "methodology", "materials and methods", "reagent", "protocol", "statistical", "production", "sample preparation", "experimental section", "fabrication", "synthesis")
RESULT_TEXTS = (
    "ic50", "viability", "yield", "response", "reduction", "increase", "decrease", "higher", "lower", "significant", "efficacy", "fold", "correlated", "accuracy", "error", "performance",
    "measurement", "measured", "temperature", "pressure", "concentration", "duration", "purity", "efficiency", "intensity", "absorbance", "conductivity", "resistance", "modulus", "diameter",
)
STRATEGIES = ("table_only", "full", "result_focused", "multimodal")


def result_paragraph(section_path: Column, text: Column) -> Column:
    """Sections decide where there are any, method words against and result words for; else the words of the text."""
    sections = tx.casefold(F.array_join(F.coalesce(section_path, F.array().cast("array<string>")), " "))
    within = sections.rlike("|".join(RESULT_SECTIONS)) & ~sections.rlike("|".join(METHOD_SECTIONS))
    return F.when(sections != "", within).otherwise(tx.casefold(text).rlike("|".join(RESULT_TEXTS)))


def result_table(section_path: Column) -> Column:
    path = F.coalesce(section_path, F.array().cast("array<string>"))
    return (F.size(path) == 0) | F.exists(path, lambda s: tx.casefold(s).rlike("result|efficacy"))


def _only(rows: DataFrame, verdict: str) -> DataFrame:
    """The rows whose verdict holds. A filter would be moved below the stages of the prose rules, with all of them written out in
    its condition, many times over; a generator stays where it is and reads the column."""
    return rows.select("*", F.explode(F.when(F.col(verdict), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))).alias("_kept")).drop("_kept")


def candidates(docs: DataFrame, strategy: str = "result_focused") -> DataFrame:
    """All candidates of a strategy, in the order of its stages. Filters on sections stand before the miners' output, so
    Catalyst moves them below the expensive parts."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    found = table_candidates(docs)
    if strategy == "table_only":
        return found
    docs, focused = _ready(docs), strategy == "result_focused"
    if focused:
        found = found.filter(result_table(F.col("section_path")))
        docs = docs.withColumn("paragraphs", F.transform("paragraphs", lambda p: F.when(result_paragraph(p["section_path"], p["text"]), p)))
        parts = [pk.paragraphs(docs).filter("id IS NOT NULL")]
    else:
        parts = [pk.paragraphs(docs)]
    texts = _prose(parts[0], 1, "text", "paragraph", "paragraph_id", "read_text_span", "text_parser")
    relations = relation_candidates(docs)
    found = found.unionByName(texts).unionByName(relations).unionByName(supplement_candidates(docs))
    if strategy == "multimodal":
        found = found.unionByName(figure_text_candidates(docs)).unionByName(point_candidates(docs))
    return _only(found, "core") if focused else found


def candidates_by_strategy(docs: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """The candidates of several strategies, each mined once, with ``strategies``: the names of those that have it,
    if any. No filter stands here: below the stages of the prose rules it would have Spark evaluate them many times over."""
    if not strategies or set(strategies) - set(STRATEGIES):
        raise ValueError(f"strategies must be some of {STRATEGIES}")

    def named(found: DataFrame, has: dict[str, Column | bool]) -> DataFrame:
        names = [F.when(F.col("core") & has[s] if s == "result_focused" else F.lit(has[s]), F.lit(s)) for s in strategies if s in has]
        return found.withColumn("strategies", F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"))

    every = {"full": True, "multimodal": True}
    routed = F.get("evidence", 0)["locator"]["paragraph_id"].isNotNull() & result_paragraph(F.col("section_path"), F.col("context"))
    out = named(table_candidates(docs), every | {"table_only": True, "result_focused": result_table(F.col("section_path"))})
    if set(strategies) == {"table_only"}:
        return out
    for miner in (text_candidates, relation_candidates):
        out = out.unionByName(named(miner(docs), every | {"result_focused": routed}))
    out = out.unionByName(named(supplement_candidates(docs), every | {"result_focused": F.lit(True)}))
    if "multimodal" in strategies:
        for miner in (figure_text_candidates, point_candidates):
            out = out.unionByName(named(miner(docs), {"multimodal": True}))
    return out
