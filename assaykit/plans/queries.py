"""Registered queries of the engine's operators, and their DuckDB forms.

Each query runs over its whole tables. Oracles state what rendered documents must give, in SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import text as tx, units
from assaykit.operators import curate, literature, mine, publish, review, score
from assaykit.operators.verify import numeric_match, replay, span_holds, verify
from assaykit.plans import render, runs
from assaykit.plans.render import money, table
from assaykit.sources import formats, package as pk, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# SQL that oracles share.
LICENSE = "['CC-BY-4.0', 'MIT', 'unknown', 'CC-BY', 'proprietary', 'public-domain'][(n % 6 + 1)::INT]"
KNOWN = "('CC-BY', 'CC-BY-4.0', 'CC-BY-SA', 'CC-BY-SA-4.0', 'MIT', 'public-domain')"
PARTS = f"""parts AS (
  SELECT p_partkey, p_partkey // 50 AS n, 'parts-' || (p_partkey // 50) AS doc_id,
         (row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1)::INT AS row_index,
         p_name || '#' || p_partkey AS label, p_size::VARCHAR AS mass, p_retailprice::DECIMAL(12,2)::VARCHAR AS price FROM part
), cells AS (
  SELECT n, doc_id, row_index, label, 1 AS col_index, 'Mass (mg)' AS col, mass AS raw_value, 'Mass (mg)' AS metric, 'mg' AS unit FROM parts
  UNION ALL SELECT n, doc_id, row_index, label, 2, 'Pressure (kPa)', price, 'pressure', 'kPa' FROM parts
), s AS (
  SELECT *, 'candidate-' || substr(sha1(doc_id || '|Table 1|' || label || '|' || col), 1, 10) AS id, raw_value::DOUBLE AS value, {LICENSE} AS license FROM cells
)"""
LINES = """lines AS (
  SELECT l_orderkey // 50 AS n, 'orders-' || (l_orderkey // 50) AS doc_id, 'p' || (l_orderkey * 10 + l_linenumber) AS pid, l_partkey, l_orderkey, l_linenumber,
         l_quantity::BIGINT AS q, l_linenumber + 20 AS t,
         'Sample ' || l_partkey || ' achieved a yield of ' || l_quantity::BIGINT || ' %; temperature was ' || (l_linenumber + 20) || ' C.' AS text FROM lineitem
)"""


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return render.part_documents(table(spark, sf, "part"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return render.order_documents(table(spark, sf, "lineitem"))


# Sources and scalar functions


@query("SELECT doc_id, sha256(coalesce(text, '')) AS source_hash, strlen(coalesce(text, ''))::BIGINT AS content_size_bytes FROM documents")
def source_fingerprint(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("source_hash"), F.octet_length(text).cast("bigint").alias("content_size_bytes"))


_SPLIT = "CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 90 THEN 'dev' ELSE 'test' END"


@query(f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def split_assignment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.split_name(F.col("doc_id")).alias("split"))


@query(f"SELECT {_SPLIT} AS split, count(*)::BIGINT AS samples, count(DISTINCT doc_id)::BIGINT AS documents FROM documents GROUP BY 1")
def split_summary(spark, sf):
    return publish.split_summary(table(spark, sf, "documents").withColumn("split", tx.split_name(F.col("doc_id"))))


@query(r"""
WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS doc FROM conversations GROUP BY 1),
b AS (SELECT conv_id, i, list_extract(p, i) AS t FROM (SELECT conv_id, regexp_split_to_array(doc, '\n\s*\n') AS p FROM c) x, unnest(range(1, len(p) + 1)) AS u(i))
SELECT conv_id, 'p' || i AS id, trim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM b
WHERE trim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""")
def text_paragraphs(spark, sf):
    turns = table(spark, sf, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    docs = turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    return docs.select("conv_id", F.explode(readers.paragraphs_of_text()).alias("p")).select("conv_id", "p.*")


@query()
def html_blocks(spark, sf):
    """Title and blocks of every page; held against the parser in tests, as SQL has none."""
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    docs = readers.parse_documents(pages)
    return docs.select("path", "title", F.size("paragraphs").alias("n_blocks"), F.size("tables").alias("n_tables"), F.sha2(F.to_json("paragraphs"), 256).alias("blocks_sha256"))


_LABEL = """CASE WHEN lower(text) LIKE '%cc0%' OR lower(text) LIKE '%public domain%' THEN 'public-domain'
 WHEN lower(text) LIKE '%creative commons attribution-noncommercial-sharealike%' OR lower(text) LIKE '%cc by-nc-sa%' THEN 'CC-BY-NC-SA'
 WHEN lower(text) LIKE '%creative commons attribution-noncommercial%' OR lower(text) LIKE '%cc by-nc%' THEN 'CC-BY-NC'
 WHEN lower(text) LIKE '%creative commons attribution-sharealike%' OR lower(text) LIKE '%cc by-sa%' THEN 'CC-BY-SA-4.0'
 WHEN lower(text) LIKE '%creative commons attribution%' OR lower(text) LIKE '%cc by%' THEN 'CC-BY-4.0' ELSE 'unknown' END"""


@query(f"SELECT doc_id, {_LABEL} AS license FROM documents")
def license_normalized(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.license_label(F.col("text")).alias("license"))


@query(f"SELECT license, license IN {KNOWN} AS known, count(*)::BIGINT AS n FROM (SELECT {_LABEL} AS license FROM documents) GROUP BY ALL")
def license_gate(spark, sf):
    return license_normalized(spark, sf).groupBy("license", tx.known_license(F.col("license")).alias("known")).agg(F.count("*").alias("n"))


_NUMBERS = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || ' mg' WHEN 1 THEN p_retailprice::DECIMAL(12,2) || ' ± ' || p_size || ' kPa' WHEN 2 THEN p_size::VARCHAR WHEN 3 THEN p_size || ' parsec' ELSE p_size || '.5e-3 mol/L' END AS raw FROM part"


def _raw(spark, sf):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(size, F.lit(" mg"))).when(k == 1, F.concat(money("p_retailprice"), F.lit(" ± "), size, F.lit(" kPa"))).when(k == 2, size).when(k == 3, F.concat(size, F.lit(" parsec"))).otherwise(F.concat(size, F.lit(".5e-3 mol/L")))
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw"))


@query(rf"""
WITH r AS ({_NUMBERS})
SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN NULL ELSE regexp_extract(raw, '^[0-9.]+(?:e-3)?')::DOUBLE END AS value,
       CASE p_partkey % 5 WHEN 0 THEN 'mg' WHEN 1 THEN 'kPa' WHEN 2 THEN 'g' WHEN 4 THEN 'mol/L' END AS unit,
       CASE WHEN p_partkey % 5 = 1 THEN regexp_extract(raw, '± ([0-9]+)', 1)::DOUBLE END AS uncertainty FROM r""")
def measurement_parse(spark, sf):
    m = _raw(spark, sf).withColumn("m", units.measurement(F.col("raw"), F.lit("g")))
    return m.select("p_partkey", "m.value", "m.unit", "m.uncertainty")


@query(rf"""
WITH r AS ({_NUMBERS})
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 2, 4) THEN regexp_extract(raw, '^[0-9.]+(?:e-3)?')::DOUBLE END AS value,
       CASE p_partkey % 5 WHEN 0 THEN 'mg' WHEN 2 THEN '' WHEN 4 THEN 'mol/L' END AS unit FROM r""")
def number_unit_parse(spark, sf):
    m = _raw(spark, sf).withColumn("m", units.number_unit(F.col("raw")))
    return m.select("p_partkey", "m.value", "m.unit")


_CONVERSIONS = (("mg", "g"), ("nM", "uM"), ("h", "min"), ("C", "K"), ("K", "°C"), ("kPa", "bar"), ("eV", "J"), ("mg", "s"), ("μm", "mm"))
_FACTORS = ", ".join(f"('{a}', '{b}', {v})" for (a, b), v in zip(_CONVERSIONS, ("1e-3 / 1", "1e-9 / 1e-6", "3600.0 / 60", "1", "1", "1e3 / 1e5", "NULL", "NULL", "1e-6 / 1e-3"), strict=True))


@query(f"""
WITH c(a, b, f) AS (VALUES {_FACTORS})
SELECT p_partkey, a AS unit, b AS target, CASE WHEN a = 'C' THEN p_size + 273.15 WHEN a = 'K' THEN p_size - 273.15 ELSE round(p_size * f::DOUBLE, 12) END AS converted
FROM part, c""")
def unit_convert(spark, sf):
    pairs = F.array(*[F.struct(F.lit(a).alias("unit"), F.lit(b).alias("target")) for a, b in _CONVERSIONS])
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.explode(pairs).alias("c"))
    return p.select("p_partkey", "c.unit", "c.target", F.round(units.convert(F.col("v"), F.col("c.unit"), F.col("c.target")), 12).alias("converted"))


@query("""
SELECT o_orderkey, CASE WHEN x = 0 THEN '0.0' ELSE x::VARCHAR END AS shown FROM (SELECT o_orderkey, o_totalprice * [1e-9, 1e-5, 1e-3, 1, 1e4, 1e9][(o_orderkey % 6 + 1)::INT] AS x FROM orders)""")
def float_text(spark, sf):
    scale = F.element_at(F.array(*map(F.lit, (1e-9, 1e-5, 1e-3, 1.0, 1e4, 1e9))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", tx.float_text(F.col("o_totalprice") * scale).alias("shown"))


@query("""
SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(replace(translate(lower(coalesce(text, '')), 'µ', 'μ'), 'ß', 'ss'), '[a-z0-9μ%]+'), lambda x: length(x) > 1)))::BIGINT AS n_tokens FROM documents""")
def search_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.tokens(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_tokens"))


# Tables


@query(f"WITH {PARTS} SELECT doc_id, row_index, col_index, col, raw_value, label FROM s")
def table_cells(spark, sf):
    c = pk.cells(_parts(spark, sf)).filter("col <> 'Sample'")
    return c.select("doc_id", "row_index", "col_index", "col", "raw_value", mine.row_label(F.col("row"), F.col("row_index")).alias("label"))


@query("""
WITH h(col, caption) AS (VALUES ('IC50 (uM) / 24 h', ''), ('Mean / Hs27', 'IC50 values'), ('Standard Error', ''), ('p-Value', ''), ('Value', 'IC50 after 48 h'), ('Temp (°C)', ''), ('Yield %', 'x'), ('Other thing', 'none'), ('Result', 'collected 2 day later'))
SELECT r_regionkey, col, caption,
  CASE col WHEN 'IC50 (uM) / 24 h' THEN 'IC50' WHEN 'Mean / Hs27' THEN 'mean' WHEN 'Standard Error' THEN 'standard error' WHEN 'p-Value' THEN 'p-value' WHEN 'Value' THEN 'IC50' WHEN 'Temp (°C)' THEN 'temperature' WHEN 'Yield %' THEN 'yield' ELSE col END AS metric,
  CASE col WHEN 'IC50 (uM) / 24 h' THEN 'uM' WHEN 'Mean / Hs27' THEN 'Hs' WHEN 'Standard Error' THEN 'Error' WHEN 'Temp (°C)' THEN '°C' WHEN 'Yield %' THEN '%' WHEN 'Other thing' THEN 'thing' ELSE '' END AS unit,
  CASE col WHEN 'IC50 (uM) / 24 h' THEN '24 h' WHEN 'Value' THEN '48 h' WHEN 'Result' THEN '2 day' END AS condition
FROM region, h""")
def column_semantics(spark, sf):
    heads = (("IC50 (uM) / 24 h", ""), ("Mean / Hs27", "IC50 values"), ("Standard Error", ""), ("p-Value", ""), ("Value", "IC50 after 48 h"), ("Temp (°C)", ""), ("Yield %", "x"), ("Other thing", "none"), ("Result", "collected 2 day later"))
    h = F.explode(F.array(*[F.struct(F.lit(a).alias("col"), F.lit(b).alias("caption")) for a, b in heads]))
    r = table(spark, sf, "region").select("r_regionkey", h.alias("h")).select("r_regionkey", "h.*")
    c, cap = F.col("col"), F.col("caption")
    return r.select("r_regionkey", "col", "caption", mine.column_metric(c, cap).alias("metric"), mine.header_unit(c).alias("unit"), F.coalesce(mine.header_time(c), mine.caption_time(cap)).alias("condition"))


@query(f"""WITH {PARTS} SELECT id, doc_id, metric, value AS value_num, unit, label AS entity, '24 h' AS condition,
  'What ' || metric || ' was reported for ' || label || ' under 24 h?' AS question FROM s""")
def table_candidates(spark, sf):
    return mine.table_candidates(_parts(spark, sf)).select("id", "doc_id", "metric", "value_num", "unit", "entity", "condition", "question")


# Prose, relations, figures


@query(f"""WITH {LINES}
SELECT doc_id, pid AS id, 0 AS n, (length('Sample ' || l_partkey || ' achieved a yield of '))::INT AS start, (length('Sample ' || l_partkey || ' achieved a yield of ' || q || ' %'))::INT AS "end", q::DOUBLE AS value, '%' AS unit FROM lines
UNION ALL SELECT doc_id, pid, 1, (length('Sample ' || l_partkey || ' achieved a yield of ' || q || ' %; temperature was '))::INT, length(text)::INT - 1, t::DOUBLE, 'C' FROM lines""")
def text_measurements(spark, sf):
    p = pk.paragraphs(_orders(spark, sf)).select("doc_id", "id", F.posexplode(units.spans(F.col("text"))).alias("n", "m"))
    return p.select("doc_id", "id", "n", "m.start", "m.end", "m.value", "m.unit")


@query(f"""WITH {LINES}, two AS (
  SELECT *, 0 AS k, 'yield' AS metric, q::DOUBLE AS value_num, 'sample_or_entity=Sample ' || l_partkey || '; temperature=' || t || ' C' AS condition FROM lines
  UNION ALL SELECT *, 1, 'temperature', t::DOUBLE, 'sample_or_entity=Sample ' || l_partkey FROM lines)
SELECT 'candidate-' || substr(sha1(doc_id || '|paragraph|' || pid || '|number-' || k), 1, 10) AS id, metric, value_num, 'Sample ' || l_partkey AS entity, condition, 'What ' || metric || ' was reported for Sample ' || l_partkey || '?' AS question FROM two""")
def prose_candidates(spark, sf):
    return mine.text_candidates(_orders(spark, sf)).select("id", "metric", "value_num", "entity", "condition", "question")


@query("""
SELECT c_custkey, ['increased', 'higher', 'reduced', 'improved'][(c_custkey % 4 + 1)::INT] AS value, 'Customer ' || c_custkey || ' showed' AS subject, 'demand in nation ' || c_nationkey || ' than before' AS object FROM customer""".replace(" || ' showed' AS", " AS"))
def relation_triples(spark, sf):
    r = table(spark, sf, "customer").select("c_custkey", tx.relation(render.relation_sentence()).alias("r"))
    return r.select("c_custkey", "r.value", "r.subject", "r.object")


_TERMS = "ic50|viability|yield|response|reduction|increase|decrease|higher|lower|significant|efficacy|fold|correlated|accuracy|error|performance|measurement|measured|temperature|pressure|concentration|duration|purity|efficiency|intensity|absorbance|conductivity|resistance|modulus|diameter"


@query(f"SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{_TERMS}') AS routed FROM documents")
def result_router(spark, sf):
    none = F.array().cast("array<string>")
    return table(spark, sf, "documents").select("doc_id", mine.result_paragraph(none, F.coalesce("text", F.lit(""))).alias("routed"))


@query("""
WITH e AS (SELECT user_id, event_type, event_id, round(value, 2)::DECIMAL(12,2) AS y, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id, round(value, 2)) - 1 AS i,
  dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS s FROM events)
SELECT 'candidate-' || substr(sha1('user-' || user_id || '|figure|fig1|series-' || s || '-point-' || i), 1, 10) AS id, y::DOUBLE AS value_num, '%' AS unit, event_type AS entity, 'time=' || event_id || ' h' AS condition FROM e""")
def figure_points(spark, sf):
    return mine.point_candidates(render.event_documents(table(spark, sf, "events"))).select("id", "value_num", "unit", "entity", "condition")


@query(f"""WITH {PARTS}, {LINES} SELECT 'table_only' AS strategy, (SELECT count(*) FROM s)::BIGINT AS candidates UNION ALL
SELECT k, ((SELECT count(*) FROM s) + 2 * (SELECT count(*) FROM lines))::BIGINT FROM (VALUES ('full'), ('result_focused')) v(k)""")
def strategy_counts(spark, sf):
    docs = _parts(spark, sf).unionByName(_orders(spark, sf))
    names = ("table_only", "full", "result_focused")
    found = mine.candidates_by_strategy(docs, names)
    counts = found.agg(*[F.count_if(F.array_contains("strategies", s)).alias(s) for s in names])
    return counts.unpivot([], list(names), "strategy", "candidates")


# Verification


@query(f"WITH {PARTS} SELECT metric, 'pass' AS status, count(*)::BIGINT AS n FROM s GROUP BY 1")
def replay_verify(spark, sf):
    docs = _parts(spark, sf)
    return verify(mine.table_candidates(docs), docs).groupBy("metric", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS}, x AS (SELECT *, row_number() OVER (ORDER BY id, doc_id, row_index) AS r, row_index % 4 AS t FROM s)
SELECT CASE t WHEN 0 THEN NULL WHEN 1 THEN 'answer_mismatch' WHEN 2 THEN 'evidence_mismatch' ELSE 'path_execution_error' END AS mode, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def replay_tampered(spark, sf):
    docs = _parts(spark, sf)
    c = mine.table_candidates(docs)
    t = F.get("evidence", 0)["locator"]["row_index"] % 4
    c = c.withColumn("value_num", F.when(t == 1, F.col("value_num") * 1.5 + 1).otherwise(F.col("value_num")))
    c = c.withColumn("evidence", F.when(t == 2, F.transform("evidence", lambda e: e.withField("span_text", F.lit("nothing")))).otherwise(F.col("evidence")))
    c = c.withColumn("path", F.when(t == 3, F.transform("path", lambda p: p.withField("action", F.lit("guess")))).otherwise(F.col("path")))
    return verify(c, docs).groupBy(F.col("verify_mode").alias("mode")).agg(F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - l_extendedprice * (1 + l_discount / 2)) <= 0.02 * abs(l_extendedprice * (1 + l_discount / 2)) AS same FROM lineitem""")
def tolerance_match(spark, sf):
    price, other = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_discount") / 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numeric_match(price, F.lit("kPa"), other, F.lit("kPa")).alias("same"))


@query(f"""WITH {LINES} SELECT doc_id, pid, l_partkey, true AS exact, q = t AS moved, true AS anywhere FROM lines""".replace("q = t AS moved", "false AS moved"))
def span_check(spark, sf):
    n = F.length(F.concat(F.lit("Sample "), F.col("l_partkey").cast("string"), F.lit(" achieved a yield of ")))
    shown = F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" %"))
    r = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", render.sentence().alias("text"), n.alias("a"), (n + F.length(shown)).alias("b"), shown.alias("shown"))
    none = F.lit(None).cast("int")
    held = {"exact": span_holds(F.col("text"), F.col("shown"), F.col("a"), F.col("b")), "moved": span_holds(F.col("text"), F.col("shown"), F.col("a") + 2, F.col("b") + 2), "anywhere": span_holds(F.col("text"), F.col("shown"), none, none)}
    return r.select(F.concat(F.lit("orders-"), F.floor(F.col("l_orderkey") / 50).cast("string")).alias("doc_id"), F.concat(F.lit("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).alias("pid"), "l_partkey", *[v.alias(k) for k, v in held.items()])


@query(f"""WITH {PARTS} SELECT a.id, round(a.value * 1000 / 2 + 1, 6) AS replay_value, 'μg' AS replay_unit FROM s a WHERE col_index = 1""")
def arith_replay(spark, sf):
    """Paths of four steps: read a cell, parse it, convert it, compute with it."""
    docs = _parts(spark, sf)
    c = mine.table_candidates(docs).filter("unit = 'mg'")
    step = lambda n, action, args, after: F.struct(F.lit(n).alias("step_id"), F.lit(action).alias("action"), F.lit("").alias("tool"), args.alias("args"), F.lit(None).cast("string").alias("output"), F.array(F.lit(after)).alias("depends_on")).cast(mine.STEP)
    more = F.array(step(3, "unit_convert", F.create_map(F.lit("value_from"), F.lit("2"), F.lit("to"), F.lit("μg")), 2), step(4, "arith_eval", F.create_map(F.lit("expression"), F.lit("$3 / 2 + 1"), F.lit("unit"), F.lit("μg")), 3))
    out = replay(c.withColumn("path", F.concat("path", more)), docs)
    return out.select("id", F.round("replay_value", 6).alias("replay_value"), "replay_unit")


# Curation


@query(f"""WITH {PARTS} SELECT metric, CASE WHEN license IN {KNOWN} THEN 'gold' ELSE 'silver' END AS bucket, count(*)::BIGINT AS n FROM s GROUP BY ALL""")
def gold_counts(spark, sf):
    """The flagship: rendered tables mined, replayed, curated and gated."""
    return runs.run_documents(_parts(spark, sf)).groupBy(F.col("card_metric").alias("metric"), "bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS} SELECT license IN {KNOWN} AS license, true AS quality, true AS verifier, true AS evidence, true AS acquisition_path, count(*)::BIGINT AS n FROM s GROUP BY 1""")
def gate_states(spark, sf):
    s = runs.run_documents(_parts(spark, sf))
    gates = curate.gate_states()
    return s.groupBy(*[gates[g].alias(g) for g in curate.GATES]).agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS} SELECT row_index % 3 AS broken, CASE row_index % 3 WHEN 0 THEN '' WHEN 1 THEN 'source_hash must be a lowercase SHA-256 hex string' ELSE 'title is required; year must be an integer' END AS errors, count(*)::BIGINT AS n FROM s GROUP BY ALL""")
def contract_errors(spark, sf):
    docs = _parts(spark, sf)
    s = verify(curate.to_samples(mine.table_candidates(docs), docs), docs)
    k = F.get("evidence", 0)["locator"]["row_index"] % 3
    s = s.withColumns({"broken": k, "source_hash": F.when(k == 1, "ABC").otherwise(F.col("source_hash")), "title": F.when(k != 2, F.col("title")), "year": F.when(k != 2, F.col("year"))})
    return s.groupBy("broken", F.array_join(curate.contract_errors(), "; ").alias("errors")).agg(F.count("*").alias("n"))


_CLAIMS = f"""{LINES}, two AS (
  SELECT doc_id, pid, l_partkey, 0 AS k, 'yield' AS metric, q::DOUBLE AS value, '%' AS unit, 'sample_or_entity=sample ' || l_partkey || '; temperature=' || t || ' c' AS cond FROM lines
  UNION ALL SELECT doc_id, pid, l_partkey, 1, 'temperature', t::DOUBLE, 'C', 'sample_or_entity=sample ' || l_partkey FROM lines
)"""


@query(f"""WITH {_CLAIMS}, g AS (SELECT doc_id, metric, l_partkey, value, count(*) AS c FROM two GROUP BY ALL)
SELECT metric, count(*)::BIGINT AS groups, sum(c)::BIGINT AS members FROM g WHERE c > 1 GROUP BY 1""")
def duplicate_groups(spark, sf):
    docs = _orders(spark, sf)
    s = curate.group_claims(curate.to_samples(mine.text_candidates(docs), docs))
    g = s.groupBy("doc_id", "card_metric", "duplicate_group_id").agg(F.count("*").alias("c")).filter("c > 1")
    return g.groupBy(F.col("card_metric").alias("metric")).agg(F.count("*").alias("groups"), F.sum("c").alias("members"))


@query(f"""WITH {_CLAIMS}, g AS (SELECT doc_id, metric, l_partkey, cond, count(*) AS c, count(DISTINCT value) AS v, count(DISTINCT pid) AS p FROM two GROUP BY ALL)
SELECT metric, count(*)::BIGINT AS groups, sum(c)::BIGINT AS members FROM g WHERE v > 1 AND p > 1 GROUP BY 1""")
def conflict_groups(spark, sf):
    docs = _orders(spark, sf)
    s = curate.group_claims(curate.to_samples(mine.text_candidates(docs), docs)).filter("conflict_group_id IS NOT NULL")
    return s.groupBy(F.col("card_metric").alias("metric")).agg(F.count_distinct("doc_id", "conflict_group_id").alias("groups"), F.count("*").alias("members"))


@query(f"""WITH {_CLAIMS}, i AS (SELECT 'candidate-' || substr(sha1(doc_id || '|paragraph|' || pid || '|number-' || k), 1, 10) AS id, count(*)::BIGINT AS n FROM two GROUP BY 1) SELECT id, n FROM i WHERE n > 1""")
def duplicate_ids(spark, sf):
    return publish.duplicate_ids(mine.text_candidates(_orders(spark, sf)))


_MODES = f"""{_CLAIMS}, x AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, pid, k ORDER BY l_partkey) AS nth FROM two
), y AS (
  SELECT x.*, (x.doc_id, metric, l_partkey, cond) IN (SELECT (doc_id, metric, l_partkey, cond) FROM two GROUP BY doc_id, metric, l_partkey, cond HAVING count(DISTINCT value) > 1 AND count(DISTINCT pid) > 1) AS clash,
         regexp_extract(doc_id, '[0-9]+')::BIGINT AS n FROM x
), z AS (SELECT *, {LICENSE} AS license FROM y)"""


@query()
def failure_modes(spark, sf):
    """Which of equal ids is first decides, and rows of one paragraph id keep no order in SQL: rows only."""
    return publish.failure_modes(runs.run_documents(_orders(spark, sf)))


@query(f"""WITH {PARTS}, m AS (
  SELECT 'domain' AS facet, 'rendered' AS value FROM s UNION ALL SELECT 'metric', metric FROM s UNION ALL SELECT 'license', license FROM s UNION ALL SELECT 'modality', 'table' FROM s
  UNION ALL SELECT 'quality', CASE WHEN license IN {KNOWN} THEN 'gold' ELSE 'silver' END FROM s UNION ALL SELECT 'failure_mode', 'license_unknown' FROM s WHERE license NOT IN {KNOWN})
SELECT facet, value, count(*)::BIGINT AS n FROM m GROUP BY ALL""")
def data_card(spark, sf):
    return publish.data_card(runs.run_documents(_parts(spark, sf)))


@query(f"""WITH {PARTS}, c AS (SELECT count(DISTINCT doc_id) AS documents, count(*) AS candidates, count_if(license IN {KNOWN}) AS gold FROM s)
SELECT documents::BIGINT AS documents, candidates::BIGINT AS candidates, gold::BIGINT AS gold, (candidates - gold)::BIGINT AS silver, (candidates - gold)::BIGINT AS human_review,
  1.0::DOUBLE AS path_reproducibility, 1.0::DOUBLE AS evidence_coverage, round(gold / candidates, 4)::DOUBLE AS license_coverage, 0::BIGINT AS duplicate_groups, 0::BIGINT AS conflict_groups, 0::BIGINT AS conflict_claims FROM c""")
def run_summary(spark, sf):
    return publish.run_summary(runs.run_documents(_parts(spark, sf)))


@query(f"""WITH {PARTS} SELECT id AS sample_id, doc_id, metric, label AS entity, unit, raw_value AS display, 'explicit' AS condition_status, 'pass' AS verification_status,
  CASE WHEN license IN {KNOWN} THEN 'gold' ELSE 'silver' END AS quality_level FROM s""")
def result_cards(spark, sf):
    cards = publish.result_cards(runs.run_documents(_parts(spark, sf)))
    return cards.select("sample_id", "doc_id", "metric", "entity", "unit", "display", "condition_status", "verification_status", "quality_level")


# Scoring


def _expected(spark, sf, wrong: bool = True):
    """Claims on every second part: masses, of which each tenth is wrong, and rows that no table has."""
    p = table(spark, sf, "part").filter("p_partkey % 2 = 0")
    row = F.when(F.col("p_partkey") % 20 == 0, F.lit("nowhere")).otherwise(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")))
    value = F.when(F.col("p_partkey") % 14 == 0, (F.col("p_size") + 1).cast("string")).otherwise(F.col("p_size").cast("string"))
    none = F.lit(None).cast("string")
    return p.select(
        F.concat(F.lit("parts-"), F.floor(F.col("p_partkey") / 50).cast("string")).alias("doc_id"), F.lit("table").alias("kind"), F.lit("Table 1").alias("table_id"), row.alias("row"), F.lit("Mass (mg)").alias("col"), none.alias("task_type"),
        F.when(F.col("p_partkey") % 6 == 0, "48 h").otherwise("24 h").alias("condition"), value.alias("value"), F.lit(None).cast("double").alias("uncertainty"), F.lit("mg").alias("unit"), none.alias("metric"), none.alias("entity"), none.alias("paragraph_id"), none.alias("subject"), none.alias("object"),
    )


_EXPECTED = f"""{PARTS}, e AS (
  SELECT 'parts-' || (p_partkey // 50) AS doc_id, p_partkey AS k, CASE WHEN p_partkey % 20 = 0 THEN 'nowhere' ELSE p_name || '#' || p_partkey END AS label,
         p_partkey % 14 = 0 AS wrong, p_partkey % 6 = 0 AS other, p_partkey % 20 <> 0 AS found FROM part WHERE p_partkey % 2 = 0)"""


@query(f"""WITH {_EXPECTED}, p AS (SELECT doc_id, count(*) AS predicted FROM s GROUP BY 1),
d AS (SELECT doc_id, count(DISTINCT label) AS expected, count(DISTINCT label) FILTER (found) AS matched, count(*) AS stated, count_if(found AND NOT other) AS met, count_if(found AND NOT wrong) AS valued FROM e GROUP BY 1)
SELECT doc_id, expected::BIGINT AS expected_claims, predicted::BIGINT AS predicted_claims, matched::BIGINT AS matched_claims, round(matched / expected, 4)::DOUBLE AS claim_recall, round(matched / predicted, 4)::DOUBLE AS claim_precision,
  round(matched / predicted, 4)::DOUBLE AS locator_precision, round(matched / expected, 4)::DOUBLE AS locator_recall, round(met / stated, 4)::DOUBLE AS condition_match_rate, round(valued / stated, 4)::DOUBLE AS table_value_match_rate
FROM d JOIN p USING (doc_id)""")
def claim_scoring(spark, sf):
    s = curate.to_samples(mine.table_candidates(_parts(spark, sf)), _parts(spark, sf))
    out = score.score_documents(s, _expected(spark, sf))
    return out.select("doc_id", "expected_claims", "predicted_claims", "matched_claims", "claim_recall", "claim_precision", "locator_precision", "locator_recall", "condition_match_rate", "table_value_match_rate")


@query(f"""WITH {_EXPECTED}, p AS (SELECT doc_id, count(*) AS predicted FROM s GROUP BY 1), d AS (SELECT doc_id, count(DISTINCT label) AS expected, count(DISTINCT label) FILTER (found) AS matched FROM e GROUP BY 1)
SELECT count(*)::BIGINT AS document_count, round(sum(matched) / sum(expected), 4)::DOUBLE AS claim_recall, round(sum(matched) / sum(predicted), 4)::DOUBLE AS claim_precision FROM d JOIN p USING (doc_id)""")
def strategy_rollup(spark, sf):
    s = curate.to_samples(mine.table_candidates(_parts(spark, sf)), _parts(spark, sf))
    return score.score_strategies(score.score_documents(s, _expected(spark, sf))).select("document_count", "claim_recall", "claim_precision")


@query(f"""WITH {_EXPECTED} SELECT doc_id, count(*)::BIGINT AS unmatched FROM s WHERE col_index = 2 OR (doc_id, label) NOT IN (SELECT (doc_id, label) FROM e) GROUP BY 1""")
def unmatched_claims(spark, sf):
    s = curate.to_samples(mine.table_candidates(_parts(spark, sf)), _parts(spark, sf))
    return score.unmatched(s, _expected(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("unmatched"))


@query(f"""WITH {_EXPECTED}, v(variant, free) AS (VALUES ('all_gates', false), ('without_quality_gate', false), ('without_verifier', false), ('without_license_gate', true), ('without_evidence_path_gate', false)),
k AS (SELECT variant, doc_id, label, col FROM v, s WHERE free OR license IN {KNOWN}),
w AS (SELECT DISTINCT doc_id, label, 'Mass (mg)' AS col, 1 AS want FROM e)
SELECT variant, count(*)::BIGINT AS selected_count, count(want)::BIGINT AS matched, round(count(want) / (SELECT count(*) FROM w), 4)::DOUBLE AS claim_recall, round(count(want) / count(*), 4)::DOUBLE AS claim_precision
FROM k LEFT JOIN w USING (doc_id, label, col) GROUP BY 1""")
def ablation(spark, sf):
    s = runs.run_documents(_parts(spark, sf))
    return score.ablate(s, _expected(spark, sf)).select("variant", "selected_count", "matched", "claim_recall", "claim_precision")


@query("SELECT * FROM (VALUES ('tampered_answer', 'answer_mismatch', true), ('tampered_evidence', 'evidence_mismatch', true), ('missing_evidence', 'missing_evidence', true), ('missing_acquisition_path', 'missing_acquisition_path', true), ('invalid_path_action', 'path_execution_error', true)) t(\"case\", observed_mode, rejected)")
def adversarial_report(spark, sf):
    docs = _parts(spark, sf)
    return runs.contamination(runs.run_documents(docs), docs).select("case", "observed_mode", "rejected")


# Review, search, literature


@query(f"""WITH {PARTS}, q AS (SELECT id, doc_id FROM s WHERE license NOT IN {KNOWN})
SELECT row_number() OVER (ORDER BY encode(doc_id), encode(id)) AS rank, id AS sample_id, doc_id, 'license_unknown' AS failure_mode, 60 AS priority FROM q""")
def review_queue(spark, sf):
    return review.queue(runs.run_documents(_parts(spark, sf))).select(F.col("rank").cast("bigint").alias("rank"), "sample_id", "doc_id", "failure_mode", "priority")


def _decisions(spark, sf):
    """Decisions on every sample of a part by its events: the last event of the part's number decides."""
    e = table(spark, sf, "events").select("event_id", F.pmod("user_id", F.lit(50)).cast("int").alias("row_index"), F.pmod("event_id", F.lit(3)).alias("d"))
    return e.select("row_index", F.col("event_id").alias("seq"), F.element_at(F.array(F.lit("accept"), F.lit("reject"), F.lit("modify")), (F.col("d") + 1).cast("int")).alias("decision"))


@query(f"""WITH {PARTS}, l AS (SELECT user_id % 50 AS row_index, arg_max(event_id % 3, event_id) AS d FROM events GROUP BY 1)
SELECT CASE WHEN d = 1 THEN 'rejected' WHEN d = 2 AND col_index = 1 THEN 'silver' WHEN license IN {KNOWN} THEN 'gold' ELSE 'silver' END AS bucket,
  CASE d WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'modify' END AS review_decision, CASE WHEN d = 2 AND col_index = 1 THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN d = 1 THEN 'human_rejected' WHEN d = 2 AND col_index = 1 THEN 'answer_mismatch' WHEN license NOT IN {KNOWN} THEN 'license_unknown' END AS failure_mode, count(*)::BIGINT AS n
FROM s LEFT JOIN l USING (row_index) GROUP BY ALL""")
def review_apply(spark, sf):
    """Decisions on samples, where masses are changed to another value and pressures to their own; both are verified again."""
    docs = _parts(spark, sf)
    s = runs.run_documents(docs).withColumn("row_index", F.get("evidence", 0)["locator"]["row_index"])
    last = _decisions(spark, sf).groupBy("row_index").agg(F.max("seq").alias("seq"), F.max_by("decision", "seq").alias("decision"))
    value = F.when(F.col("unit") == "mg", F.col("value_num") * 2 + 1).otherwise(F.col("value_num"))
    changes = F.when(F.col("decision") == "modify", F.to_json(F.struct(value.alias("value_num")))).otherwise("{}")
    log = s.join(last, "row_index").select("seq", F.col("id").alias("sample_id"), "decision", F.lit("r").alias("reviewer"), F.lit("").alias("comment"), changes.alias("changes"))
    out = runs.apply_review(s.drop("row_index"), log, docs)
    return out.groupBy("bucket", "review_decision", "status", "failure_mode").agg(F.count("*").alias("n"))


@query(f"WITH {PARTS} SELECT metric, count(*)::BIGINT AS n FROM s WHERE row_index % 7 <> 0 GROUP BY 1")
def active_samples(spark, sf):
    c = mine.table_candidates(_parts(spark, sf))
    gone = c.filter(F.get("evidence", 0)["locator"]["row_index"] % 7 == 0).select("id")
    return review.active(c, gone).groupBy("metric").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT conv_id, turn, len(list_intersect(['what', 'is', 'the', 'that', 'and', 'for'], list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9μ%]+'), lambda x: length(x) > 1))))::INT AS score FROM conversations)
SELECT conv_id, turn, score FROM t WHERE score > 0 ORDER BY score DESC, conv_id || '-' || lpad(turn::VARCHAR, 6, '0') LIMIT 20""")
def ask_topk(spark, sf):
    c = table(spark, sf, "conversations").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, F.lit("0"))))
    return publish.ask(c, "What is the that and for?", F.coalesce("text", F.lit("")), "key", 20).select("conv_id", "turn", "score")


def _records(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), (2000 + F.col("p_size") % 20).alias("year"), F.split("p_type", " ").alias("tags"), F.split("p_name", " ").alias("methods"), F.lit("https://example.org").alias("url"))


@query("""
WITH t AS (SELECT 'tags' AS facet, unnest(string_split(p_type, ' ')) AS value FROM part UNION ALL SELECT 'methods', unnest(string_split(p_name, ' ')) FROM part)
SELECT facet, value, count(*)::BIGINT AS n FROM t GROUP BY ALL""")
def literature_counts(spark, sf):
    return literature.counts(_records(spark, sf), ("tags", "methods"))


@query("""
WITH t AS (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part), c AS (SELECT tag, count(*)::BIGINT AS n FROM t GROUP BY 1)
SELECT tag, n, row_number() OVER (ORDER BY n DESC, encode(tag)) AS rank FROM c""")
def literature_ranking(spark, sf):
    return literature.ranked(_records(spark, sf), "tags").withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT p_partkey AS id, list_has_any(string_split(p_name, ' '), ['cold', 'small']) AS low, list_has_any(string_split(p_name, ' '), ['large', 'gear']) AS big FROM part")
def capability_flags(spark, sf):
    return literature.capabilities(_records(spark, sf), "methods", {"low": ("cold", "small"), "big": ("large", "gear")})


@query("SELECT count(*)::BIGINT AS records, min(2000 + p_size % 20) AS first_year, max(2000 + p_size % 20) AS last_year FROM part")
def literature_span(spark, sf):
    return literature.span(_records(spark, sf))


__all__ = ["ORACLES", "QUERIES", "formats"]
