"""Document packages rendered from the star schema, so that miners have tables, sentences and curves at any scale.

Values are printed from whole numbers and two-place decimals, so every engine prints the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.sources import package as pk

LICENSES = ("CC-BY-4.0", "MIT", "unknown", "CC-BY", "proprietary", "public-domain")
ROWS = 50  # rows of a rendered table, and orders of a rendered article


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)").cast("string")


def _package(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = dict(x.split(" ", 1) for x in pk.PACKAGE.split(", ") if " " in x and "<" not in x.split(" ", 1)[0])
    empty = {"paragraphs": f"array<{pk.PARAGRAPH}>", "tables": f"array<{pk.TABLE}>", "figures": f"array<{pk.FIGURE}>", "supplements": f"array<{pk.SUPPLEMENT}>"}
    given = {k: columns[k].cast(empty[k]) if k in columns else F.array().cast(empty[k]) for k in empty}
    base = {
        "doc_id": F.col("doc_id"), "title": F.col("doc_id"), "year": F.lit(2024), "license": F.element_at(F.array(*map(F.lit, LICENSES)), (F.col("n") % len(LICENSES) + 1).cast("int")),
        "local_path": F.concat(F.lit("rendered/"), F.col("doc_id")), "metadata": F.create_map(F.lit("domain"), F.lit("rendered")), "source_hash": F.sha2(F.col("doc_id"), 256), "doc_ordinal": F.col("n").cast("int"),
    }
    assert set(kinds) - {"error"} <= set(base) | set(empty)
    return df.select(*[v.alias(k) for k, v in (base | given).items()])


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to as many partitions as the session has for a shuffle: few bytes here are much work for a miner,
    so partitions must not be merged by their bytes. Dealt by doc_id, documents and all that is mined from them lie in the
    partitions that joins on doc_id ask for, and are not shuffled again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def part_documents(part: DataFrame, caption: str = "Collected after 24 h") -> DataFrame:
    """Tables of ROWS parts: sample, mass and pressure."""
    cell = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    row = F.array(cell("Sample", F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))), cell("Mass (mg)", F.col("p_size").cast("string")), cell("Pressure (kPa)", money("p_retailprice")))
    p = part.select(F.floor(F.col("p_partkey") / ROWS).alias("n"), F.col("p_partkey").alias("k"), row.alias("row"))
    g = p.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias("rows"))  # ROWS rows a group
    g = g.withColumn("doc_id", F.concat(F.lit("parts-"), F.col("n").cast("string")))
    one = F.struct(
        F.lit("Table 1").alias("id"), F.lit(0).alias("page"), F.lit(caption).alias("caption"), F.array(*map(F.lit, ("Sample", "Mass (mg)", "Pressure (kPa)"))).alias("columns"), F.col("rows"),
        _null("map<string,string>").alias("column_units"), _null("array<string>").alias("section_path"), _null("array<double>").alias("bbox"),
    )
    return _package(g, tables=F.array(one))


def sentence() -> Column:
    return F.concat(
        F.lit("Sample "), F.col("l_partkey").cast("string"), F.lit(" achieved a yield of "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" %; temperature was "), (F.col("l_linenumber") + 20).cast("string"), F.lit(" C.")
    )


def order_documents(lineitem: DataFrame) -> DataFrame:
    """Articles of ROWS orders, a paragraph for each line item."""
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    n = F.floor(F.col("l_orderkey") / ROWS)
    rows = lineitem.select(F.concat(F.lit("orders-"), n.cast("string")).alias("doc_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = _dealt(rows, "doc_id").select("doc_id", n.alias("n"), k.alias("k"), sentence().alias("text"))  # numbers are shuffled, not texts
    g = rows.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("lines"))  # the lines of ROWS orders
    one = lambda x: F.struct(F.concat(F.lit("p"), x["k"].cast("string")).alias("id"), F.lit(0).alias("page"), x["text"].alias("text"), F.lit("").alias("section"), F.array(F.lit("Results")).alias("section_path"), _null("array<double>").alias("bbox"))
    return _package(g, paragraphs=F.transform("lines", one))


def relation_sentence() -> Column:
    verb = F.element_at(F.array(*map(F.lit, ("increased", "higher", "reduced", "improved"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return F.concat(F.lit("Customer "), F.col("c_custkey").cast("string"), F.lit(" showed "), verb, F.lit(" demand in nation "), F.col("c_nationkey").cast("string"), F.lit(" than before."))


def customer_documents(customer: DataFrame) -> DataFrame:
    """Articles of ROWS customers, a paragraph with a relation for each."""
    rows = customer.select(F.floor(F.col("c_custkey") / ROWS).alias("n"), F.col("c_custkey").alias("k"), relation_sentence().alias("text"))
    g = _dealt(rows, "n").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("lines"))  # ROWS rows a group
    g = g.withColumn("doc_id", F.concat(F.lit("customers-"), F.col("n").cast("string")))
    one = lambda x: F.struct(F.concat(F.lit("p"), x["k"].cast("string")).alias("id"), F.lit(0).alias("page"), x["text"].alias("text"), F.lit("").alias("section"), F.array(F.lit("Results")).alias("section_path"), _null("array<double>").alias("bbox"))
    return _package(g, paragraphs=F.transform("lines", one))


def supplier_documents(supplier: DataFrame) -> DataFrame:
    """One article for each supplier, whose only content is a supplement."""
    text = F.concat(F.lit("Run "), F.col("s_suppkey").cast("string"), F.lit(" had a yield of "), (F.col("s_suppkey") % 90 + 1).cast("string"), F.lit(" %."))
    g = supplier.select(F.col("s_suppkey").alias("n"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("doc_id"), text.alias("text"))
    one = F.struct(
        F.lit("s1").alias("id"), F.lit("Supplement 1").alias("label"), F.lit("").alias("caption"), F.lit("s1.txt").alias("href"), F.col("text"), F.array().cast("array<string>").alias("section_path"),
        _null("string").alias("source_hash"), _null("string").alias("parser"),
    )
    return _package(g, supplements=F.array(one))


def event_documents(events: DataFrame) -> DataFrame:
    """A figure for each user: a series for each event type, points (number of the event, its value)."""
    e = events.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("doc_id"), "user_id", "event_type", "event_id", F.round("value", 2).alias("y"))
    s = _dealt(e, "doc_id").groupBy("doc_id", "user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("event_id", "y"))).alias("p"))
    y = lambda x: F.concat(x["y"].cast("decimal(12,2)").cast("string"), F.lit(" %"))
    point = lambda x, i: F.struct(x["event_id"].cast("string").alias("x"), x["y"].cast("string").alias("y"), F.lit("number").alias("x_kind"), F.lit("number").alias("y_kind"), y(x).alias("y_shown"), F.concat(x["event_id"].cast("string"), F.lit(" h")).alias("x_shown"), i.alias("index"))
    s = s.select("doc_id", "user_id", "event_type", F.transform("p", point).alias("points"))
    g = s.groupBy("doc_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "points"))).alias("all")).withColumn("n", F.col("user_id"))
    axis = lambda label, unit: F.struct(F.lit(label).alias("label"), F.lit(unit).alias("unit"))
    series = F.transform("all", lambda x, i: F.struct(x["event_type"].alias("name"), i.alias("index"), x["points"].alias("points")))
    one = F.struct(
        F.lit("fig1").alias("id"), F.lit("Figure 1").alias("label"), F.lit("").alias("caption"), F.lit("").alias("alt_text"), F.lit(0).alias("page"), _null("array<string>").alias("section_path"),
        axis("time", "h").alias("x_axis"), axis("response", "%").alias("y_axis"), series.alias("series"),
    )
    return _package(g, figures=F.array(one))
