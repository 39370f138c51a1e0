"""The literature matrix: records with list-valued fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def problems(required: tuple[str, ...]) -> Column:
    """array<string>: what a record lacks. Ids must be unique, years whole numbers, addresses http."""
    need = lambda name, ok: F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))
    repeated = F.count("*").over(Window.partitionBy("id")) > 1
    rules = [need(f"{c} is required", F.col(c).isNotNull()) for c in required]
    rules += [need("id is repeated", ~repeated), need("year is no whole number", F.col("year").cast("string").rlike(r"^\d{4}$")), need("url is no http address", F.col("url").rlike("^https?://"))]
    return F.filter(F.array(*rules), lambda e: e.isNotNull())


def ordered(records: DataFrame) -> DataFrame:
    """Records by year and id, lists as text."""
    lists = [f.name for f in records.schema.fields if f.dataType.typeName() == "array"]
    return records.withColumns({c: F.array_join(c, "; ") for c in lists}).withColumn("n", F.row_number().over(Window.orderBy("year", "id")))


def _tagged(column: str) -> Column:
    return F.transform(column, lambda v: F.struct(F.lit(column).alias("facet"), v.alias("value")))


def counts(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """How often each value stands in each list column: facet, value, n."""
    pairs = F.flatten(F.array(*[_tagged(c) for c in columns]))
    return records.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def capabilities(records: DataFrame, column: str, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """For each group of tags, whether a record has one."""
    return records.select("id", *[F.arrays_overlap(column, F.array(*map(F.lit, tags))).alias(name) for name, tags in groups.items()])


def ranked(records: DataFrame, column: str) -> DataFrame:
    """Tags by how many records have them, ties by tag."""
    n = records.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "tag")))


def span(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
