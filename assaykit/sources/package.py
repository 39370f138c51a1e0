"""The document package: one row per document, and its child tables."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = "struct<name:string,value:string>"
PARAGRAPH = "struct<id:string,page:int,text:string,section:string,section_path:array<string>,bbox:array<double>>"
TABLE = f"struct<id:string,page:int,caption:string,columns:array<string>,rows:array<array<{CELL}>>,column_units:map<string,string>,section_path:array<string>,bbox:array<double>>"
AXIS = "struct<label:string,unit:string>"
POINT = "struct<x:string,y:string,x_kind:string,y_kind:string,y_shown:string,x_shown:string,index:int>"
FIGURE = f"struct<id:string,label:string,caption:string,alt_text:string,page:int,section_path:array<string>,x_axis:{AXIS},y_axis:{AXIS},series:array<struct<name:string,index:int,points:array<{POINT}>>>>"
SUPPLEMENT = "struct<id:string,label:string,caption:string,href:string,text:string,section_path:array<string>,source_hash:string,parser:string>"
#: Rows of a table are arrays of cells, not maps: the order of columns is part of the data.
PACKAGE = (
    "doc_id string, title string, year int, license string, local_path string, "
    f"paragraphs array<{PARAGRAPH}>, tables array<{TABLE}>, figures array<{FIGURE}>, supplements array<{SUPPLEMENT}>, metadata map<string,string>, error string"
)


def with_ordinal(docs: DataFrame, *order: str) -> DataFrame:
    """Number documents by the given columns: 'first wins' rules need an order that Spark does not keep by itself.

    Only the keys go through the one global order; documents meet their numbers in a join. Documents that agree in all the
    columns share a number."""
    keys = docs.select(*order).distinct()
    numbers = keys.select(*[F.col(c).alias(f"_{c}") for c in order], (F.row_number().over(Window.orderBy(*order)) - 1).alias("doc_ordinal"))
    return docs.join(numbers, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order]).drop(*[f"_{c}" for c in order])


def stored(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``docs`` written once, so that miners, verification and provenance read parsed packages and no file is parsed again:
    in ``folder``, else under the cluster's ``spark.checkpoint.dir``; where neither is set, kept by the executors."""
    spark = docs.sparkSession
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return docs.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{base.rstrip('/')}/documents-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def _each(docs: DataFrame, column: str) -> DataFrame:
    kept = [c for c in ("doc_id", "doc_ordinal", "subject") if c in docs.columns]
    return docs.select(*kept, F.posexplode(column).alias("ordinal", "x"))


def paragraphs(docs: DataFrame) -> DataFrame:
    own = _each(docs, "paragraphs")
    return own.select(*own.columns[:-1], "x.*")


def tables(docs: DataFrame) -> DataFrame:
    own = _each(docs, "tables")
    return own.select(*own.columns[:-1], "x.*")


def cells(docs: DataFrame) -> DataFrame:
    """One row per cell, with its table, row (and the row's cells, for labels) and column."""
    rows = tables(docs).withColumnRenamed("id", "table_id")
    rows = rows.select("*", F.posexplode("rows").alias("row_index", "row")).drop("rows", "columns")
    return rows.select("*", F.posexplode("row").alias("col_index", "cell")).select("*", F.col("cell.name").alias("col"), F.col("cell.value").alias("raw_value")).drop("cell")


def figures(docs: DataFrame) -> DataFrame:
    own = _each(docs, "figures")
    return own.select(*own.columns[:-1], "x.*")


def points(docs: DataFrame) -> DataFrame:
    """Points of all series; indexes are positions in the source, so dropped points leave gaps."""
    own = figures(docs).withColumnRenamed("id", "figure_id").select("*", F.explode("series").alias("s")).drop("series")
    own = own.select("*", F.col("s.index").alias("series_index"), F.col("s.name").alias("series_name"), F.explode("s.points").alias("p"))
    return own.select("*", F.col("p.index").alias("point_index"), "p.x", "p.y", "p.x_kind", "p.y_kind", "p.x_shown", "p.y_shown").drop("s", "p", "index")


def supplements(docs: DataFrame) -> DataFrame:
    own = _each(docs, "supplements")
    return own.select(*own.columns[:-1], "x.*")
