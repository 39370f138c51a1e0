"""Reading documents, manifests, results and supplements as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.text import known_license
from assaykit.sources import formats
from assaykit.sources.package import PACKAGE


class Adapter(Protocol):
    """A parser from outside: it names itself, says what it takes, and returns a package in JSON form."""

    name: str

    def supports(self, source: str) -> bool: ...

    def load(self, data: bytes, source: str, metadata: dict) -> dict: ...


def _parsed(data: bytes, name: str, meta: dict, adapters: tuple, adapter: str | None) -> str:
    try:
        return json.dumps(formats.parse(data, name, meta, adapters, adapter) | {"error": None}, ensure_ascii=False, allow_nan=False)
    except (formats.FormatError, ValueError, KeyError, TypeError, AttributeError) as error:
        return json.dumps({"doc_id": meta.get("doc_id") or f"file:{name}", "local_path": name, "error": f"{type(error).__name__}: {error}"})


def parse_documents(files: DataFrame, adapters: tuple = (), adapter: str | None = None) -> DataFrame:
    """Packages of files (columns path, content, and optionally metadata: map<string,string>), with source_hash and bytes.

    A file that does not parse gives a row with ``error`` and no content: one bad file never fails a job."""
    meta = F.to_json("metadata") if "metadata" in files.columns else F.lit("{}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "raw": [_parsed(bytes(c), p, json.loads(m or "{}"), adapters, adapter) for p, c, m in zip(b["path"], b["content"], b["meta"], strict=True)], "source_hash": b["source_hash"], "content_size_bytes": b["content_size_bytes"]})

    given = files.select("path", "content", meta.alias("meta"), F.sha2("content", 256).alias("source_hash"), F.octet_length("content").cast("bigint").alias("content_size_bytes"))
    parsed = given.mapInPandas(run, "path string, raw string, source_hash string, content_size_bytes bigint")
    return parsed.select("path", "source_hash", "content_size_bytes", F.from_json("raw", PACKAGE).alias("d")).select("d.*", "path", "source_hash", "content_size_bytes")


def read_documents(spark: SparkSession, paths: list[str] | str, metadata: DataFrame | None = None, **options) -> DataFrame:
    """Documents of the paths, each by its suffix or the adapter named; ``metadata`` has columns path and metadata."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    files = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    if metadata is not None:
        files = files.join(metadata.select("path", "metadata"), "path", "left")
    return parse_documents(files, **options)


def plain_path(path: Column, depth: int = 16) -> Column:
    """The path without ``.`` and ``..`` parts, as readers of files give it; at most ``depth`` of the latter."""
    out = F.regexp_replace(path, r"/(?:\./)+", "/")
    for _ in range(depth):
        out = F.regexp_replace(out, r"/(?!\.\./)[^/]+/\.\./", "/")
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest: ordinal, path (relative ones resolved against the manifest), metadata, expected counts and
    claims. An entry is a path or an object."""
    folder = path.rpartition("/")[0]
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.documents"), "array<string>")).alias("entry_ordinal", "entry"))
    item = F.when(F.col("entry").startswith("{"), F.get_json_object("entry", "$.path")).otherwise(F.col("entry"))
    get = lambda key, kind: F.from_json(F.when(F.col("entry").startswith("{"), F.get_json_object("entry", f"$.{key}")), kind)
    claim = "kind string, table_id string, row string, col string, task_type string, condition string, value string, uncertainty double, unit string, metric string, entity string, paragraph_id string, subject string, object string"
    return raw.select(
        "entry_ordinal",
        plain_path(F.when(item.startswith("/"), item).otherwise(F.concat(F.lit(folder + "/"), item))).alias("path"),
        get("metadata", "map<string,string>").alias("metadata"),
        get("expected", "struct<candidates:int,gold:int,silver:int>").alias("expected"),
        get("expected_claims", f"array<struct<{claim.replace(' ', ':').replace(',:', ',')}>>").alias("expected_claims"),
    )


def read_results(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """The samples of a run's folder."""
    return spark.read.parquet(f"{folder}/samples") if schema is None else spark.read.schema(schema).json(f"{folder}/all.jsonl")


def paragraphs_of_text(text: str = "text") -> Column:
    """array<struct<id, text>>: blocks between blank lines, numbered before empty ones go. A Spark expression, so plain text
    needs no Python."""
    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda b, i: F.struct(F.concat(F.lit("p"), (i + 1).cast("string")).alias("id"), F.trim(b, F.lit(" \t\n\r\x0b\x0c")).alias("text")))
    return F.filter(blocks, lambda b: b["text"] != "")


def source_records(docs: DataFrame) -> DataFrame:
    """Provenance of each document: hash, size, version, license status and warnings that block nothing."""
    meta = lambda key: F.try_element_at(F.col("metadata"), F.lit(key))
    warnings = F.array(
        F.when(~known_license(F.col("license")), F.lit("license is unknown or not reusable")),
        F.when(meta("source_url").isNull(), F.lit("no source_url")),
        F.when(meta("retrieved_at").isNull(), F.lit("no retrieved_at")),
        F.when(meta("license_source").isNull(), F.lit("no license_source")),
    )
    return docs.select(
        "doc_id",
        "source_hash",
        "content_size_bytes",
        F.coalesce(meta("source_version"), F.col("source_hash")).alias("source_version"),
        F.coalesce(meta("retrieval_method"), F.lit("local_file")).alias("retrieval_method"),
        F.when(known_license(F.col("license")), "known").otherwise("unknown").alias("license_status"),
        *[meta(k).alias(k) for k in ("source_url", "retrieved_at", "license_source", "doi", "pmid", "adapter", "domain")],
        F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )


def attach_supplement(docs: DataFrame, attachment: DataFrame, supplement_id: str) -> DataFrame:
    """Documents with one more supplement: the text, captions and rows of the attachment (one parsed document).

    Text reads: paragraphs, then captions, then each row as ``column: value; ...``."""
    row_text = lambda r: F.array_join(F.transform(r, lambda c: F.concat(c["name"], F.lit(": "), F.coalesce(c["value"], F.lit("")))), "; ")
    lines = F.concat(
        F.transform("paragraphs", lambda p: p["text"]),
        F.flatten(F.transform("tables", lambda t: F.concat(F.array_compact(F.array(t["caption"])), F.transform(t["rows"], row_text)))),
    )
    lines = F.filter(lines, lambda x: F.coalesce(x, F.lit("")) != "")
    one = attachment.select(
        F.struct(
            F.lit(supplement_id).alias("id"), F.lit("").alias("label"), F.lit("").alias("caption"), F.col("local_path").alias("href"), F.array_join(lines, "\n").alias("text"),
            F.array().cast("array<string>").alias("section_path"), F.col("source_hash").alias("source_hash"), F.try_element_at("metadata", F.lit("adapter")).alias("parser"),
        ).alias("_one")
    )
    found = one.first()
    literal = F.from_json(F.lit(json.dumps(found[0].asDict(), ensure_ascii=False)), "struct<id:string,label:string,caption:string,href:string,text:string,section_path:array<string>,source_hash:string,parser:string>")
    return docs.withColumn("supplements", F.array_append(F.coalesce("supplements", F.array().cast(docs.schema["supplements"].dataType)), literal))
