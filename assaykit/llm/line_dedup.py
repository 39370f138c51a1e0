"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of white space with A-Z lower-cased; a key in at least ``min_docs`` documents loses all
its lines. Document counts of keys live in immutable runs, sorted by hash, in levels: a batch adds one run to level 0, and
``fanout`` runs of a level are merged into one run of the next. Keys that reach ``min_docs`` on a merge are *settled*: each
later batch merge-anti-joins the settled runs first, so that keys whose fate is known are neither stored nor counted again.

Defined results
---------------
* null or empty text: one empty line; a key shorter than ``min_key_chars`` code points is never dropped;
* a document row counts once for a key, however often the line stands in it; repeated rows count each;
* an empty table: no rows; extra columns are ignored by :func:`dedup_lines` (it returns the contract's columns and the text);
* very long texts are read whole, and a null doc_id is kept; rows of the same id and text are each stripped.

Scale: keys are counted with map-side combining, so a line of a third of all documents costs a row per task. Frequent keys
are broadcast while they fit ``most`` (16 MB); beyond that the join of lines to them is salted, and text is shuffled once, to
meet its document's list of frequent keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm._common import arrow_batches, discard, materialize, text_of

KEY = ["h1", "h2"]
_hash = xxhash.xxh3_128_digest


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # on bytes: the six blanks, and A-Z only


def _long_enough(key: bytes, n: int) -> bool:
    return bool(key) if n <= 1 else len(key) >= n and len(key.decode("utf-8", "replace")) >= n


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _pairs(digests: list[bytes]) -> np.ndarray:
    """Both halves of each digest, a row for each."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def line_keys(docs: DataFrame, min_key_chars: int) -> DataFrame:
    """Distinct key hashes of each document row, beside all columns of ``docs`` but ``text`` (its last column)."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "h1 bigint", "h2 bigint"])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, hashes = [], []
            for text in _binary(batch.column(len(kept))):
                keys = {_hash(k) for k in {line_key(x) for x in text.split(b"\n")} if _long_enough(k, min_key_chars)}
                count.append(len(keys))
                hashes += sorted(keys)
            at = pa.array(np.repeat(np.arange(len(count)), count))
            both = _pairs(hashes)
            columns = [batch.column(k).take(at) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(both[:, k].copy()) for k in range(2))], [*(f.name for f in kept), *KEY])

    return docs.mapInArrow(explode, schema)


class LineRuns:
    """Document counts of line keys in levelled sorted runs."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def _write(self, counts: DataFrame, name: str) -> DataFrame:
        return materialize(counts, name, sort=KEY)

    def _sum(self, runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for r in runs[1:]:
            union = union.unionAll(r)
        return union.groupBy(*KEY).agg(F.sum("n").alias("n"))

    def known(self) -> DataFrame | None:
        """Settled keys: a key settles once, as later batches no longer count it."""
        out = None
        for run in self.settled:
            keys = run.filter(F.col("n") >= self.min_docs).select(*KEY)
            out = keys if out is None else out.unionAll(keys)
        return out

    def add(self, keys: DataFrame) -> None:
        """Count a batch's keys (one row per document and key), without those that are settled, and add the run."""
        counts = keys.groupBy(*KEY).agg(F.count("*").alias("n"))
        if (known := self.known()) is not None:
            counts = counts.join(known.hint("merge"), KEY, "left_anti")
        self._put(self._write(counts, "run-0"), 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            merged = self._write(self._sum([self._open(r) for r in runs]), f"run-{level + 1}")
            self.settled.append(merged)
            # A merged run holds its settled keys too; they are left out when it is merged again.
            discard(*(r for r in runs if r not in self.settled))
            self._put(merged, level + 1)

    def _open(self, run: DataFrame) -> DataFrame:
        return run.filter(F.col("n") < self.min_docs) if run in self.settled else run

    def frequent(self) -> DataFrame:
        """All keys of at least ``min_docs`` documents among the batches so far."""
        runs = [self._open(r) for level in self.levels for r in level]
        out = self._sum(runs).filter(F.col("n") >= self.min_docs).select(*KEY) if runs else None
        known = self.known()
        both = [x for x in (out, known) if x is not None]
        if not both:
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return both[0] if len(both) == 1 else both[0].unionAll(both[1])


def _stripped(doc_id: pa.Array, rows: Iterator[tuple[bytes, list[bool] | None]]) -> pa.RecordBatch:
    """Results for rows of (text, which of its lines go; None: none)."""
    out = []
    for text, gone in rows:
        lines = text.split(b"\n")
        kept = [x for x, g in zip(lines, gone, strict=True) if not g] if gone and any(gone) else lines
        body = b"\n".join(kept)
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256(body).hexdigest(), body))
    n, dropped, sha, body = zip(*out, strict=True) if out else ((), (), (), ())
    columns = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string()), pa.array(body, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([doc_id, *columns], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "text"])


STRIPPED = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, text string"


def drop_lines(docs: DataFrame, frequent: DataFrame, min_key_chars: int = 1, salts: int = 8, most: int = 1 << 20) -> DataFrame:
    """Each row of ``docs`` without the lines of frequent keys: doc_id, n_lines, n_dropped, kept_sha256, text.

    Up to ``most`` frequent keys (16 bytes each) are broadcast and no text is shuffled; more of them meet the lines, and then
    the texts, in joins. Both ways give the same rows."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    if frequent.count() <= most:
        return _drop_known(rows, frequent)
    lines = line_keys(rows, min_key_chars).withColumn("salt", F.expr(f"pmod(th, {salts}L)"))
    salted = frequent.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    hits = lines.join(salted, [*KEY, "salt"]).groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct(*KEY)).alias("keys"))
    joined = rows.join(hits, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "keys")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            flat = held.flatten()
            digests = np.stack([flat.field(k).to_numpy() for k in range(2)], 1).astype("<i8").tobytes()
            at = np.concatenate(([0], np.cumsum(np.nan_to_num(held.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))))
            drop = [{digests[16 * k : 16 * k + 16] for k in range(at[i], at[i + 1])} for i in range(batch.num_rows)]
            rows = ((t, [bool(k := line_key(x)) and _hash(k) in d for x in t.split(b"\n")] if d else None) for t, d in zip(_binary(batch.column(1)), drop, strict=True))
            yield _stripped(batch.column(0), rows)

    return joined.mapInArrow(apply, STRIPPED)


def _drop_known(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """:func:`drop_lines` for keys that a broadcast can hold: sorted, so that a batch's lines are looked up at once."""
    spark = rows.sparkSession
    keys = np.array([(r.h1, r.h2) for r in frequent.collect()], "<i8").reshape(-1, 2)
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    shared = spark.sparkContext.broadcast(keys)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _binary(batch.column(1))
            lines = [[line_key(x) for x in t.split(b"\n")] for t in texts]
            flags = iter(_members(_pairs([_hash(k) if k else NO_KEY for own in lines for k in own]), shared.value).tolist())
            yield _stripped(batch.column(0), ((t, [g and bool(k) for k, g in zip(own, flags, strict=False)]) for t, own in zip(texts, lines, strict=True)))

    return rows.select("doc_id", "text").mapInArrow(apply, STRIPPED)


NO_KEY = bytes(16)


def _members(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which pairs are rows of ``known``, sorted by both columns; first columns may repeat."""
    at = np.searchsorted(known[:, 0], pairs[:, 0], "left")
    out, open_ = np.zeros(len(pairs), bool), np.arange(len(pairs))
    while len(open_):
        open_ = open_[at[open_] < len(known)]
        open_ = open_[known[at[open_], 0] == pairs[open_, 0]]
        hit = known[at[open_], 1] == pairs[open_, 1]
        out[open_[hit]] = True
        open_ = open_[~hit]
        at[open_] += 1
    return out


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_key_chars: int = 1, batches: int = 4, fanout: int = 2, most: int = 1 << 20) -> DataFrame:
    """All documents through the runs, in ``batches`` arrivals, then stripped of the frequent lines."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        arrived = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b)
        runs.add(line_keys(arrived.select(text_of().alias("text")), min_key_chars))
    return drop_lines(docs, materialize(runs.frequent(), "frequent"), min_key_chars, most=most)


ORACLE = """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, i, list_extract(parts, i) AS line,
         translate(trim(list_extract(parts, i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM rows) t, unnest(range(1, len(parts) + 1)) AS u(i)
), frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT lines.*, lines.k IN (SELECT k FROM frequent) AS gone FROM lines)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
