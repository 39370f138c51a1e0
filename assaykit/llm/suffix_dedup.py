"""Removal of repeated byte strings: a depth-limited radix sort of suffixes, by most-significant-digit passes.

Suffixes are ordered only through their first ``depth`` bytes, and only as far as groups of equal digits: a group of one
needs no further pass, and a group that is equal through the depth is a repeated window. The passes:

* pass 0: the 64 bytes of the window's anchor (see ``_windows``), a block that depends on the window's bytes alone. One row
  stands for all consecutive windows of an anchor (a run of up to 137), which is what makes the pass affordable: the rows
  are 1/70 of the bytes, where a row for each suffix would shuffle many times the text;
* pass 1: the whole run, by 128 bits of hash. Runs that occur twice are repeated windows, each of them; runs whose anchor
  occurs once are done;
* for runs that share their anchor but not their bytes, the windows at equal offsets from the anchor are ordered by eight
  bytes a pass, from the first to the last, on the bytes themselves; groups of one drop out after each pass. That happens
  within tasks. A group of more than ``block`` runs is first split: windows of offsets ``[p, q]`` before the anchor share a
  core of ``depth - (q - p)`` bytes, and two halves of the offsets have longer cores as their next digit, until groups fit
  a task or the core is the window, whose bytes are then compared.

Every byte that a repeated window covers is removed; windows are judged on the input and never cross documents.

Defined results
---------------
* null or empty text: no bytes, nothing removed; texts shorter than ``depth`` bytes are kept; repeated rows repeat each other;
* an empty table: no rows; extra columns are ignored; kept bytes need not be valid UTF-8, so results give their hash;
* a null doc_id is kept; very long texts are cut into overlapping pieces for their hashes, and lose no window.

Scale: counts combine map-side, so an anchor of a third of all rows costs a row per task. Text is shuffled twice, to meet
its runs and its removed ranges. Group sizes never decide what a task holds beyond ``block`` runs of at most 336 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm import _shingles as S
from assaykit.llm import _windows as W
from assaykit.llm._common import arrow_batches, discard, materialize, release, text_of

DOC = ["doc_id", "th"]
RUN = "doc_id bigint, th bigint, lo bigint, span int, off int, a bigint, g bigint, f bigint"
CORE = "key bigint, p int, q int, c bigint, doc_id bigint, th bigint, lo bigint, off int, content binary"
RANGE = "doc_id bigint, th bigint, lo bigint, hi bigint"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def run_rows(docs: DataFrame, depth: int) -> DataFrame:
    """One row for each run of windows: its document, first window, windows after it, anchor's offset, and both hashes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = S.column_bytes(batch.column(2))
            for d, lo, hi, pos, a, g, f in W.runs(raw, off, depth):
                at = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(lo),
                        pa.array((hi - lo).astype(np.int32)),
                        pa.array((pos - lo).astype(np.int32)),
                        pa.array(a.view(np.int64)),
                        pa.array(g.view(np.int64)),
                        pa.array(f.view(np.int64)),
                    ],
                    _names(RUN),
                )

    return docs.mapInArrow(split, RUN)


def run_contents(docs: DataFrame, chosen: DataFrame, depth: int) -> DataFrame:
    """The bytes of the chosen runs (columns of RUN and ``c``), as groups of pass 0: all offsets, keyed by the anchor."""
    lists = chosen.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("a", "c", "lo", "span", "off")).alias("runs"))
    met = docs.join(lists, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(*DOC, "text", "runs")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = S.column_bytes(batch.column(2))
            rows = []
            for i, (doc_id, th, runs) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = raw[off[i] : off[i + 1]].tobytes()
                rows += [(r["a"], 0, depth - W.BLOCK, r["c"], doc_id, th, r["lo"], r["off"], own[r["lo"] : r["lo"] + r["span"] + depth]) for r in runs]
            yield _core_batch(rows)

    return met.mapInArrow(fetch, CORE)


def _core_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _names(CORE))


def _halves(depth: int):
    """Next digit of the rows of large groups: the two halves of their offset range, as far as a row has windows there."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, p, q, c, doc_id, th, lo, off, content in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                span = len(content) - depth
                middle = (p + q) // 2
                for x, y in ((p, middle), (middle + 1, q)):
                    if max(x, off - span) <= min(y, off):
                        core = content[off - x : off + depth - y]
                        digit = xxhash.xxh3_64_intdigest(core, seed=(key * 2 + (x != p)) & (1 << 64) - 1)
                        rows.append((digit - (1 << 63), x, y, c, doc_id, th, lo, off, content))
            yield _core_batch(rows)

    return divide


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows of the sorted input that never cut a group (equal key, p and q)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        key = np.stack([table.column(k).to_numpy() for k in range(3)])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        if len(cut):
            at = int(cut[-1]) + 1
            yield table.slice(0, at)
            held = table.slice(at).combine_chunks().to_batches()
            n = table.num_rows - at
    if n:
        yield pa.Table.from_batches(held)


def digit_passes(raw: np.ndarray, begin: np.ndarray, group: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Which of the windows that start at ``begin`` are equal, through ``depth`` bytes, to others of their group.

    Windows stand ordered by group. Each pass takes the next eight bytes as the digit: groups whose digits differ are
    ordered by it and fall into groups of equal digits, and groups of one window (by weight) are done."""
    digits = np.ndarray((max(len(raw) - 7, 0),), ">u8", raw, strides=(1,))
    alive, group = np.arange(len(begin)), np.asarray(group)
    for d in range(0, depth, 8):
        if not len(alive):
            break
        digit = digits[begin[alive] + d].astype(np.uint64)
        edge = np.concatenate(([True], group[1:] != group[:-1]))
        which = np.cumsum(edge) - 1
        first = np.flatnonzero(edge)
        split = np.zeros(len(first), bool)
        split[which[digit != digit[first][which]]] = True
        at = np.flatnonzero(split[which])
        order = np.lexsort((digit[at], which[at]))
        alive[at], digit[at] = alive[at[order]], digit[at[order]]
        edge[1:] |= digit[1:] != digit[:-1]
        which = np.cumsum(edge) - 1
        more = (np.add.reduceat(weight[alive], np.flatnonzero(edge)) > 1)[which]
        alive, group = alive[more], which[more]
    return alive


def repeated_in_groups(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and ranges (row, first window, last window, all from the run's start) of repeated windows of single runs."""
    raw, start = S.column_bytes(table.column(8).cast(pa.large_binary()))
    key, p, q, c, off = (table.column(k).to_numpy() for k in (0, 1, 2, 3, 7))
    span = np.diff(start) - depth
    first = np.maximum(0, off - q)
    last = np.minimum(span, off - p)
    count = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
    begin = start[row] + at
    head = np.cumsum(np.concatenate(([0], ((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)).astype(np.int64)))) if len(key) else key
    group = head[row] * 2 * depth + off[row] - at
    order = np.argsort(group, kind="stable")
    found = digit_passes(raw, begin[order], group[order], c[row[order]], depth)
    keep = np.sort(order[found])
    keep = keep[c[row[keep]] == 1]
    row, at = row[keep], at[keep]
    if not len(row):
        return row, at, at
    cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(at) != 1)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(row) - 1]))
    return row[begin], at[begin], at[end]


def repeated_ranges(cores: DataFrame, depth: int, block: int) -> DataFrame:
    """Byte ranges that the passes beyond the first find in runs that occur once."""

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 20_000):
            row, first, last = repeated_in_groups(table, depth)
            at = pa.array(row)
            lo = table.column(6).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [table.column(4).combine_chunks().take(at), table.column(5).combine_chunks().take(at), pa.array(lo + first), pa.array(lo + last + depth)], _names(RANGE)
            )

    found = []
    group = ["key", "p", "q"]
    while True:
        sizes = cores.groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1")
        sizes = materialize(sizes.select(*[F.col(k).alias(f"_{k}") for k in group], "n"), "groups")
        met = cores.join(sizes, [F.col(k) == F.col(f"_{k}") for k in group])
        small = met.filter(F.col("n") <= block).select(*cores.columns)
        found.append(materialize(small.repartition(*group).sortWithinPartitions(*group).mapInArrow(order, RANGE), "ranges"))
        if not sizes.filter(F.col("n") > block).limit(1).count():
            break
        large = met.filter(F.col("n") > block)
        # One window each, which its group's digit has told from all others; the least and the largest of them agree.
        whole = large.filter("p = q").withColumn("window", F.substring("content", F.col("off") - F.col("p") + 1, F.lit(depth)))
        told = whole.groupBy(*[F.col(k).alias(f"_{k}") for k in group]).agg((F.min("window") == F.max("window")).alias("same"))
        if told.filter("NOT same").limit(1).count():
            raise RuntimeError("two windows of one digit differ")
        equal = large.filter((F.col("p") == F.col("q")) & (F.col("c") == 1))
        begin = F.col("lo") + F.col("off") - F.col("p")
        found.append(materialize(equal.select(*DOC, begin.alias("lo"), (begin + depth).alias("hi")), "ranges"))
        cores = materialize(large.filter("p < q").select(*cores.columns).mapInArrow(_halves(depth), CORE), "cores")
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def strip(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each document without the bytes of its ranges: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept."""
    lists = ranges.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    met = docs.join(lists, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = S.column_bytes(batch.column(1))
            held = batch.column(2)
            at, flat = held.offsets.to_numpy(), held.flatten()
            lo, hi = (flat.field(k).to_numpy() for k in (0, 1))
            at = at - at[0]
            rows = []
            for i in range(batch.num_rows):
                own = raw[off[i] : off[i + 1]]
                a, b = lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]]
                if not len(a):
                    kept, spans = own.tobytes(), 0
                else:
                    depth = np.zeros(len(own) + 1, np.int32)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = own[~gone].tobytes()
                rows.append((len(own), len(own) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return met.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, depth: int = 200, block: int = 4096) -> DataFrame:
    """All documents without the bytes that ``depth``-byte repeats cover; see :func:`strip` for the columns."""
    if depth % 8 or depth < 2 * W.BLOCK:
        raise ValueError("depth must be a multiple of 8, at least 128")
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    rows = run_rows(docs, depth)
    ends = [f(x).alias(f"{name}_{x}") for x in ("g", "f") for name, f in (("min", F.min), ("max", F.max))]
    groups = rows.groupBy("a").agg(F.count("*").alias("n"), *ends).filter("n > 1")
    # Written, so that both sides of the join are plain shuffles, of which Spark splits a hot anchor's rows over tasks.
    groups = materialize(groups.select(F.col("a").alias("_a"), F.expr("min_g <> max_g OR min_f <> max_f").alias("mixed")), "anchors")
    shared = materialize(rows.join(groups, F.col("a") == F.col("_a")).select(*rows.columns, "mixed"), "runs")
    release(spark)
    mixed = shared.filter("mixed")
    counts = mixed.groupBy("a", "g", "f").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "lo", "span", "off")).alias("r"))
    counts = materialize(counts.select("a", "g", "f", "c", "r.*"), "distinct")
    cores = materialize(run_contents(docs, counts, depth), "cores")
    release(spark)
    ranges = repeated_ranges(cores, depth, block)
    discard(cores)
    whole = counts.filter("c > 1").select(*[F.col(x).alias(f"_{x}") for x in "agf"])
    span = [*DOC, "lo", (F.col("lo") + F.col("span") + depth).alias("hi")]
    ranges = ranges.unionAll(shared.filter("NOT mixed").select(*span))
    ranges = ranges.unionAll(mixed.join(whole, [F.col(x) == F.col(f"_{x}") for x in "agf"]).select(*span))
    release(spark)
    return strip(docs, ranges)
