"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Equal texts form a class; one representative goes on, so copies never become pairs.
2. A MinHash signature of each text's ``width``-word shingles gives ``bands`` keys of ``rows`` values. Two texts of Jaccard
   similarity ``s`` share a key with probability 1 - (1 - s^rows)^bands, which misses 5e-7 at 0.8.
3. Within a key, texts are compared ``STEP`` signature values at a time. With a flat prior the posterior probability that
   the similarity reaches ``threshold`` after ``m`` matches of ``n`` is P(Binomial(n + 1, threshold) <= m); a pair is
   dropped as soon as it falls below ``tolerance``. What survives leaves the key as a spanning forest, not as pairs.
4. The forests' components hold, together, all texts that may be linked. Within a component, pairs are pruned the same
   way and the rest verified exactly, on the shingles themselves; each text gets the number of its links.

A key or component of any size is cut into blocks of ``block`` texts and each pair of blocks is a task of its own, so no
task holds an unbounded group, and pairs are never written: tasks return counts per text, and forests.

Defined results
---------------
* null text: in a class of its own, no links; texts shorter than ``width`` words (and empty ones) link only to equal texts;
* repeated rows are copies of each other; a null doc_id sorts first in its class; an empty table: no rows;
* extra columns are ignored by :func:`join_documents` and kept by :func:`keep_one`; very long texts are read whole, and
  those that may be linked stand in memory together, a pair of blocks at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm import _shingles as S
from assaykit.llm._common import arrow_batches, drop_worker_cache, materialize, release
from assaykit.llm._graph import connected_components, forest

STEP = 32
COMPARED = 128


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240917))
    return r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(shingles: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """MinHash values, one row for each document that has shingles."""
    x = (shingles >> S.U64(32)).astype(np.uint32)
    starts = off[:-1][np.diff(off) > 0]
    out = np.empty((n, len(starts)), np.uint32)
    buffer = np.empty_like(x)
    for k, (a, b) in enumerate(zip(*_multipliers(n), strict=True)):
        np.multiply(x, a, out=buffer)
        buffer += b
        np.minimum.reduceat(buffer, starts, out=out[k])
    return out.T


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = values[:, : bands * rows].astype(S.U64).reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=S.U64), grouped.shape[:2]).copy()
    for r in range(rows):
        key = S.mix(key ^ grouped[:, :, r])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n values, the fewest matches with which a pair's posterior is still at least ``tolerance``."""
    out = {}
    for n in range(STEP, COMPARED + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def surviving_pairs(sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (one of ``left``, one of ``right``) that size and posterior leave; with left is right, i before j."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(left), 256):
        rows = left[a : a + 256]
        alive = np.minimum(size[rows][:, None], size[right][None]) >= threshold * np.maximum(size[rows][:, None], size[right][None])
        if left is right:
            alive &= np.arange(a, a + len(rows))[:, None] < np.arange(len(right))[None]
        i, j = np.nonzero(alive)
        i, j = rows[i], right[j]
        matches = np.zeros(len(i), np.int32)
        for n, m in least.items():
            if not len(i):
                break
            for c in range(0, len(i), 1 << 16):
                p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                matches[c : c + (1 << 16)] += (sig[p, n - STEP : n] == sig[q, n - STEP : n]).sum(axis=1, dtype=np.int32)
            keep = matches >= m
            i, j, matches = i[keep], j[keep], matches[keep]
        found.append((i, j))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def surviving(sig: np.ndarray, size: np.ndarray, x: int, others: np.ndarray, threshold: float, least: dict[int, int]) -> np.ndarray:
    """Those of ``others`` whose pair with ``x`` size and posterior leave."""
    own = size[others]
    others = others[np.minimum(own, size[x]) >= threshold * np.maximum(own, size[x])]
    matches = np.zeros(len(others), np.int32)
    for n, m in least.items():
        if not len(others):
            break
        matches += (sig[others, n - STEP : n] == sig[x, n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = matches >= m
        others, matches = others[keep], matches[keep]
    return others


def likely_groups(sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, least: dict[int, int]) -> np.ndarray:
    """The root of each row in the graph of surviving pairs of ``left`` and ``right``, found by breadth-first search: a row
    is compared only with rows that no group has reached yet, so a group of similar texts costs about a pass over it
    and not all its pairs."""
    root = np.arange(len(size))
    both = left is right
    free = [np.asarray(right), np.asarray(left)]  # not reached yet, by the side they stand on: right, left
    for start in left.tolist():
        if not both and start not in free[1] or both and start not in free[0]:
            continue
        side = 0 if both else 1
        free[side] = free[side][free[side] != start]
        wave = [(start, 0)]
        while wave:
            x, against = wave.pop()
            found = surviving(sig, size, x, free[against], threshold, least) if len(free[against]) else free[against]
            if len(found):
                root[found] = start
                free[against] = np.setdiff1d(free[against], found, assume_unique=True)
                wave += [(y, 0 if both else 1 - against) for y in found.tolist()]
    return root


def verified_pairs(texts: list[bytes], i: np.ndarray, j: np.ndarray, width: int, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold on the shingles themselves."""
    names: dict[tuple, int] = {}
    own = [np.sort(np.fromiter((names.setdefault(s, len(names)) for s in S.exact_shingles(t, width)), np.int64)) for t in texts]
    size = np.array([len(x) for x in own])
    if len(i) <= 4 * len(texts):
        shared = np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        every, row = np.concatenate(own), np.repeat(np.arange(len(own)), size)
        common = np.flatnonzero(np.bincount(every, minlength=len(names)) > 1)
        place = np.full(len(names), -1)
        place[common] = np.arange(len(common))
        at = place[every]
        row, at = row[at >= 0], at[at >= 0]
        total = np.zeros((len(own), len(own)), np.float32)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for a in range(0, len(common), 4096):
            lo, hi = np.searchsorted(at, (a, a + 4096))
            held = np.zeros((len(own), 4096), np.float32)
            held[row[lo:hi], at[lo:hi] - a] = 1
            total += held @ held.T
        shared = total[i, j].astype(np.int64)
    return shared >= threshold * (size[i] + size[j] - shared) - 1e-9


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of equal key (the first ``keys`` columns) of sorted rows, as (key, the other columns' values)."""
    now, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        n = batch.num_rows
        at = 0
        while at < n:
            key = tuple(c[at] for c in columns[:keys])
            to = at + 1
            while to < n and all(c[to] == k for c, k in zip(columns, key, strict=False)):
                to += 1
            part = [c[at:to] for c in columns[keys:]]
            if key == now:
                for h, p in zip(held, part, strict=True):
                    h += p
            else:
                if held is not None:
                    yield now, held
                now, held = key, part
            at = to
    if held is not None:
        yield now, held


def _in_blocks(rows: DataFrame, key: str, size: Column, block: int) -> DataFrame:
    """Deal each row of a group to the pairs of blocks that it takes part in: columns key, p, q, own, and the others."""
    n = F.ceil(size / block)
    own = F.pmod(F.xxhash64("node"), n)
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    rest = [c for c in rows.columns if c not in (key, "size")]
    return dealt.select(key, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", *rest)


def _sides(own: list[int], p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.asarray(own)
    left = np.flatnonzero(own == p)
    return (left, left) if p == q else (left, np.flatnonzero(own == q))


def similar_classes(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = 48, rows: int = 6, tolerance: float = 1e-6, block: int = 512) -> DataFrame:
    """Per distinct text: node (its MD5), rep (its least doc_id), copies, links (documents of other texts that it is linked
    to), and keeper_id and keeper_node, the least document of its group of links."""
    arrow_batches(docs.sparkSession)
    least = least_matches(threshold, tolerance)
    source = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5("text")).alias("node"), "text")
    n_values = max(bands * rows, COMPARED)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for batch in batches:
            raw, off = S.column_bytes(batch.column(2))
            shingles, at = S.shingle_hashes(*S.word_hashes(raw, off), width)
            full = np.flatnonzero(np.diff(at) > 0)
            values = signatures(shingles, at, n_values) if len(full) else np.zeros((0, n_values), np.uint32)
            size = np.array([len(np.unique(shingles[at[d] : at[d + 1]])) for d in full], np.int64)
            sig: list = [None] * batch.num_rows
            keys: list = [None] * batch.num_rows
            count = np.zeros(batch.num_rows, np.int64)
            count[full] = size
            for d, v, k in zip(full.tolist(), (values[:, :COMPARED] & 0xFF).astype(np.uint8), band_keys(values, bands, rows), strict=True):
                sig[d], keys[d] = v.tobytes(), k.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), pa.array(sig, pa.binary()), pa.array(keys, pa.binary())], ["doc_id", "node", "n", "sig", "keys"])

    signed = source.mapInArrow(sign, "doc_id bigint, node binary, n bigint, sig binary, keys binary")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    nodes = materialize(nodes, "nodes")
    release(docs.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            at = pa.array(np.repeat(np.arange(batch.num_rows), bands))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(at)], ["key", "node"])

    keyed = nodes.filter("n > 0").select("node", "keys").mapInArrow(unpack, "key bigint, node binary")
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").withColumnRenamed("key", "_key")
    met = keyed.join(shared, F.col("key") == F.col("_key")).select("key", "node", "size")
    met = met.join(nodes.select(F.col("node").alias("_node"), "n", "sig"), F.col("node") == F.col("_node")).select("key", "size", "node", "n", "sig")
    dealt = _in_blocks(met, "key", F.col("size"), block)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        us, vs = [], []
        for (_, p, q), (own, node, n, sig) in _groups(batches, 3):
            values = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), COMPARED)
            root = likely_groups(values, np.asarray(n), *_sides(own, p, q), threshold, least)
            for k in np.flatnonzero(root != np.arange(len(node))).tolist():
                us.append(node[k])
                vs.append(node[root[k]])
            if len(us) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    likely = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(prune, "u binary, v binary")
    groups = connected_components(likely)
    release(docs.sparkSession)
    sizes = groups.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("size"))
    groups = groups.join(sizes, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "root", "size")
    info = nodes.select("node", F.col("rep").alias("_rep"), "copies", "n", "sig")
    chosen = groups.join(info, F.col("node") == F.col("_node")).select("root", "size", F.col("node").alias("_node"), "_rep", "copies", "n", "sig")
    held = source.join(chosen, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_rep"))).select("root", "size", "node", "copies", "n", "sig", "text")
    dealt = _in_blocks(held, "root", F.col("size"), block)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_cache()
        for (_, p, q), columns in _groups(batches, 3):
            once = list({x: k for k, x in enumerate(columns[1])}.values())  # repeated rows of one document are one text
            own, node, copies, n, sig, text = ([c[k] for k in once] for c in columns)
            values = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), COMPARED)
            i, j = surviving_pairs(values, np.asarray(n), *_sides(own, p, q), threshold, least)
            if not len(i):
                continue
            real = verified_pairs([t.encode() for t in text], i, j, width, threshold)
            i, j, copies = i[real], j[real], np.asarray(copies)
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            root = forest(len(node), i, j)
            some = np.flatnonzero(links > 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([node[k] for k in some], pa.binary()), pa.array([node[root[k]] for k in some], pa.binary()), pa.array(links[some].astype(np.int64))], ["u", "v", "links"]
            )

    checked = dealt.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(verify, "u binary, v binary, links bigint")
    checked = materialize(checked, "links")
    release(docs.sparkSession)
    linked = connected_components(checked.select("u", "v"))
    counts = checked.groupBy(F.col("u").alias("_u")).agg(F.sum("links").alias("links"))
    firsts = linked.join(nodes.select(F.col("node").alias("_n"), "rep"), F.col("node") == F.col("_n"))
    firsts = firsts.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct("rep", "node")).alias("first"))
    linked = linked.join(firsts, F.col("root") == F.col("_root")).select(F.col("node").alias("_node"), "first")
    out = nodes.select("node", "rep", "copies").join(linked, F.col("node") == F.col("_node"), "left").join(counts, F.col("node") == F.col("_u"), "left")
    first = F.coalesce(F.col("first"), F.struct("rep", "node"))
    # Written, so that a join to it is one of plain shuffles, of which Spark splits a text of many copies over tasks.
    return materialize(out.select("node", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), first["rep"].alias("keeper_id"), first["node"].alias("keeper_node")), "classes")


def join_documents(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its group), n_links (other documents at the threshold or above,
    equal texts included)."""
    classes = similar_classes(docs, **options)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5("text")).alias("_text"))
    met = rows.filter("_text IS NOT NULL").join(classes, F.col("_text") == F.col("node"))
    met = met.select("doc_id", F.col("keeper_id").alias("class_id"), (F.col("copies") - 1 + F.col("links")).cast("bigint").alias("n_links"))
    return met.unionAll(rows.filter("_text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns kept, that are first of their group; rows of null text all stay."""
    classes = similar_classes(docs, **options)
    keepers = classes.filter(F.col("node") == F.col("keeper_node")).select(F.col("node").alias("_node"), F.col("rep").alias("_rep"))
    # Rows travel as one struct, so that no column of theirs can clash with those of the join.
    named = docs.select(F.struct("*").alias("row"), F.unhex(F.md5("text")).alias("_text"), F.col("doc_id").cast("bigint").alias("_doc"))
    kept = named.join(keepers, (F.col("_text") == F.col("_node")) & F.col("_doc").eqNullSafe(F.col("_rep")))
    # Rows that repeat a keeper's id and text: the join has brought them together; one stays.
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("_node", "_rep").orderBy("_rep"))).filter("nth = 1")
    return kept.select("row.*").unionAll(docs.filter("text IS NULL"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT text, min(doc_id) AS rep, count(*) AS copies, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d WHERE text IS NOT NULL GROUP BY text),
s AS (SELECT DISTINCT rep, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM t WHERE len(w) >= 5),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (
  SELECT a.rep AS x, b.rep AS y FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep
  JOIN z za ON za.rep = a.rep JOIN z zb ON zb.rep = b.rep
  GROUP BY a.rep, b.rep HAVING count(*) >= 0.8 * (any_value(za.n) + any_value(zb.n) - count(*)) - 1e-9
), reach(x, y) AS (SELECT rep, rep FROM t UNION SELECT reach.x, p.y FROM reach JOIN p ON p.x = reach.y),
c AS (SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x),
l AS (SELECT p.x AS rep, sum(t.copies) AS links FROM p JOIN t ON t.rep = p.y GROUP BY p.x)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN d.doc_id ELSE c.class_id END AS class_id,
       CASE WHEN d.text IS NULL THEN 0 ELSE t.copies - 1 + coalesce(l.links, 0) END::BIGINT AS n_links
FROM d LEFT JOIN t USING (text) LEFT JOIN c ON c.rep = t.rep LEFT JOIN l ON l.rep = t.rep
"""
