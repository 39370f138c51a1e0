"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

A short test item inside a document of any length has a tiny Jaccard similarity to it, so banded signatures of whole
documents would miss it. Here the sketch is taken of the *items* only. Items are partitioned by size (powers of two);
within a partition with largest size ``u`` every item keeps its ``K = floor((1 - t) u) + margin`` smallest shingle hashes
(its bottom-K MinHash). A document that holds at least ``ceil(t q)`` of an item's ``q`` shingles misses at most
``q - ceil(t q)`` of them, therefore at least ``K - (q - ceil(t q))`` of the sketch are hits: the search loses nothing.
Candidates are then confirmed on the words themselves.

Defined results
---------------
* null, empty or short texts (fewer than ``width`` words), in documents or items: no shingles, never a match;
* repeated document rows or items: each pair of rows is reported; a document or item with a null id keeps the null;
* empty tables: no rows; extra columns of either table are ignored.

Scale: documents are scanned once for each block of items, with no shuffle. Items are dealt to blocks by hash so that a
block's texts stay near ``block_bytes``; only a block is ever broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm import _shingles as S
from assaykit.llm._common import arrow_batches, text_of

SCHEMA = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint, containment double"


class ItemSketches:
    """The sketches of one block of items, ready to probe."""

    def __init__(self, items: list[tuple], width: int, threshold: float, margin: int):
        self.width, self.threshold = width, threshold
        self.ids, self.texts, self.required = [], [], []
        hashes, owners = [], []
        for item_id, text in items:
            raw, off = S.column_bytes(pa.array([text]))
            h = np.unique(S.shingle_hashes(*S.word_hashes(raw, off), width)[0])
            if not len(h):
                continue
            largest = (1 << int(len(h)).bit_length()) - 1
            sketch = h[: math.floor((1 - threshold) * largest + 1e-9) + margin]
            misses = len(h) - math.ceil(threshold * len(h) - 1e-9)
            owners.append(np.full(len(sketch), len(self.ids), np.int32))
            hashes.append(sketch)
            self.ids.append(item_id)
            self.texts.append(text.encode())
            self.required.append(max(1, len(sketch) - misses))
        self.required = np.array(self.required, np.int32)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, S.U64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners = self.hashes[order], owners[order]
        self.front = np.zeros(1 << 20, bool)
        self.front[(self.hashes >> S.U64(44)).astype(np.int64)] = True
        self.sets: dict[int, set] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sets": {}}

    def candidates(self, shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows (document, item) whose sketch hits reach what containment implies."""
        at = np.flatnonzero(self.front[(shingles >> S.U64(44)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, shingles[at], "left")
        n = np.searchsorted(self.hashes, shingles[at], "right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return np.zeros((0, 2), np.int64)
        docs = np.repeat(np.searchsorted(off, at, "right") - 1, n)
        entries = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        hit = np.unique(np.stack((docs, entries), 1), axis=0)
        pairs, hits = np.unique(np.stack((hit[:, 0], self.owners[hit[:, 1]]), 1), axis=0, return_counts=True)
        return pairs[hits >= self.required[pairs[:, 1]]]

    def item_set(self, k: int) -> set:
        if k not in self.sets:
            self.sets[k] = S.exact_shingles(self.texts[k], self.width)
        return self.sets[k]

    def search(self, ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        """Row number, doc_id and item_id, the item's shingles, those shared, and containment, of each match."""
        raw, off = S.column_bytes(texts)
        seen, own = -1, set()
        for d, k in self.candidates(*S.shingle_hashes(*S.word_hashes(raw, off), self.width)).tolist():
            if d != seen:
                seen, own = d, S.exact_shingles(raw[off[d] : off[d + 1]].tobytes(), self.width)
            item = self.item_set(k)
            shared = sum(x in own for x in item)
            if shared >= self.threshold * len(item):
                yield d, ids[d].as_py(), self.ids[k], len(item), shared, shared / len(item)


def find_contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, margin: int = 8, block_bytes: int = 8 << 20
) -> DataFrame:
    """Pairs of a document and an item of which the document holds at least ``threshold`` of the ``width``-word shingles."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    out = None
    for sketches in _blocks(docs, items, width, threshold, margin, block_bytes):

        def probe(batches: Iterator[pa.RecordBatch], sketches=sketches) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.float64()]
            for batch in batches:
                columns = list(zip(*(r[1:] for r in sketches.value.search(batch.column(0), batch.column(1))), strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        found = docs.mapInArrow(probe, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def _blocks(docs: DataFrame, items: DataFrame, width: int, threshold: float, margin: int, block_bytes: int) -> Iterator:
    """Broadcast sketches of the items, a bounded block at a time."""
    spark = docs.sparkSession
    arrow_batches(spark)
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield spark.sparkContext.broadcast(ItemSketches([tuple(r) for r in mine.collect()], width, threshold, margin))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, margin: int = 8, block_bytes: int = 8 << 20) -> DataFrame:
    """The document rows, all columns kept, that hold no item. The scan itself drops rows, so neither join nor shuffle follows."""
    at = [docs.columns.index(c) for c in ("doc_id", "text")]
    for sketches in _blocks(docs, items, width, threshold, margin, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], sketches=sketches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in sketches.value.search(batch.column(at[0]), batch.column(at[1]))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL
), doc_shingles AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s
  FROM doc_words WHERE len(w) >= 5
), item_shingles AS (
  SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s
  FROM item_words WHERE len(w) >= 5
), sizes AS (SELECT item_id, count(*) AS q FROM item_shingles GROUP BY 1)
SELECT doc_id, item_id, any_value(q)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared,
       count(*)::DOUBLE / any_value(q) AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(q)
"""
