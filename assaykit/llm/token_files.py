"""Token-ID output in the Arrow stream-file (IPC file) format with fixed-size-list batches.

Documents are encoded whole, each is closed with an end id, and the ids of one range of documents are laid end to end and
cut into sequences of ``seq_len`` ids. A part is two Arrow files:

* ``part-NNNNN.ids.arrow``: ``ids`` fixed_size_list<uintN>[seq_len] and ``mask`` fixed_size_list<bool>[seq_len] (true for
  ids, false for the padding that ends the part). Uncompressed, so a memory map gives sequence ``i`` without a copy.
* ``part-NNNNN.docs.arrow``: ``doc_id``, ``start`` (position in the part) and ``n_tokens``.

Ids are stored in two bytes where the vocabulary allows, else in four.

Defined results
---------------
* null or empty text: only the end id; null doc_id sorts first; rows with the same id are ordered by text;
* an empty table: no parts; extra columns are ignored; very long texts are streamed, a batch of sequences at a time.

Scale: one range shuffle by doc_id, then each task streams its part to the shared folder under an attempt's own name and
renames it when complete, so a retried or speculative task leaves the same file. The driver sees one row per part.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import _shingles as S
from assaykit.llm._common import arrow_batches, text_of, worker_cache

RESULT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
SEQUENCES_PER_BATCH = 256
#: The settings of tokenizer files that :class:`WordEncoder` may take apart.
FAST = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
BLANKS = " \t\n\x0b\f\r"
#: Pieces over so many bytes are hashed one at a time.
LONG = 256
LETTER, DIGIT, MARK, OTHER = 1, 2, 3, 4
_ODD = S.U64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], S.U64)


def _kinds() -> np.ndarray:
    """The kind of each byte; 0 for white space."""
    kinds = np.full(256, OTHER, np.uint8)
    for c in range(0x21, 0x7F):
        kinds[c] = LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK
    kinds[[ord(c) for c in BLANKS]] = 0
    kinds[ord("'")] = OTHER
    return kinds


_KINDS = _kinds()


class Part(NamedTuple):
    part: int
    uri: str
    n_docs: int
    n_tokens: int


class PieceTable:
    """Pieces of text that were encoded before, in flat arrays: sorted keys, and each key's bytes and ids.

    A key only proposes; :meth:`find` compares the bytes. A table that has come to hold ``bound`` bytes starts anew with the
    next texts."""

    def __init__(self, dtype: np.dtype, bound: int):
        self.dtype, self.bound = dtype, bound
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, S.U64), np.zeros(0, np.int64)
        self.text, self.text_at = np.zeros(8, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def make_room(self) -> None:
        if self.keys.nbytes * 4 + self.text.nbytes + self.ids.nbytes > self.bound:
            self.clear()

    def find(self, keys: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 for those that the table lacks."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        slot = np.where(self.keys[at] == keys, self.slots[at], -1)
        known = np.flatnonzero(slot >= 0)
        own = self.text_at[slot[known]]
        same = self.text_at[slot[known] + 1] - own == size[known]
        same[same] = equal_bytes(raw, start[known][same], self.text, own[same], size[known][same])
        slot[known[~same]] = -1
        return slot

    def add(self, keys: np.ndarray, texts: list[bytes], ids: list[bytes]) -> None:
        n = len(self.text_at) - 1
        text_size, id_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (texts, ids))
        self.text = np.concatenate((self.text[:-8], np.frombuffer(b"".join(texts), np.uint8), np.zeros(8, np.uint8)))
        self.text_at = np.concatenate((self.text_at, self.text_at[-1] + np.cumsum(text_size)))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(ids), self.dtype)))
        self.ids_at = np.concatenate((self.ids_at, self.ids_at[-1] + np.cumsum(id_size // self.dtype.itemsize)))
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, place, keys[order])
        self.slots = np.insert(self.slots, place, n + order)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number; ``raw`` ends in eight bytes of padding."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def equal_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes of ``a`` from ``at`` are those of ``b`` from ``bt``."""
    one, two, same = _eights(a), _eights(b), np.ones(len(at), bool)
    rest, k = np.flatnonzero(size > 0), 0
    while len(rest) and k < LONG:
        left = np.minimum(size[rest] - k, 8)
        same[rest] &= ((one[at[rest] + k] ^ two[bt[rest] + k]) & _MASK[left]) == 0
        k += 8
        rest = rest[size[rest] > k]
    for i in rest.tolist():  # the ends of very long ones
        n = int(size[i])
        same[i] &= bool((a[at[i] + k : at[i] + n] == b[bt[i] + k : bt[i] + n]).all())
    return same


def piece_keys(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each piece's bytes and length."""
    eights, key = _eights(raw), size.astype(S.U64)
    short = size <= LONG
    rest, k = np.flatnonzero(short), 0
    while len(rest):
        key[rest] = S.mix(key[rest] * _ODD ^ (eights[start[rest] + k] & _MASK[np.minimum(size[rest] - k, 8)]))
        k += 8
        rest = rest[size[rest] > k]
    for i in np.flatnonzero(~short).tolist():
        key[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]].tobytes())
    return key


def cut_pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of the pieces, and whether a piece is a word to be encoded as it is.

    A plain word falls into runs of letters, single digits and runs of marks, as the tokenizer file has it; a word with any
    other character, an apostrophe, or the beginning of a special token is one piece."""
    kind = _KINDS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    latin = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = LETTER
    kind[:-1][(raw[:-1] == 0x3C) & (raw[1:] == 0x7C)] = OTHER
    ink = kind > 0
    edge = np.diff(ink.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    if (odd := np.flatnonzero(kind == OTHER)).size:
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = np.unique(np.searchsorted(first, odd, "right") - 1)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[first[words]] += 1
        inside[last[words]] -= 1
        kind[np.cumsum(inside[:-1], dtype=np.int8) > 0] = OTHER
    low = raw.copy()
    letters = kind == LETTER
    low[letters & (raw >= 0x41) & (raw <= 0x5A)] += 32
    latin = latin[letters[latin] & (raw[latin + 1] < 0x9F)] + 1
    low[latin] += 32
    begins = ink & (kind == DIGIT)
    begins[1:] |= ink[1:] & (kind[1:] != kind[:-1])
    begins[:1] |= ink[:1]
    start = np.flatnonzero(begins)
    stops = ink.copy()
    stops[:-1] &= begins[1:] | ~ink[1:]
    return low, start, np.flatnonzero(stops) + 1, kind[start] == OTHER


class WordEncoder:
    """Whole-text encoding; fast for the tokenizer files whose settings are ``FAST``.

    Such a tokenizer lower-cases, drops white space and never joins text across it, so the ids of a text are those of its
    pieces in turn. Texts are cut into pieces by array operations, equal pieces are found by key and confirmed by bytes, and
    the library encodes those that the table lacks, many to a call. With any other file the library encodes whole texts."""

    def __init__(self, path: str, bound: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        added = [t["content"] for t in settings.get("added_tokens") or ()]
        fixed = {k: settings.get(k) for k in FAST} == FAST and settings["model"].get("type") == "BPE" and not settings["model"].get("dropout")
        self.fast = fixed and all(t.startswith("<|") and not any(c in BLANKS for c in t) for t in added)
        self.table = PieceTable(self.dtype, bound)

    def _packed(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece is one pre-token: joined by blanks, the k-th pre-token of the encoding is the k-th piece."""
        out: list[bytes] = []
        for i in range(0, len(pieces), 2000):
            some = pieces[i : i + 2000]
            e = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            ids, words = np.asarray(e.ids, self.dtype), np.asarray(e.word_ids, np.int64)
            cut = (np.searchsorted(words, np.arange(len(some) + 1)) * self.dtype.itemsize).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        return out

    def _encode_bytes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces of ``raw`` (ending in eight blanks) end to end, where each piece starts, and its first id."""
        low, start, end, odd = cut_pieces(raw)
        size = end - start
        keys, at, which = np.unique(piece_keys(low, start, size), return_index=True, return_inverse=True)
        if not equal_bytes(low, start, low, start[at][which], size).all() or (size != size[at][which]).any():
            return self._apart(low, start, end, odd)
        self.table.make_room()
        slot = self.table.find(keys, low, start[at], size[at])
        if (missing := np.flatnonzero(slot < 0)).size:
            texts = [low[start[i] : end[i]].tobytes() for i in at[missing].tolist()]
            own = odd[at[missing]]
            ids: list = [b""] * len(texts)
            for some, encoded in ((np.flatnonzero(~own).tolist(), self._encode_pieces), (np.flatnonzero(own).tolist(), lambda x: self._whole([t.decode() for t in x]))):
                for i, x in zip(some, encoded([texts[i] for i in some]), strict=True):
                    ids[i] = x
            self.table.add(keys[missing], texts, ids)
            slot = self.table.find(keys, low, start[at], size[at])
            if (slot < 0).any():  # a key of the table with other bytes
                return self._apart(low, start, end, odd)
        first, count = self.table.ids_at[slot], self.table.ids_at[slot + 1] - self.table.ids_at[slot]
        first, count = first[which], count[which]
        ends = np.cumsum(count)
        flat = self.table.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)]
        return flat, start, np.concatenate(([0], ends))

    def _apart(self, low: np.ndarray, start: np.ndarray, end: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same without the table, for two pieces of one key."""
        texts = [low[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids = [self._whole([t.decode()])[0] if o else self._encode_pieces([t])[0] for t, o in zip(texts, odd.tolist(), strict=True)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // self.dtype.itemsize
        return np.frombuffer(b"".join(ids), self.dtype), start, np.concatenate(([0], ends))

    def encode(self, raw: memoryview | bytes) -> bytes:
        return next(self.encode_column(pa.array([bytes(raw)], pa.binary())))

    def encode_column(self, column: pa.Array, piece: int = 1 << 19) -> Iterator[bytes]:
        """Ids of each row, as bytes of ``dtype``; pieces are looked up for about ``piece`` bytes of texts at a time."""
        raw, off = S.column_bytes(column)
        i, n = 0, len(off) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + piece, "right")) - 1)
            if not self.fast:
                yield from self._whole([raw[off[k] : off[k + 1]].tobytes().decode() for k in range(i, j)])
            else:
                ends = off[i + 1 : j + 1] - off[i]
                part = np.append(np.insert(raw[off[i] : off[j]], ends, 0x0A), np.full(8, 0x0A, np.uint8))  # rows end in a line feed
                flat, start, at = self._encode_bytes(part)
                cut = at[np.searchsorted(start, ends + np.arange(1, j - i + 1))]
                data, cut = flat.tobytes(), (np.concatenate(([0], cut)) * self.dtype.itemsize).tolist()
                for a, b in zip(cut, cut[1:], strict=False):
                    yield data[a:b]
            i = j


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that its cache serves all tasks that the worker runs."""
    return worker_cache(("words", path), lambda: WordEncoder(path))


def _list_type(kind: pa.DataType, seq_len: int) -> pa.DataType:
    return pa.list_(pa.field("item", kind, nullable=False), seq_len)


class PartWriter:
    """Streams one part; at most a batch of sequences is held."""

    def __init__(self, uri: str, part: int, dtype: np.dtype, seq_len: int):
        self.fs, self.dir = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.dir, recursive=True)
        self.part, self.dtype, self.seq_len = part, dtype, seq_len
        self.attempt = uuid.uuid4().hex
        kind = pa.from_numpy_dtype(dtype)
        self.ids_schema = pa.schema([("ids", _list_type(kind, seq_len)), ("mask", _list_type(pa.bool_(), seq_len))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = {k: self.fs.open_output_stream(self._name(k, self.attempt)) for k in ("ids", "docs")}
        self.ids_file = pa.ipc.new_file(self.out["ids"], self.ids_schema)
        self.docs_file = pa.ipc.new_file(self.out["docs"], self.docs_schema)
        self.held: list[bytes] = []
        self.held_bytes = self.n_tokens = self.n_docs = 0
        self.rows: list[tuple] = []

    def _name(self, kind: str, attempt: str = "") -> str:
        return f"{self.dir}/" + (f"_attempt-{attempt}-" if attempt else "") + f"part-{self.part:05d}.{kind}.arrow"

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.rows.append((doc_id, self.n_tokens, n))
        self.n_tokens += n
        self.n_docs += 1
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= SEQUENCES_PER_BATCH * self.seq_len * self.dtype.itemsize:
            self._flush(last=False)
        if len(self.rows) >= 20_000:
            self._flush_rows()

    def _flush_rows(self) -> None:
        if self.rows:
            self.docs_file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=self.docs_schema))
            self.rows = []

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), self.dtype)
        real = len(flat)
        whole = real // self.seq_len * self.seq_len
        if last and real > whole:
            whole += self.seq_len
            flat = np.concatenate((flat, np.zeros(whole - real, self.dtype)))
        step = SEQUENCES_PER_BATCH * self.seq_len
        for a in range(0, whole, step):
            part = flat[a : min(a + step, whole)]
            mask = np.arange(a, a + len(part)) < real
            self.ids_file.write_batch(
                pa.RecordBatch.from_arrays(
                    [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t.type) for x, t in zip((part, mask), self.ids_schema, strict=True)], schema=self.ids_schema
                )
            )
        rest = flat[whole:].tobytes() if whole < len(flat) else b""
        self.held, self.held_bytes = [rest], len(rest)

    def close(self) -> tuple[int, str, int, int]:
        self._flush(last=True)
        self._flush_rows()
        for f, kind in ((self.ids_file, "ids"), (self.docs_file, "docs")):
            f.close()
            self.out[kind].close()
            self.fs.move(self._name(kind, self.attempt), self._name(kind))
        return self.part, self._name("ids"), self.n_docs, self.n_tokens


class PartReader:
    """Random access to the sequences of a part, without a copy where the file system can map files."""

    def __init__(self, uri: str, part: int):
        fs, folder = pafs.FileSystem.from_uri(uri)
        name = f"{folder}/part-{part:05d}"
        opened = pa.memory_map if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file
        self.ids = pa.ipc.open_file(opened(f"{name}.ids.arrow"))
        self.docs = pa.ipc.open_file(opened(f"{name}.docs.arrow"))
        self.seq_len = self.ids.schema.field("ids").type.list_size

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        batch = self.ids.get_batch(i // SEQUENCES_PER_BATCH) if self._even() else None
        row = i % SEQUENCES_PER_BATCH
        if batch is None:
            k = int(np.searchsorted(self._starts, i, "right")) - 1
            batch, row = self.ids.get_batch(k), i - int(self._starts[k])
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values

    def _even(self) -> bool:
        if not hasattr(self, "_starts"):
            sizes = [self.ids.get_batch(k).num_rows for k in range(self.ids.num_record_batches)]
            self._starts = np.concatenate(([0], np.cumsum(sizes)))[:-1] if sizes else np.zeros(1, np.int64)
            self._all_even = all(s == SEQUENCES_PER_BATCH for s in sizes[:-1])
        return self._all_even

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the part, n_tokens, crc32 of the ids as little-endian 32-bit integers), in file order."""
        k, flat, base = -1, np.zeros(0, np.uint16), 0
        for d in range(self.docs.num_record_batches):
            batch = self.docs.get_batch(d)
            for doc_id, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                crc, at, left = 0, start, n
                while left:
                    while at >= base + len(flat):
                        base += len(flat)
                        k += 1
                        column = self.ids.get_batch(k).column(0)
                        flat = column.flatten().to_numpy(zero_copy_only=True)
                    some = flat[at - base : at - base + left]
                    crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
                    at, left = at + len(some), left - len(some)
                yield doc_id, start, n, crc


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int, seq_len: int = 2048, order: tuple[str, ...] = ("doc_id",)) -> list[Part]:
    """Encode all documents, in ascending order of the columns ``order`` and then of text, into files under ``uri``; returns
    the parts in order."""
    arrow_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        end = np.asarray([end_id], words.dtype).tobytes()
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                writer = PartWriter(uri, TaskContext.get().partitionId(), words.dtype, seq_len)
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode_column(batch.column(1)), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            part, name, n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([n_tokens])], ["part", "file", "n_docs", "n_tokens"])

    place = [f"_place{k}" for k in range(len(order))]
    placed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), *[F.col(c).alias(p) for c, p in zip(order, place, strict=True)])
    placed = placed.repartitionByRange(*place).sortWithinPartitions(*place, "text")
    rows = placed.select("doc_id", "text").mapInArrow(write, "part int, file string, n_docs bigint, n_tokens bigint").collect()
    return [Part(r.part, uri, r.n_docs, r.n_tokens) for r in sorted(rows, key=lambda r: r.part)]


def read_token_files(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """One row per document from the files: doc_id, ids before it, its ids, and their checksum."""
    if not parts:
        return spark.createDataFrame([], RESULT)
    base, plan = 0, []
    for p in parts:
        plan.append((p.uri, p.part, base))
        base += p.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                uri, part, before = plan[k]
                rows = [(d, before + start, n, crc) for d, start, n, crc in PartReader(uri, part).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(plan), 1, len(plan)).mapInArrow(read, RESULT)
