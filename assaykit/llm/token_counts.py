"""Offset-mapped token attribution: what share of a document's tokens each of its sections holds.

A document is encoded once, whole, so that its tokens are those that training sees. The token bytes are the text's bytes in
order; running sums of their lengths give character spans, and a sorted interval join places each span in the sections.
A token that meets more than one section is allocated by an explicit rule:

* ``largest`` (default): to the section that holds most of its characters, the earlier on ties;
* ``first``: to the section that holds the first of its characters that any section holds;
* ``split``: to each section in proportion to the characters held.

Sections are half-open code-point intervals, sorted and disjoint; by default each line with its newline is a section.

Defined results
---------------
* null or empty text: one section, empty, with no tokens; characters outside all sections go to section -1, if tokens do;
* a token that ends inside a character spans that character whole; repeated rows are counted each; an empty table: no rows;
* extra columns are ignored.

Scale: one scan without a shuffle; texts are processed one at a time, whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm import _shingles as S
from assaykit.llm._common import arrow_batches, text_of, worker_cache

SCHEMA = "doc_id bigint, section bigint, start bigint, n_chars bigint, n_tokens double, n_crossing bigint"
RULES = ("largest", "first", "split")


class ByteTokens:
    """A byte-level vocabulary of ranks, and the length in bytes of each of its tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The end, in bytes, of each token of ``text``."""
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text)])


def vocabulary(path: str, pattern: str) -> ByteTokens:
    """One copy for each Python worker."""
    return worker_cache(("bytes", path, pattern), lambda: ByteTokens(path, pattern))


def char_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code-point spans of tokens that end at the bytes ``ends``."""
    if not len(ends):
        return ends, ends
    number = np.cumsum((raw & 0xC0) != 0x80)
    first = np.concatenate(([0], ends[:-1]))
    return number[first] - 1, number[ends - 1]


def line_sections(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points, of the lines, each with its newline."""
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    starts = np.concatenate(([0], np.searchsorted(chars, np.flatnonzero(raw == 0x0A)) + 1))
    return starts, np.concatenate((starts[1:], [len(chars)]))


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens and crossing tokens of each section, and the tokens that no section holds."""
    tokens, crossing = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    if not len(begin):
        return tokens, crossing, 0.0
    low = np.searchsorted(ends, begin, "right")  # the first section that ends after the token's start
    high = np.searchsorted(starts, end, "left") - 1  # the last that starts before its end
    tokens += np.bincount(low[low == high], minlength=len(starts))[: len(starts)]
    for b, e, i, j in zip(*(x[low < high].tolist() for x in (begin, end, low, high)), strict=True):
        held = np.minimum(ends[i : j + 1], e) - np.maximum(starts[i : j + 1], b)
        crossing[i : j + 1] += held > 0
        if rule == "split":
            tokens[i : j + 1] += held / held.sum()
        else:
            tokens[i + int(np.argmax(held if rule == "largest" else held > 0))] += 1
    return tokens, crossing, float(np.count_nonzero(low > high))


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "largest", sections: str | None = None) -> DataFrame:
    """Per document and section: its number, start, characters, tokens, and tokens it shares with another section.

    ``sections`` names a column array<struct<start,end>>; without it lines are the sections."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    arrow_batches(docs.sparkSession)
    given = F.col(sections) if sections else F.lit(None)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), given.cast("array<struct<start:bigint,end:bigint>>").alias("sections"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            raw, off = S.column_bytes(batch.column(1))
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, own in enumerate(batch.column(2).to_pylist()):
                data = raw[off[i] : off[i + 1]]
                begin, end = char_spans(data, words.ends(data.tobytes().decode()))
                if own is None:
                    starts, ends = line_sections(data)
                else:
                    starts, ends = (np.array([s[k] for s in own], np.int64) for k in ("start", "end"))
                tokens, crossing, outside = attribute(begin, end, starts, ends, rule)
                number = np.arange(len(starts))
                if outside:
                    number, starts, ends = np.append(number, -1), np.append(starts, -1), np.append(ends, -1)
                    tokens, crossing = np.append(tokens, outside), np.append(crossing, 0)
                for column, x in zip(out, (np.full(len(number), i), number, starts, ends - starts, tokens, crossing), strict=True):
                    column.append(x)
            if not out[0]:
                continue
            flat = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat[0])), *(pa.array(x) for x in flat[1:])], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.mapInArrow(count, SCHEMA)
