"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back to its character n-grams, bounded by word
marks, of the longest order of which at least one is known, and scores their mean log frequency; the order falls from
``orders`` to 1. A document's score is the sum over all its words, and the prediction the best language. Words are runs of
letters, lower-cased; runs over ``MAX_RUN`` letters count in pieces.

The posterior of the best language, under equal priors, is 1 for nearly any text of some length, whatever its language. The
score therefore multiplies it with the *fit*: how far the words are known. A word counts 1 if it is in the vocabulary and
``k / (orders + 1)`` if it fell back to order ``k``; a document's mean of that, with ``PRIOR`` words at the language's level
added, is placed between the mean of random letters (fit 0) and the level (fit 1), which is the lowest hundredth of the
language's training documents. Half the way is the natural cutoff.

The model is bounded by documented parameters: it is fitted on ``train_docs`` labelled documents of each language at most,
those of least hash of text and id, and keeps the ``vocabulary`` most frequent words and the ``grams`` most frequent n-grams
of each order; that, at most, is collected and broadcast. Prediction reads every text whole.

Defined results
---------------
* null text, or text without a letter: ``und`` with score 0; repeated rows are predicted each; an empty table: no rows;
* no labelled document: every text is ``und``; ties go to the language that sorts first; very long texts are read whole;
* a null doc_id is predicted and not held out, and takes no part in training; extra columns are kept by :func:`predict`
  (those named as its two results are replaced) and :func:`keep_identified`, and ignored in training.
"""

from __future__ import annotations

import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm._common import arrow_batches, discard, materialize, worker_cache

MAX_RUN = 64
_LETTERS = re.compile(r"[^\W\d_]{1,%d}" % MAX_RUN)
CACHE = 200_000
LARGEST = (1 << 63) - 1
#: Words at the language's level that every document is taken to have besides its own.
PRIOR = 3


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def held_out(doc_id: str = "doc_id") -> Column:
    """The contract's fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Log frequencies of words and n-grams, one column for each language."""

    def __init__(self, words: dict[str, dict[str, int]], grams: list[dict[str, dict[str, int]]], totals: dict[str, list[int]], smoothing: float = 0.5):
        self.langs = sorted(totals)
        total = np.array([totals[x] for x in self.langs], float).T.reshape(len(grams) + 1, -1) if self.langs else np.zeros((len(grams) + 1, 0))

        def logs(counts: dict[str, dict[str, int]], n: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
            table = np.full((len(counts), len(self.langs)), smoothing)
            for i, by_lang in enumerate(counts.values()):
                for lang, c in by_lang.items():
                    table[i, self.langs.index(lang)] += c
            return {w: i for i, w in enumerate(counts)}, np.log(table / (n + smoothing * (len(counts) + 1)))

        self.words = logs(words, total[0])
        self.grams = [logs(g, total[k + 1]) for k, g in enumerate(grams)]
        self.noise, self.levels = 0.0, np.zeros(len(self.langs))

    def calibrate(self, levels: dict[str, float], words: int = 2000) -> None:
        """Set the level of each language, and that of random words over the letters of the model."""
        letters = sorted(c for c in (self.grams[0][0] if self.grams else ()) if c.isalpha())
        rng = random.Random(0)
        made = ["".join(rng.choices(letters, k=rng.randint(4, 10))) for _ in range(words if letters else 0)]
        self.noise = sum(self.unseen(w)[1] if w not in self.words[0] else 1.0 for w in made) / max(len(made), 1)
        self.levels = np.array([levels.get(x, 0.0) for x in self.langs])

    def fit(self, best: int, known: float, words: int) -> float:
        level = float(self.levels[best])
        if level <= self.noise:
            return 1.0
        mean = (known + PRIOR * level) / (words + PRIOR)
        return min(max((mean - self.noise) / (level - self.noise), 0.0), 1.0)

    def unseen(self, word: str) -> tuple[np.ndarray, float]:
        """Scores of a word by its n-grams, and how far it is known."""
        marked = f"<{word}>"
        for order in range(len(self.grams), 0, -1):
            index, table = self.grams[order - 1]
            rows = [r for i in range(len(marked) - order + 1) if (r := index.get(marked[i : i + order])) is not None]
            if rows:
                return table[rows].mean(axis=0), order / (len(self.grams) + 1)
        return np.zeros(len(self.langs)), 0.0


class Scorer:
    """Rows of scores for the words met so far: the vocabulary, then unseen words up to ``CACHE``. The last column says how
    far a word is known."""

    def __init__(self, model: Model):
        self.model = model
        index, table = model.words
        self.rows = dict(index)
        self.table = np.concatenate((np.column_stack((table, np.ones(len(table)))), np.zeros((CACHE, len(model.langs) + 1))))

    def row(self, word: str) -> int:
        at = len(self.rows)
        self.table[at, :-1], self.table[at, -1] = self.model.unseen(word)
        self.rows[word] = at
        return at

    def totals(self, words: list[str]) -> np.ndarray:
        """Sums over the words: the score of each language, and how far they are known."""
        total = np.zeros(len(self.model.langs) + 1)
        for i in range(0, len(words), CACHE):
            some = Counter(words[i : i + CACHE])
            if len(self.rows) + len(some) > len(self.table):
                self.rows = dict(self.model.words[0])
            get, known = self.row, self.rows
            at = [r if (r := known.get(w)) is not None else get(w) for w in some]
            total += np.fromiter(some.values(), float, len(some)) @ self.table[at]
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.model.langs:
            return "und", 0.0
        *scores, known = self.totals(words)
        scores = np.array(scores)
        best = int(np.argmax(scores))
        posterior = float(1 / np.exp(scores - scores[best]).sum())
        return self.model.langs[best], posterior * self.model.fit(best, float(known), len(words))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _grams(marked: Column, order: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(marked) - order + 1)
    return F.transform(starts, lambda i: F.struct(F.lit(order).alias("k"), F.substring(marked, i, F.lit(order)).alias("g")))


def _sample(docs: DataFrame, train_docs: int) -> DataFrame:
    """lang and text of ``train_docs`` labelled documents at most of each language, those of least hash. A first cut by the
    language's share leaves about twice as many to be ranked."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rank = F.xxhash64("text", "doc_id").bitwiseAND(F.lit(LARGEST))
    labelled = labelled.select(F.col("lang").cast("string").alias("lang"), "text", rank.alias("h"), "doc_id")
    below = F.when(F.col("n") <= 2 * train_docs, F.lit(LARGEST)).otherwise((2.0 * train_docs / F.col("n") * float(LARGEST)).cast("bigint"))
    share = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("n")).select("_lang", below.alias("below"))
    # A row for each language, as the model that is broadcast later has a column for each: no text is shuffled to meet it.
    near = labelled.join(F.broadcast(share), (F.col("lang") == F.col("_lang")) & (F.col("h") <= F.col("below")))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    return near.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= train_docs).select("lang", "text")


def train(docs: DataFrame, train_docs: int = 5_000, vocabulary: int = 30_000, orders: int = 5, grams: int = 20_000) -> Model:
    """Fit on the labelled documents outside the held-out fold."""
    arrow_batches(docs.sparkSession)
    sample = materialize(_sample(docs, train_docs), "sample")
    counts = sample.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    marked = counts.select("lang", "n", F.concat(F.lit("<"), "word", F.lit(">")).alias("m"))
    none = F.array().cast("array<struct<k:int,g:string>>")
    pieces = [F.when(F.length("m") >= k, _grams(F.col("m"), k)).otherwise(none) for k in range(1, orders + 1)]
    exploded = marked.select("lang", "n", F.explode(F.concat(*pieces)).alias("p")).select("lang", "p.k", "p.g", "n")
    every = counts.select("lang", F.lit(0).alias("k"), F.col("word").alias("g"), "n").unionAll(exploded.groupBy("lang", "k", "g").agg(F.sum("n").alias("n")))
    every = materialize(every, "frequencies")
    table = every.groupBy("k", "g").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    totals: dict[str, list[int]] = {}
    for r in every.groupBy("lang", "k").agg(F.sum("n").alias("n")).collect():  # one row per language and order
        totals.setdefault(r["lang"], [0] * (orders + 1))[r["k"]] = r["n"]
    kept: list[dict[str, dict[str, int]]] = []
    for k in range(orders + 1):
        best = table.filter(F.col("k") == k).orderBy(F.desc("n"), "g").limit(grams if k else vocabulary)
        kept.append({r["g"]: r["by_lang"] for r in best.collect()})
    model = Model(kept[0], kept[1:], totals)
    if totals:
        known = _with_scores(sample, model, T.StructType.fromDDL("lang string, known double"), _known)
        model.calibrate({r["lang"]: r["level"] for r in known.groupBy("lang").agg(F.percentile_approx("known", F.lit(0.01), F.lit(1000)).alias("level")).collect()})
    discard(every, sample)
    return model


def _known(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
    """How far the words of labelled texts are known; texts without a word are left out."""
    rows = [(lang, scorer.totals(words)[-1] / len(words)) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (words := words_of(t))]
    lang, known = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(known, pa.float64())], ["lang", "known"])


def _with_scores(docs: DataFrame, model: Model, schema: T.StructType, finish) -> DataFrame:
    """``finish(scorer, batch)`` of each Arrow batch."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_cache(("languages", key), lambda: Scorer(shared.value))
        for batch in batches:
            yield finish(scorer, batch)

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def add(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
        lang, score = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    return _with_scores(docs, model, schema, add)


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs``, as they are, that have a language with at least that score."""
    at = docs.columns.index("text")

    def keep(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scorer.predict(t) for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return _with_scores(docs, model, docs.schema, keep)


def identify(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns for every document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    model = train(docs, **options)
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
