"""Secret scans; DataFrame operations only.

Three base rules (assignments, access keys, hexadecimal runs) give labelled secrets. Beyond them, every run of ``LEAST``
characters or more from the key alphabet is compared under two character Markov models of order one, of random strings and of
ordinary identifiers. A run whose mean log-likelihood ratio per transition exceeds the margin, and that meets no base span,
is added as kind ``markov``; nothing but the ratio decides.

Labelled samples: random strings are the values that the base rules found, and generated ones (digests in several spellings);
ordinary identifiers are the runs of 8 to ``LEAST`` - 1 characters outside base matches, and identifiers put together from
neighbouring words of the corpus in several spellings, with numbers. Samples are dealt to two halves by hash: one trains the
models, the other gives the margin from its samples of ``LEAST`` characters or more: half the way from the level that a share
of ``alarms`` of its ordinary identifiers exceeds to the one that as few of its random strings miss, and never below the first.

Spans count code points, end exclusive. Matches are leftmost and non-overlapping per kind; the text between matches comes
from splitting at the same pattern, so positions are sums of lengths, whatever characters the text holds.

Defined results
---------------
* null or empty text: no spans, the hash of the empty string; repeated rows are scanned each; extra columns are ignored;
* a null doc_id is kept; very long texts are scanned whole, and a run of any length is one run;
* an empty table: no rows; a corpus without secrets or words trains on the generated strings and the smoothing alone, with
  the margin ``MARGIN``.

Scale: one scan, no shuffle; training reads about ``train_docs`` documents, those of least hash of text and id (rows that
agree in both count once), and reduces them to at most ``len(ALPHABET)^2`` counts before anything reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm._common import discard, materialize, text_of

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns, the group whose length counts, and the least length.
BASE = (
    (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    (r"AKIA[A-Z0-9]+", 0, 16),
    (r"[0-9a-f]+", 0, 32),
)
#: A maximal run below the least length holds no longer match, so the scan may ask for the length at once.
FAST = (BASE[0][0], r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = r"[A-Za-z0-9+/_-]{16,}"
IDENTIFIER = r"[A-Za-z0-9+/_-]{8,}"
LEAST = 16
MARGIN = 1.0
LARGEST = (1 << 63) - 1
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of all matches whose group is long enough, in order."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap"))
    pieces = F.filter(pieces, lambda x: x["m"].isNotNull())

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    none = F.array().cast(SPAN)
    folded = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(text.rlike(pattern), folded).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    return [_spans(text, FAST[k], BASE[k][1], BASE[k][2], k) for k in range(3)]


def _codes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def transition_counts(values: DataFrame) -> DataFrame:
    """Counts of neighbouring alphabet characters in column ``value``: a, b, n."""
    codes = values.select(F.filter(_codes(F.col("value")), lambda c: c >= 0).alias("c"))
    pairs = codes.filter(F.size("c") > 1).select(F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c")).alias("b"))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """Generated samples in column ``value``: digests of the numbers below ``n`` in base 64, hexadecimal and their like."""
    ids = spark.range(0, n, 1, 4).select(F.sha2(F.concat(F.lit("sample-"), F.col("id")), 256).alias("h"))
    plain = F.translate(F.base64(F.unhex("h")), "=", "")
    forms = F.array(plain, F.translate(plain, "+/", "-_"), F.translate(plain, "+/", ""), F.upper(F.translate(plain, "+/", "")), F.lower(F.translate(plain, "+/", "")), F.col("h"), F.upper("h"))
    return ids.select(F.explode(forms).alias("value"))


def compound_identifiers(texts: DataFrame, one_in: int = 16) -> DataFrame:
    """Generated samples in column ``value``: identifiers of three neighbouring words of ``text``, one in ``one_in`` of them by
    hash, each in the spelling that its hash picks; and numbers, with and without a word."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,12}"), F.lit(0))
    threes = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.slice("w", i + 1, 3))
    three = texts.select(words.alias("w")).filter(F.size("w") >= 3).select(F.explode(threes).alias("w")).withColumn("h", F.xxhash64("w").bitwiseAND(F.lit(LARGEST)))
    three = three.filter(F.col("h") % one_in == 0).withColumn("h", F.expr(f"h div {one_in}"))
    low = [F.lower(F.get("w", k)) for k in range(3)]
    number = F.substring(F.expr("h div 8").cast("string"), -16, 16)
    forms = [
        F.concat(low[0], *[F.initcap(x) for x in low[1:]]),
        F.concat(*[F.initcap(x) for x in low]),
        F.concat_ws("_", *low),
        F.concat_ws("-", *low),
        F.concat_ws("/", *low),
        F.upper(F.concat_ws("_", *low)),
        F.concat(low[0], F.lit("_"), low[1], F.substring(number, 1, 6)),
        number,
    ]
    return three.select(F.get(F.array(*forms), (F.col("h") % 8).cast("int")).alias("value"))


def labelled_samples(docs: DataFrame, train_docs: int, generated: int) -> DataFrame:
    """value, random (whether it is a random string) and half (0 trains, 1 gives the margin)."""
    n = docs.count()
    below = LARGEST if n <= train_docs else int(train_docs / n * LARGEST)
    rows = docs.select(text_of().alias("text"), F.xxhash64(text_of(), F.col("doc_id")).bitwiseAND(F.lit(LARGEST)).alias("h")).filter(F.col("h") <= below)
    sample = materialize(rows.groupBy("h").agg(F.first("text").alias("text")).select("text"), "sample")
    found = sample.select(F.concat(*base_spans(F.col("text"))).alias("s")).select(F.explode("s.value").alias("value"))
    blank = F.col("text")
    for p in FAST:
        blank = F.regexp_replace(blank, p, " ")
    ordinary = sample.select(F.explode(F.regexp_extract_all(blank, F.lit(IDENTIFIER), F.lit(0))).alias("value")).filter(F.length("value") < LEAST)
    ordinary = ordinary.unionAll(compound_identifiers(sample.select(blank.alias("text"))))
    both = found.unionAll(random_strings(docs.sparkSession, generated)).withColumn("random", F.lit(True)).unionAll(ordinary.withColumn("random", F.lit(False)))
    return both.withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)))


def train(docs: DataFrame, train_docs: int = 20_000, generated: int = 2_000, smoothing: float = 0.5, alarms: float = 0.001) -> tuple[list[float], float]:
    """Log-likelihood ratios, random over ordinary, of each pair of alphabet characters; and the margin."""
    samples = materialize(labelled_samples(docs, train_docs, generated), "samples")
    both = None
    for label in (True, False):
        own = transition_counts(samples.filter((F.col("half") == 0) & (F.col("random") == label))).withColumn("k", F.lit(int(not label)))
        both = own if both is None else both.unionAll(own)
    k = len(ALPHABET)
    counts = [[[0.0] * k for _ in range(k)] for _ in range(2)]
    for r in both.collect():  # at most 2 * len(ALPHABET)^2 rows
        counts[r.k][r.a][r.b] += r.n
    one, two = (_log_transitions(c, smoothing) for c in counts)
    model = [round(one[a][b] - two[a][b], 4) for a in range(k) for b in range(k)]
    held = samples.filter((F.col("half") == 1) & F.col("value").rlike(f"^{RUN}$")).select("random", _score(F.col("value"), model_column(model)).alias("x"))
    at = lambda label, share: F.percentile_approx(F.when(F.col("random") == label, F.col("x")), F.lit(share), F.lit(10_000))
    ordinary, random = held.agg(at(False, 1 - alarms), at(True, alarms)).first()
    discard(samples)
    if ordinary is None:
        return model, MARGIN
    return model, max(ordinary, (ordinary + random) / 2) if random is not None else ordinary


def model_column(model: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")


def _log_transitions(counts: list[list[float]], smoothing: float, weight: float = 5.0) -> list[list[float]]:
    """Log probabilities of the next character. A row leans on how often each character follows any other, with the weight
    of ``weight`` observations: a character that identifiers seldom hold says nothing about its successors by itself."""
    k = len(counts)
    follows = [smoothing + sum(row[b] for row in counts) for b in range(k)]
    share = [f / sum(follows) for f in follows]
    return [[math.log((row[b] + weight * share[b]) / (sum(row) + weight)) for b in range(k)] for row in counts]


def _score(value: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a run's transitions."""
    k = len(ALPHABET)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(-1).alias("p"))

    def step(a: Column, c: Column) -> Column:
        return F.struct((a["s"] + F.when(a["p"] < 0, F.lit(0.0)).otherwise(F.get(model, a["p"] * k + c))).alias("s"), c.alias("p"))

    return F.aggregate(_codes(value), start, step, lambda a: a["s"]) / F.greatest(F.length(value) - 1, F.lit(1))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def scan(docs: DataFrame, trained: tuple[list[float], float] | None = None, **options) -> DataFrame:
    """Per document: doc_id, text, its base spans and those that the models add, as arrays of (start, kind, end, value).

    ``trained`` is what :func:`train` returned, so that a model can serve other documents; else these documents train one."""
    table, margin = trained or train(docs, **options)
    model = model_column(table)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    d = d.select("doc_id", "text", *[s.alias(k) for s, k in zip(base_spans(F.col("text")), KINDS, strict=False)], _spans(F.col("text"), RUN, 0, LEAST, 3).alias("runs"))
    likely = F.filter("runs", lambda r: _score(r["value"], model) > margin)
    both = F.array(F.struct(F.concat("assign", "access", "hex").alias("base"), likely.alias("runs")))
    apart = F.transform(both, lambda s: F.filter(s["runs"], lambda r: ~F.exists(s["base"], lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))))
    return d.select("doc_id", "text", "assign", "access", "hex", F.element_at(apart, 1).alias("markov"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of :func:`scan`'s rows."""
    base = F.concat("assign", "access", "hex")
    return scanned.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.concat(base, "markov")).alias("spans"),
    )
