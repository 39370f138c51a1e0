"""Quality rules with risk-controlled thresholds; DataFrame operations only.

Each rule is a ratio of a document; a document is rejected where the ratio exceeds its stratum's cutoff. Cutoffs come from a
fixed grid. For every stratum, rule and grid value the labelled holdout gives ``k`` rejections among ``n`` good documents,
and the cutoff is certified if an exact binomial (Clopper-Pearson) test at level ``delta / (strata * rules * grid values)``
(Bonferroni) shows that its false rejection rate is below ``alpha / rules``. Hence, with probability ``1 - delta``, the rules
together reject less than ``alpha`` of the good documents of every stratum. Of the certified cutoffs a rule takes the one
with the largest gap between the rejection rates of bad and good documents, the most lenient on ties, and none if no gap is
positive. Documents that fail the base rules are no part of the holdout, as they never reach these rules.

Defined results
---------------
* null or empty text: no words, so ``base_failed``; a null stratum is a stratum of its own;
* labels with a null doc_id or quality are left out, repeated labels count once; a stratum without enough labels certifies
  nothing, so that the method keeps its documents; no labels at all: every cutoff is open;
* an empty table: no rows; extra columns of either table are ignored; repeated rows are judged each.

Scale: texts are read once. Repeats within a text are found inside its row, by sorting hashes of its windows, without a
shuffle. The features are written to the shared folder; labels meet them in one join. Every labelled stratum has its
thresholds, which are broadcast up to ``BROADCAST`` strata and joined as Spark sees fit beyond, with the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm._common import GAP, SPACE, materialize, text_of

#: Strata whose thresholds are broadcast.
BROADCAST = 1024
#: The symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "capitals", "repeats", "doubles")
GRID = tuple(round(0.05 * k, 2) for k in range(1, 20))


def _bind(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeat_words(words: str = "words") -> Column:
    """Words in three-word windows that stand in the array twice or more, each word once."""
    windows = _bind(
        f"transform({words}, w -> xxhash64(w))", "h", "transform(sequence(0, size(h) - 3), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2)))"
    )
    ordered = "array_sort(transform(v, (x, i) -> struct(x AS x, i AS i)))"
    repeated = _bind(ordered, "s", "filter(s, (e, i) -> coalesce(get(s, i - 1).x = e.x, false) OR coalesce(get(s, i + 1).x = e.x, false))")
    covered = f"aggregate(array_sort(transform({repeated}, e -> e.i)), struct(0L AS c, -3 AS p), (a, i) -> struct(a.c + least(3, i - a.p) AS c, i AS p), a -> a.c)"
    return F.expr(f"CASE WHEN size({words}) < 4 THEN 0L ELSE {_bind(windows, 'v', f'CASE WHEN size(array_distinct(v)) = size(v) THEN 0L ELSE {covered} END')} END")


def features(docs: DataFrame, stratum: str | None) -> DataFrame:
    text = text_of()
    words = F.filter(F.split(text, GAP), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    group = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    f = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), group.alias("stratum"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    f = f.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words().alias("n_repeat_words"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return f.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumns(
        {"symbols": ratio("n_symbols", "word_chars"), "capitals": ratio("n_capitals", "word_chars"), "repeats": ratio("n_repeat_words", "n_words"), "doubles": ratio("n_dup_lines", "n_lines")}
    )


def _log_gamma(x: str) -> str:
    """Stirling's series at x + 10, brought back by the recurrence."""
    y = f"({x} + 10D)"
    back = " + ".join(f"ln({x} + {k}D)" for k in range(10))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {y}) - 1D / (360D * pow({y}, 3)) + 1D / (1260D * pow({y}, 5)) - ({back}))"


def log_binomial_tail(k: str, n: str, p: float) -> Column:
    """ln P(X <= k) for X binomial (n, p), 0 where k is not below its mean.

    Terms fall from k downwards there; those beyond 20 standard deviations are below what a double can add."""
    top = f"({_log_gamma(f'({n} + 1D)')} - {_log_gamma(f'({k} + 1D)')} - {_log_gamma(f'({n} - {k} + 1D)')} + {k} * {math.log(p)!r}D + ({n} - {k}) * {math.log1p(-p)!r}D)"
    odds = (1 - p) / p
    steps = f"sequence(0L, least({k}, cast(20 * sqrt({n}) AS bigint) + 50))"
    total = f"aggregate({steps}, struct(0D AS s, 1D AS t), (a, j) -> struct(a.s + a.t AS s, a.t * ({k} - j) / ({n} - {k} + j + 1) * {odds!r}D AS t), a -> a.s)"
    return F.expr(f"CASE WHEN {k} >= {n} * {p!r}D THEN 0D ELSE {top} + ln({total}) END")


def thresholds(holdout: DataFrame, alpha: float, delta: float) -> DataFrame:
    """One row per stratum with a cutoff for each rule (null: open). ``holdout``: stratum, good, and the rules' ratios."""
    grid = F.array(*map(F.lit, GRID))
    long = holdout.select("stratum", "good", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])).alias("r"))
    binned = long.select("stratum", "good", "r.rule", F.size(F.filter(grid, lambda c: F.col("r.x") > c)).alias("bin"))
    counts = binned.groupBy("stratum", "rule", "bin").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    whole = Window.partitionBy("stratum", "rule")
    counts = counts.withColumns({"n_good": F.sum("good").over(whole), "n_bad": F.sum("bad").over(whole)})
    at = counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))))
    hit = F.col("bin") > F.col("j")
    at = at.groupBy("stratum", "rule", "j", "n_good", "n_bad").agg(F.sum(F.when(hit, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("caught"))
    total = holdout.agg(F.count_distinct("stratum").alias("n_strata"))
    at = at.crossJoin(F.broadcast(total)).withColumn("log_p", log_binomial_tail("k", "n_good", alpha / len(RULES)))
    level = F.log(F.lit(delta) / (F.col("n_strata") * len(RULES) * len(GRID)))
    gap = F.coalesce(F.try_divide(F.col("caught"), F.col("n_bad")) - F.try_divide(F.col("k"), F.col("n_good")), F.lit(0.0))
    best = at.withColumn("gap", gap).filter((F.col("log_p") <= level) & (F.col("gap") > 0))
    best = best.groupBy("stratum", "rule").agg(F.max(F.struct("gap", "j")).alias("b")).withColumn("cut", F.get(grid, F.col("b.j")))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cut"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Per document: the base counts, base_failed, and kept."""
    f = materialize(features(docs, stratum), "features")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).alias("good")).distinct()
    holdout = f.filter(~F.col("base_failed")).join(known, F.col("doc_id") == F.col("_id")).select("stratum", "good", *RULES)
    cuts = materialize(thresholds(holdout, alpha, delta).select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"cut_{r}") for r in RULES]), "cuts")
    few = cuts.count() <= BROADCAST
    judged = f.join(F.broadcast(cuts) if few else cuts, F.col("stratum") == F.col("_stratum"), "left")
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), wins AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM d, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 3
), reps AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wins) WHERE c > 1
), cov AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM reps, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
f AS (
  SELECT d.r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_capitals, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbols, coalesce(n_capitals / nullif(word_chars, 0), 0) AS capitals,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeats, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS doubles FROM f
), h AS (
  SELECT stratum, rule, x, good FROM (
    UNPIVOT (SELECT b.stratum, l.quality > 0 AS good, symbols, capitals, repeats, doubles
             FROM b JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL) l USING (doc_id) WHERE NOT base_failed)
    ON symbols, capitals, repeats, doubles INTO NAME rule VALUE x)
), a AS (
  SELECT stratum, rule, c, count_if(good)::BIGINT AS n, count_if(NOT good)::BIGINT AS n_bad, count_if(good AND x > c)::BIGINT AS k, count_if(NOT good AND x > c)::BIGINT AS caught
  FROM h, (SELECT round(0.05 * g, 2)::DOUBLE AS c FROM range(1, 20) AS t(g)) GROUP BY ALL
), p AS (
  SELECT *, caught / nullif(n_bad, 0) - k / nullif(n, 0) AS gap, (SELECT count(DISTINCT stratum) FROM h) AS n_strata,
         CASE WHEN k >= n * 0.0125 THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
           lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(1 - 0.0125)))) END AS tail FROM a
), cuts AS (
  SELECT stratum, rule, arg_max(c, (gap, c)) AS cut FROM p WHERE gap > 0 AND tail <= 0.05 / (n_strata * 4 * 19) GROUP BY ALL
), v AS (
  SELECT b.r, bool_or((rule = 'symbols' AND symbols > cut) OR (rule = 'capitals' AND capitals > cut) OR (rule = 'repeats' AND repeats > cut)
                   OR (rule = 'doubles' AND doubles > cut)) AS rejected
  FROM b JOIN cuts USING (stratum) GROUP BY b.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN v USING (r)
"""
