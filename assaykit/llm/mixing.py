"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame operations only.

A source's target is its share of all words by weight, stopped at ``cap`` times its size, the excess reshared by weight
(a water level: saturated sources get their cap, the others the level times their weight). The mix is a sequence of slots.
Slot ``t`` maps the golden-ratio point ``t * phi mod 1`` (integer arithmetic modulo 2^31, so that reruns agree bit by bit)
through the cumulative weights to a source; slots are ranked per source, and rank ``r`` takes block ``r mod n_blocks`` of
that source's shuffled documents laid end to end and cut into blocks of ``block_words`` words. There are as many slots as
the targets need blocks, and a source takes what the points draw for it, up to its target: its quota's last slot takes a part
of a block, and slots beyond the quota take nothing. As the points' discrepancy is a few slots, a source's words fall short
of its target by a few blocks at most.

Defined results
---------------
* null or empty text: size 0, taken 0, no slot; a null source is a source of its own, last in order; repeated rows are mixed
  each; very long texts span many blocks;
* null doc_id: shuffled as the text ``null``; an empty table: no rows; extra columns are ignored by :func:`mix_sources` and
  kept by :func:`mixed_documents`.

Scale: texts are read once, for their word counts, which are written to the shared folder. A source of any share is dealt
over hash buckets of about ``bucket_docs`` documents for its running sums, and slots over chunks for their ranks, so no
window holds a source. The join on cells spreads slots evenly, as the points are. Only the table of sources, a row for each,
is ranked and summed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm._common import materialize, n_words, placed, text_of

#: Points lie on a grid of 2^31; the odd number nearest to 2^31 / phi steps through all of it.
GRID = 1 << 31
STEP = 1327217885
CELL = 1 << 19


def targets(docs: DataFrame, weights: tuple[int, ...], cap: int, block_words: int) -> DataFrame:
    """Per source: rank, words, documents, target, words and slots to take, and its interval on the grid."""
    by_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rk") - 1) % len(weights) + 1).cast("int"))
    t = by_source.withColumn("rk", F.row_number().over(order)).withColumn("weight", weight)
    everything = Window.partitionBy()
    upto = Window.orderBy("full_at", "rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (
        t.withColumn("most", F.col("source_size") * cap)
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("below", F.sum("most").over(upto))
        .withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(upto))
        .withColumn("full", F.col("below") + F.col("full_at") * F.col("rest") <= F.col("total"))
        .withColumn("free", F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.try_divide(F.col("free"), F.col("open")) * F.col("weight")))
    )
    blocks = F.ceil(F.col("source_size") / block_words)
    t = (
        t.withColumn("take", F.least(F.round("target").cast("long"), F.col("most")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0)))
        .withColumn("part", F.col("take") - F.col("epochs") * F.col("source_size"))
        .withColumn("n_blocks", blocks)
        .withColumn("quota", F.col("epochs") * F.col("n_blocks") + F.ceil(F.col("part") / block_words))
        .withColumn("n_slots", F.sum("quota").over(everything))
    )
    by_rank = Window.orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = lambda words: F.coalesce(F.floor(F.try_divide(words, F.col("n_slots")) * GRID), F.lit(0)).cast("long")
    t = t.withColumn("hi", edge(F.sum("quota").over(by_rank))).withColumn("lo", edge(F.sum("quota").over(by_rank) - F.col("quota")))
    return t.select("source", "rk", "source_size", "n_docs", "target", "take", "part", "n_blocks", "quota", "n_slots", "lo", "hi")


def schedule(sources: DataFrame, block_words: int, chunk: int = 16384) -> DataFrame:
    """The slots: position, source rank, rank of the slot in its source, and the block and words that it takes."""
    spark = sources.sparkSession
    n = sources.agg(F.max("n_slots")).first()[0] or 0
    slots = spark.range(1, n + 1).select(F.col("id").alias("slot"), F.expr(f"(id % {GRID}L) * {STEP}L % {GRID}L").alias("u")).withColumn("cell", F.expr(f"u div {CELL}L"))
    cells = sources.filter("hi > lo").select("rk", "lo", "hi", F.explode(F.expr(f"sequence(lo div {CELL}L, (hi - 1) div {CELL}L)")).alias("cell"))
    hits = slots.join(cells, "cell").filter("u >= lo and u < hi").select("rk", "slot", F.expr(f"slot div {chunk}L").alias("chunk"))
    counts = hits.groupBy("rk", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("rk").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("rk", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("rk", "chunk").orderBy("slot")
    ranked = hits.join(counts, ["rk", "chunk"]).select("slot", "rk", (F.col("base") + F.row_number().over(own) - 1).alias("rank"))
    every = ranked.join(sources.select("rk", "source_size", "n_blocks", "quota", "part"), "rk").filter("rank < quota")
    length = F.expr(f"least({block_words}L, source_size - block * {block_words}L)")
    last = F.expr(f"part - block * {block_words}L")
    return (
        every.withColumn("block", F.expr("rank % n_blocks"))
        .withColumn("length", length)
        .withColumn("words", F.when((F.col("rank") == F.col("quota") - 1) & (F.col("part") > 0), last).otherwise(length))
        .select("slot", "rk", "rank", "block", "length", "words")
    )


def _mix(docs: DataFrame, key: list[str], weights: tuple[int, ...], cap: int, block_words: int, bucket_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents laid end to end per source, with ``key``; the table of sources; the schedule)."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", n_words(text_of()).alias("size"), order.alias("place"), *key), "sizes")
    sources = materialize(targets(rows, weights, cap, block_words), "sources")
    slots = materialize(schedule(sources, block_words), "slots")
    dealt = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    share = F.expr(f"conv(substr(place, 1, 8), 16, 10) / {float(1 << 32)}")
    dealt = dealt.withColumn("bucket", F.floor(share * F.ceil(F.col("n_docs") / bucket_docs)))
    dealt = dealt.select("doc_id", "size", "place", "rk", "bucket", "source_size", "target", "n_blocks", *key)
    sums = dealt.groupBy("rk", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rk", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("rk", "bucket").orderBy("place", "doc_id", "size", *key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.join(sums, ["rk", "bucket"])
    laid = laid.withColumn("end", F.col("base") + F.sum("size").over(own)).withColumn("n", F.row_number().over(own)).withColumn("start", F.col("end") - F.col("size"))
    return laid, sources, slots


def _taken(laid: DataFrame, slots: DataFrame, key: list[str], block_words: int) -> DataFrame:
    """Per document: the words that the slots take of it, and the first slot that does."""
    is_whole = F.col("words") == F.col("length")
    takes = slots.groupBy("rk", "block").agg(
        F.count_if(is_whole).alias("whole"),
        F.min(F.when(is_whole, F.col("slot"))).alias("whole_slot"),
        F.max(F.when(~is_whole, F.col("words"))).alias("partly"),
        F.min(F.when(~is_whole, F.col("slot"))).alias("part_slot"),
    )
    pieces = laid.withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}L, greatest(start, end - 1) div {block_words}L)")))
    first, last = F.greatest("start", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    pieces = pieces.withColumn("at", first - F.col("block") * block_words).withColumn("held", last - first)
    part = F.least(F.greatest(F.coalesce("partly", F.lit(0)) - F.col("at"), F.lit(0)), F.col("held"))
    slot = F.when(F.col("held") > 0, F.least("whole_slot", F.when(part > 0, F.col("part_slot"))))
    group = ["rk", "bucket", "n", "doc_id", "size", "source_size", "target", *key]
    taken = pieces.join(takes, ["rk", "block"], "left").groupBy(*group).agg(F.sum(F.coalesce("whole", F.lit(0)) * F.col("held") + part).alias("taken"), F.min(slot).alias("first_slot"))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "first_slot", *key)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 128, bucket_docs: int = 1000) -> DataFrame:
    """Per document row: doc_id, size, source_size, target of its source, the words of it that the mix takes, and the first
    slot of the schedule that takes some of them."""
    laid, _, slots = _mix(docs, [], weights, cap, block_words, bucket_docs)
    return _taken(laid, slots, [], block_words)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 128, bucket_docs: int = 1000) -> DataFrame:
    """The mix as documents, all columns kept, in the order of the schedule: each row as often as the mix takes it, to the
    nearest whole number, the k-th time where the k-th pass over its source takes its first word."""
    docs = placed(docs)
    # A row's file and place identify it; rows travel as one struct, so that no column of theirs can clash with the mix's.
    key = ["_file", "_at"]
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_at"))
    plain = rows.select("row.doc_id", "row.text", "row.source", *key)
    laid, _, slots = _mix(plain, key, weights, cap, block_words, bucket_docs)
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    taken = _taken(laid.filter("size > 0"), slots, key, block_words).withColumn("times", times).filter("times > 0").select("times", *[F.col(c).alias(f"{c}2") for c in key])
    places = laid.select("rk", "n_blocks", F.expr(f"start div {block_words}L").alias("block"), *key)
    taken = places.join(taken, [F.col(c) == F.col(f"{c}2") for c in key]).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    taken = taken.withColumn("rank", F.col("block") + F.col("k") * F.col("n_blocks")).select("rk", "rank", "k", *[F.col(f"{c}2") for c in key])
    at = slots.select(F.col("rk").alias("_rk"), F.col("rank").alias("_rank"), "slot")
    # A time whose slot the quota cut off comes after the schedule.
    taken = taken.join(at, (F.col("rk") == F.col("_rk")) & (F.col("rank") == F.col("_rank")), "left").select(F.coalesce("slot", F.lit(GRID) * GRID).alias("slot"), "k", *[f"{c}2" for c in key])
    mixed = rows.join(taken, [F.col(c) == F.col(f"{c}2") for c in key])
    return mixed.repartitionByRange("slot", *key, "k").sortWithinPartitions("slot", *key, "k").select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rk FROM d GROUP BY source
), w AS (SELECT *, [5, 2, 1][((rk - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS most FROM s),
f AS (SELECT *, most / weight AS full_at, sum(source_size) OVER () AS total FROM w),
g AS (
  SELECT *, sum(most) OVER (ORDER BY full_at, rk) + full_at * (sum(weight) OVER () - sum(weight) OVER (ORDER BY full_at, rk)) <= total AS is_full FROM f
), h AS (
  SELECT *, (total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())::DOUBLE AS free,
         (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE AS room FROM g
), t AS (
  SELECT source, rk, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE free / nullif(room, 0) * weight END AS target, most FROM h
), q AS (SELECT *, least(round(target)::BIGINT, most) AS take FROM t),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS epochs, CASE WHEN source_size > 0 THEN take % source_size ELSE 0 END AS part,
         ceil(source_size / 128)::BIGINT AS n_blocks FROM q
), c AS (SELECT *, epochs * n_blocks + ceil(part / 128)::BIGINT AS quota FROM b),
e AS (
  SELECT *, (sum(quota) OVER ())::BIGINT AS n_slots, floor(sum(quota) OVER (ORDER BY rk) / sum(quota) OVER () * 2147483648)::BIGINT AS hi,
         floor((sum(quota) OVER (ORDER BY rk) - quota) / sum(quota) OVER () * 2147483648)::BIGINT AS lo FROM c
), points AS (SELECT i AS slot, (i % 2147483648) * 1327217885 % 2147483648 AS u FROM range(1, coalesce((SELECT max(n_slots) FROM e), 0) + 1) AS t(i)),
drawn AS (SELECT e.*, slot, row_number() OVER (PARTITION BY rk ORDER BY slot) - 1 AS rank FROM points JOIN e ON u >= lo AND u < hi),
used AS (
  SELECT rk, slot, rank % n_blocks AS block, rank = quota - 1 AND part > 0 AS cut,
         CASE WHEN rank = quota - 1 AND part > 0 THEN part - (rank % n_blocks) * 128 ELSE least(128, source_size - (rank % n_blocks) * 128) END AS words,
         least(128, source_size - (rank % n_blocks) * 128) AS length FROM drawn WHERE rank < quota
), p AS (
  SELECT row_number() OVER () AS r, d.doc_id, d.size, q.rk, q.source_size, q.target,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), cells AS (
  SELECT p.*, block, greatest(start, block * 128) - block * 128 AS skip, least(start + size, (block + 1) * 128) - greatest(start, block * 128) AS held
  FROM p, unnest(range(start // 128, greatest(start, start + size - 1) // 128 + 1)) AS u(block)
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       coalesce(sum(greatest(least(words - skip, held), 0)) FILTER (words IS NOT NULL), 0)::BIGINT AS taken, min(slot) FILTER (held > 0 AND words > skip) AS first_slot
FROM cells LEFT JOIN used ON used.rk = cells.rk AND used.block = cells.block GROUP BY r
"""
