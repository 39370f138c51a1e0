"""Contamination cases must not get lost."""

from pyspark.sql import functions as F

from assaykit.operators import score


def test_cases_look_beyond_the_first_samples(spark):
    rows = spark.range(20).select(F.array(F.col("id").cast("int")).alias("ord"), F.col("id").cast("string").alias("id"), F.lit(1.0).alias("value_num"))
    step = F.array(F.struct(F.lit("read").alias("action")))
    item = F.array(F.struct(F.lit("5").alias("span_text")))
    late = rows.withColumns({"evidence": F.when(F.col("ord")[0] >= 10, item).otherwise(F.slice(item, 1, 0)), "path": F.when(F.col("ord")[0] >= 10, step).otherwise(F.slice(step, 1, 0))})
    assert {r.case for r in score.contaminate(late).collect()} == {name for name, _ in score.CASES}
