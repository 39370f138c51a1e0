"""Every labelled stratum is certified, whatever their number."""

from pyspark.sql import functions as F

from assaykit.llm import quality_rules


def test_no_stratum_is_left_out(spark):
    n, each = 1030, 60
    x = F.when(F.col("id") % each < 2, F.lit(0.97)).otherwise(F.lit(0.0))
    rows = spark.range(n * each).select(F.floor(F.col("id") / each).cast("string").alias("stratum"), (F.col("id") % each >= 2).alias("good"), *[x.alias(r) for r in quality_rules.RULES])
    assert quality_rules.thresholds(rows, 0.9, 0.05).filter(" AND ".join(f"{r} IS NOT NULL" for r in quality_rules.RULES)).count() == n
