"""Structured Streaming forms: ingest by micro-batch, latest decisions, and failure modes by window.

They go beyond the batch engine. Keys of duplicates and conflicts start with the document, so a micro-batch that holds whole
documents gives what one batch over all of them would."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assaykit.plans.runs import run_documents
from assaykit.sources.readers import parse_documents


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, strategy: str = "result_focused") -> StreamingQuery:
    """New files of a folder become curated samples, appended under ``out``; available files are processed, then it stops."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        docs = parse_documents(df.select("path", "content")).filter("error IS NULL")
        run_documents(docs, strategy).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a replayed batch replaces itself

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each sample of a stream, by sequence rather than arrival (complete mode)."""
    return decisions.groupBy("sample_id").agg(F.max_by(F.struct("seq", "decision", "reviewer"), "seq").alias("d")).select("sample_id", "d.*")


def failure_windows(events: DataFrame, time: str = "ts", mode: str = "failure_mode", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failure modes by tumbling window; rows later than ``late`` are left out once their window has closed."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, width), mode).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), mode, "n")
