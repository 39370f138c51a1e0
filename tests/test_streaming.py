import json

from pyspark.sql import functions as F

from assaykit.streaming import jobs


def test_ingest_and_windows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    doc = {"doc_id": "d", "title": "t", "year": 2024, "license": "MIT", "tables": [{"id": "T", "page": 1, "rows": [{"Sample": "S", "Mass (mg)": "5"}]}]}
    (folder / "d.json").write_text(json.dumps(doc))
    q = jobs.ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("value_num", "bucket").collect()[0].asDict() == {"value_num": 5.0, "bucket": "gold"}
    rows = [(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 01:10:00", "b")]
    spark.createDataFrame(rows, "seq int, ts string, failure_mode string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("seq int, ts timestamp, failure_mode string").parquet(str(tmp_path / "events"))
    q = jobs.failure_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.failure_mode, r.n) for r in spark.table("windows").collect()} == {("a", 2), ("b", 1)}
