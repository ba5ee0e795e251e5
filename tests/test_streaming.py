import shutil

from pyspark.sql import functions as F

from graphwright.streaming import telemetry

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(EVENTS, folder / "a.parquet")
    stream = telemetry.windowed_actions(telemetry.distinct_events(telemetry.on_time(telemetry.read_events(spark, str(folder)))))
    q = stream.writeStream.format("memory").queryName("actions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(str(r["start"]), r["action"]): r["n"] for r in spark.table("actions").collect()}
    finally:
        q.stop()
    batch = telemetry.windowed_actions(spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp")))
    expected = {(str(r["start"]), r["action"]): r["n"] for r in batch.collect()}
    # The last window stays open until the watermark passes its end.
    assert got and all(expected[k] == n for k, n in got.items())
    assert {k[0] for k in expected} - {k[0] for k in got} <= {max(k[0] for k in expected)}
