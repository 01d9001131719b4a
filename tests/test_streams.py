"""Streams in event time: late rows, idle keys, and a state that shrinks."""

from datetime import UTC, datetime, timedelta

from fieldlens.streaming import incremental

START = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "k long, frame long, p double, at timestamp"


def batch(spark, folder, number, rows):
    """Rows (key, frame, score, second) as one file, later than those before it."""
    df = spark.createDataFrame([(k, f, p, START + timedelta(seconds=s)) for k, f, p, s in rows], SCHEMA)
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return number


def run(spark, folder, checkpoint, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    events = incremental.timed_opportunity_events(stream, "k", "frame", "p", "at", "10 seconds", 30_000, 0.5, 3)
    query = events.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert not query.isActive  # a stream with idle keys ends
    return [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


def test_late_rows_and_idle_keys_over_three_batches(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, checkpoint, out = tmp_path / "in", tmp_path / "cp", tmp_path / "out"
    try:
        first = [(k, f, 0.9, f) for k in range(20) for f in range(4)]  # twenty keys open an opportunity at frame 2
        batch(spark, source, 1, first)
        state = run(spark, source, checkpoint, out)
        assert state[-1]["numRowsTotal"] == 20
        second = [(0, f, 0.1, f) for f in range(4, 7)] + [(0, 2, 0.1, 6)]  # a miss, and a frame that was seen
        batch(spark, source, 2, second)
        state = run(spark, source, checkpoint, out)
        assert state[-1]["numRowsTotal"] == 20
        third = [(99, 0, 0.9, 120), (99, 1, 0.9, 121)]  # the others have been idle for long
        batch(spark, source, 3, third)
        state = run(spark, source, checkpoint, out)
        assert state[-1]["numRowsTotal"] == 1
        batch(spark, source, 4, [(5, 4, 0.9, 20), (99, 2, 0.9, 122)])  # behind the watermark: dropped
        state = run(spark, source, checkpoint, out)
        assert state[-1]["numRowsTotal"] == 1
        assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = sorted((r.k, r.frame, r.event) for r in spark.read.parquet(str(out)).collect())
    expect = [(k, 2, "open") for k in range(20)] + [(0, 2, "late"), (0, 6, "miss"), (0, 6, "end"), (99, 2, "open")] + [(k, 3, "end") for k in range(1, 20)]
    assert got == sorted(expect)
