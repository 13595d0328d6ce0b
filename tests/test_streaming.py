from pyspark.sql import functions as F

from tracelake.streaming import capture

SCHEMA = "receipt_id string, host string, session_id string, n_bytes long, ts timestamp"


def notices(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "receipt_id string, host string, session_id string, n_bytes long, at string")
        df.select("receipt_id", "host", "session_id", "n_bytes", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


ROWS = [[("r1", "h", "s", 10, "2026-01-01 00:00:00"), ("r1", "h", "s", 10, "2026-01-01 00:00:01")], [("r2", "h", "s", 30, "2026-01-01 00:10:00"), ("r1", "h", "s", 10, "2026-01-01 00:00:02")], [("r3", "h", "s", 20, "2026-01-01 00:11:00")]]


def test_each_receipt_once(spark, tmp_path):
    q = capture.receipts(notices(spark, tmp_path, ROWS)).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.receipt_id for r in spark.table("once").collect()) == ["r1", "r2", "r3"]


def test_newest_snapshot_and_replay(spark, tmp_path):
    out = str(tmp_path / "state")
    q = notices(spark, tmp_path, ROWS).writeStream.foreachBatch(capture.upsert_into(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = capture.state(spark, out).collect()
    assert [(r.receipt_id, r.n_bytes) for r in last] == [("r2", 30)]
    batch = spark.createDataFrame([("r3", "h", "s", 20)], "receipt_id string, host string, session_id string, n_bytes long")
    capture.upsert_into(out)(batch, 2)  # the same epoch again
    assert [tuple(r) for r in capture.state(spark, out).collect()] == [tuple(r) for r in last] and last[0].notices == 5
    other = spark.createDataFrame([("r9", "h", f"s{i}", 5) for i in range(40)], "receipt_id string, host string, session_id string, n_bytes long")
    capture.upsert_into(out)(other, 3)
    assert capture.state(spark, out).count() == 41
    capture.upsert_into(out)(batch, 4)
    assert len([p for p in (tmp_path / "state").glob("epoch=*/part=*") if list(p.glob("*.parquet"))]) <= 2 * capture.PARTS


def test_batch_sessions_agree(spark):
    rows = [(r[0], r[1], r[2], r[3]) for b in ROWS for r in b]
    got = capture.sessions(spark.createDataFrame(rows, "receipt_id string, host string, session_id string, n_bytes long")).first()
    assert (got.receipt_id, got.n_bytes, got.notices) == ("r2", 30, 5)
