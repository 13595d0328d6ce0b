"""Capture of delivery notices as a stream: each receipt once, a session's newest snapshot wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def receipts(notices: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each receipt once: notices repeated within the watermark go. ``ts`` is the event time."""
    return notices.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["receipt_id"])


def sessions(notices: DataFrame) -> DataFrame:
    """Newest snapshot of each (host, session): snapshots are cumulative, so the longest supersedes the rest."""
    return notices.groupBy("host", "session_id").agg(F.max(F.struct("n_bytes", "receipt_id")).alias("newest"), F.count("*").alias("notices")).select("host", "session_id", "newest.n_bytes", "newest.receipt_id", "notices")


#: Parts that a session store is kept in; a batch rewrites those that it touches.
PARTS = 64
STORED = "host string, session_id string, n_bytes long, receipt_id string, notices long, epoch long, part int"


def _part():
    return F.pmod(F.xxhash64("host", "session_id"), F.lit(PARTS)).cast("int")


def state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The store's sessions as of the last epoch (before ``before``): of each part its newest version."""
    rows = spark.read.schema(STORED).option("basePath", path).parquet(f"{path}/epoch=*")
    if before is not None:
        rows = rows.where(F.col("epoch") < before)
    newest = rows.groupBy("part").agg(F.max("epoch").alias("epoch"))
    return rows.join(newest, ["part", "epoch"], "left_semi").select("host", "session_id", "n_bytes", "receipt_id", "notices")


def upsert_into(path: str):
    """A foreachBatch sink that keeps the newest row per session; a replayed batch changes nothing, an empty one writes nothing.

    Sessions are dealt over PARTS by hash. A batch reads and rewrites only the parts that it touches, under
    its epoch; versions of those parts that are older than the one it was built from are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = batch.select("host", "session_id", "n_bytes", "receipt_id", F.lit(1).cast("long").alias("notices"))
        if batch.isEmpty():
            return
        touched = [r.part for r in rows.select(_part().alias("part")).distinct().collect()]  # PARTS rows at most
        files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        at = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *x]))
        epochs = sorted(int(x.getPath().getName()[6:]) for x in files.listStatus(at()) if x.getPath().getName().startswith("epoch=")) if files.exists(at()) else []
        if any(e < epoch for e in epochs):
            rows = rows.unionByName(state(spark, path, epoch).where(_part().isin(touched)))
        newest = rows.groupBy("host", "session_id").agg(F.max(F.struct("n_bytes", "receipt_id")).alias("n"), F.sum("notices").alias("notices"))
        out = newest.select("host", "session_id", "n.n_bytes", "n.receipt_id", "notices", _part().alias("part"))
        out.write.mode("overwrite").partitionBy("part").parquet(f"{path}/epoch={epoch}")
        for part in touched:
            held = [e for e in epochs if e < epoch and files.exists(at(f"epoch={e}", f"part={part}"))]
            for e in held[:-1]:
                files.delete(at(f"epoch={e}", f"part={part}"), True)

    return write


def snapshots(files: DataFrame) -> DataFrame:
    """``(path, content)`` of logs that are still written to, as of their last line break: what follows it is ignored.

    Digests of the whole lines and of the last record, the number of records, and whether a committed line doesn't parse.
    """
    text = F.decode("content", "UTF-8")
    whole = F.regexp_extract(text, r"(?s)^(.*\n)", 1)
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x) != "")
    size = F.octet_length(whole)
    return files.select(
        "path", size.alias("complete_size"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("content_sha256"), F.sha2(F.encode(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")), "UTF-8"), 256).alias("last_record_sha256"), F.size(lines).alias("n_records"),
        F.exists(lines, lambda x: ~F.coalesce(F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT"), F.lit(False))).alias("malformed"), (F.octet_length("content") - size).alias("ignored_tail_bytes"),
    )


def reconcile(receipts: DataFrame) -> DataFrame:
    """What to do with each receipt: a committed one is done, one that a committed snapshot of its session covers is superseded, the rest is replayed."""
    newest = receipts.where("status = 'committed'").groupBy("session_id").agg(F.max("n_bytes").alias("newest"))
    decision = F.when(F.col("status") == "committed", "done").when(F.col("n_bytes") <= F.col("newest"), "superseded").otherwise("replay")
    return receipts.join(newest, "session_id", "left").select("receipt_id", decision.alias("decision"))


def version_append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows with the version they expect: accepted at the stored version of their key, a conflict at any other; a key's first row expects 0."""
    now = stored.groupBy("key").agg(F.max("version").alias("version"))
    return new.join(now, "key", "left").withColumn("outcome", F.when(F.col("expected") == F.coalesce("version", F.lit(0)), "accepted").otherwise("conflict"))


def activity(events: DataFrame, size: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
