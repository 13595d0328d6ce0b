"""Proportional stratified interleaving of rows into shards, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Rows that one window partition should hold; parts grow in number, not in size.
ROWS_PER_PART = 20_000
HASH_SPAN = 1 << 32


def _running(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Rows counted per ``keys`` and part, with the rows of all earlier parts as ``before`` and of all parts as ``total``."""
    counts = df.groupBy(*keys, part).agg(F.count("*").alias("rows"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.select(
        *keys,
        part,
        (F.sum("rows").over(w.orderBy(part)) - F.col("rows")).alias("before"),
        F.sum("rows").over(w).alias("total"),
    )


def stratified_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: str = "source", shards: int = 16, seed: str = "7") -> DataFrame:
    """One row per input row: ``doc_id, stratum, size, text_crc32, seeded, rank, shard, slot``.

    Rows are ordered within each stratum by a seeded hash of the id (ties by id, then by text
    checksum and size), row r of n gets the fractional rank (2r - 1) / 2n, and the whole table,
    ordered by fractional rank (ties by stratum and seeded order), is cut into ``shards`` runs
    whose row counts differ by one at most. So each shard has every stratum's share to within a
    row or so. Row i of N is in shard floor(i * shards / N), with gapless slots from 0.

    Neither ranking sorts a stratum or the table in one task: the seeded hash and the fractional
    rank are spread evenly, so rows are counted by equal ranges of them, running sums over those
    few counts give each range its offset, and only rows within one range are numbered by a window.
    The number of ranges grows with the rows. Text never moves; only ids, sizes and checksums do.

    Null text counts as no bytes (size 1, checksum 0), a null stratum is a stratum of its own, a null
    id is hashed as the empty string; repeated rows get slots of their own; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("seeded", seeded).withColumn("stratum", F.coalesce("stratum", F.lit("\u0000null")))
    spread = F.conv(F.substring("seeded", 1, 8), 16, 10).cast("long")
    n = docs.agg(F.count("*").alias("n"))
    parts = (F.col("n") / ROWS_PER_PART).cast("long") + 1
    n = n.select(F.col("n").alias("all_rows"), parts.alias("parts"))

    def numbered(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
        """1-based numbers of the rows in ``order`` among the rows of equal ``keys``."""
        at = _running(df, keys, "part")
        w = Window.partitionBy(*keys, "part").orderBy(*order)
        # the running sums are one row per key and part: small, and joined without a hint so that their size decides
        return df.withColumn("in_part", F.row_number().over(w)).join(at, [*keys, "part"]).withColumn("number", F.col("before") + F.col("in_part")).drop("in_part", "before", "part")

    ties = ["seeded", "doc_id", "text_crc32", "size"]
    a = rows.crossJoin(F.broadcast(n)).withColumn("part", F.floor(spread * F.col("parts") / F.lit(HASH_SPAN)))  # n is a single row
    a = numbered(a, ["stratum"], ties).withColumnRenamed("number", "rank")
    a = a.withColumn("fraction", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("total")).cast("double")).drop("total")
    b = a.withColumn("part", F.floor(F.col("fraction") * F.col("parts")))
    b = numbered(b, [], ["fraction", "stratum", *ties])
    i = F.col("number") - 1
    return (
        b.withColumn("i", i)
        .withColumn("shard", F.expr(f"i * {shards} div all_rows").cast("int"))
        .withColumn("slot", F.expr(f"i - (shard * all_rows + {shards - 1}) div {shards}").cast("long"))
        .select("doc_id", F.when(F.col("stratum") != "\u0000null", F.col("stratum")).alias("stratum"), "size", "text_crc32", "seeded", "rank", "shard", "slot")
    )
