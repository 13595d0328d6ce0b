"""Benchmark decontamination by winnowing.

Documents and items are fingerprinted alike: of the word k-gram hashes in every span of 10 words
the least one is kept, so two equal spans keep the same k-gram at the same place. Fingerprints are
joined by hash, and every hit is extended word by word on both sides; runs of 10 or more equal
words are what counts. Items of fewer words are fingerprinted whole, and matched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import table

U = np.uint64
K = 5
#: Bits of the filter that documents test their fingerprints with before they leave the task. Its
#: size is fixed (2 MB); a larger benchmark lets more pass, and the join decides.
FILTER_BITS = 1 << 24
#: A key with more hits than this many, or than one in HEAVY_KEYS of all, is dealt over several tasks; so there
#: are at most HEAVY_KEYS of them.
HOT_ROWS, HEAVY_KEYS = 10_000, 100_000


def _whole(w: tk.Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all m-word spans, salted by m so that they meet only their like."""
    g = tk.mix(tk.grams(w.hash, m) + U(m))
    at = np.flatnonzero(tk.within(w.doc, m))
    return at, g[at]


def _fingerprints(w: tk.Words, span: int, short: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in the fingerprint, starts, hashes)."""
    at = tk.winnow(w, K, span)
    yield K, at, tk.grams(w.hash, K)[at] if len(at) else np.empty(0, U)
    for m in short:
        yield (-m, *_whole(w, m))


def _lower(words: list[bytes]) -> list[str]:
    return [x.lower().decode() for x in words]  # bytes.lower() changes A-Z only


def _context(w: tk.Words, a: int, b: int) -> list[str]:
    d = w.data
    return _lower([d[i:j].tobytes() for i, j in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)])


_OUT = "n_words long, h long, at int, size int, words array<string>, lead int"
_NAMES = ["id", "n_words", "h", "at", "size", "words", "lead"]


def _emit(ids: pa.Array, w: tk.Words, span: int, short_of, keep) -> pa.RecordBatch:
    """One row per document without a fingerprint (h null), and one per kept fingerprint with the words around it."""
    counts = np.diff(w.bounds)
    rows = [(d, None, None, None, None, None) for d in range(w.n_docs)]
    for size, at, h in _fingerprints(w, span, short_of):
        ok = np.flatnonzero(keep(h))
        reach = span - size if size > 0 else 0
        n = abs(size)
        for a, x in zip(at[ok].tolist(), h[ok].view(np.int64).tolist(), strict=True):
            d = int(w.doc[a])
            lo, hi = max(int(w.bounds[d]), a - reach), min(int(w.bounds[d + 1]), a + n + reach)
            rows.append((d, x, a - int(w.bounds[d]), size, _context(w, lo, hi), a - lo))
    d, h, at, size, words, lead = zip(*rows, strict=True)
    d = np.array(d)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(d + w.first)), pa.array(counts[d].astype(np.int64)), pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(lead, pa.int32())], names=_NAMES
    )


def _item_rows(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints of items: winnowed for long ones, whole for short ones."""
    for batch in batches:
        for w in tk.slices(batch.column(1), tk.ALNUM_LOWER):
            counts = np.diff(w.bounds)
            short = sorted({int(c) for c in counts if 0 < c < span})
            out = _emit(batch.column(0), w, span, short, lambda h: np.ones(len(h), bool))
            size = out.column(4).to_numpy(zero_copy_only=False)
            n = out.column(1).to_numpy()
            # a short item is one window; its own winnowed spans and shorter whole spans don't count
            keep = ~np.isnan(size) & np.where(n < span, size == -n, size == K)
            yield out.filter(pa.array(keep))


def _filter_bits(h: np.ndarray) -> np.ndarray:
    x = h.view(np.uint64)
    return np.stack([x & U(FILTER_BITS - 1), (x >> U(24)) & U(FILTER_BITS - 1)])


def _longest(words: list[str], lead: int, other: list[str], other_lead: int, n: int) -> tuple[int, int]:
    """The run of equal words around the fingerprint, as (words before its start, words from its start)."""
    if words[lead : lead + n] != other[other_lead : other_lead + n]:
        return 0, 0
    back = 0
    while back < min(lead, other_lead) and words[lead - back - 1] == other[other_lead - back - 1]:
        back += 1
    on = n
    while lead + on < len(words) and other_lead + on < len(other) and words[lead + on] == other[other_lead + on]:
        on += 1
    return back, on


def _keyed(rows: DataFrame, side: int) -> DataFrame:
    """Rows by ``key``: a whole short item's hash, else the fingerprint with the ``side`` words after it, and with those before it.

    A run of ``span`` equal words around a fingerprint of K has half of its other words on one side at
    least, so it meets by one of the two keys; a phrase of K words that is everywhere isn't a key itself.
    """
    words = lambda start: F.slice("words", start, side)
    after = F.when(F.size("words") >= F.col("lead") + K + side, F.xxhash64(F.lit(1), "h", words(F.col("lead") + K + 1)))
    before = F.when(F.col("lead") >= side, F.xxhash64(F.lit(2), "h", words(F.col("lead") - side + 1)))
    keys = F.when((F.col("size") < 0) | F.lit(side == 0), F.array("h")).otherwise(F.array_compact(F.array(after, before)))
    return rows.select("*", F.explode(keys).alias("key")).drop("h")


def _met(hits: DataFrame, prints: DataFrame) -> DataFrame:
    """Hits and prints of equal keys. A heavy key's hits are dealt by document and place, and its prints go to each share."""
    counts = hits.groupBy("key").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, -(-total // HEAVY_KEYS))
    # fewer than total / most keys, so never more than HEAVY_KEYS
    heavy = F.broadcast(counts.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("shares")))
    dealt = lambda df: df.join(heavy, "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    hits = dealt(hits).withColumn("share", F.pmod(F.xxhash64("doc_id", "at"), F.col("shares").cast("long")).cast("int")).drop("shares")
    prints = dealt(prints).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return hits.join(prints, ["key", "share"])


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = 10) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is ``span``
    consecutive words of an item, or the whole item where it has fewer (but some). A document's word
    is hit if any occurrence of a window covers it. items_sha256 is the SHA-256 of the ids of the items
    found, sorted as strings and comma-joined (of the empty string where there are none). Null and empty
    texts have no words; items without words or id match nothing; repeated items count once; rows of
    null id have their words counted and are never contaminated; rows that repeat an id share its
    result; empty tables give an empty result or nothing hit. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    source = items.select(F.col(item_col).alias("id"), F.col(item_text).cast("string")).where("id is not null").distinct()
    prints = table(source.mapInArrow(lambda b: _item_rows(b, span), f"id {item_kind}, {_OUT}"), "benchmark-prints")

    bits = prints.select(F.explode(F.array(F.col("h").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("h", 24).bitwiseAND(FILTER_BITS - 1))).alias("bit")).distinct()
    short = sorted(-r[0] for r in prints.where("size < 0").select("size").distinct().collect())  # at most span - 1 lengths
    # the filter is a bitmap of fixed size, however many fingerprints there are
    words = bits.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("v"))
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toPandas()
    bitmap[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value

        def keep(h: np.ndarray) -> np.ndarray:
            a, b = _filter_bits(h)
            return (test[a >> U(6)] >> (a & U(63)) & test[b >> U(6)] >> (b & U(63)) & U(1)).astype(bool)

        for batch in batches:
            for w in tk.slices(batch.column(1), tk.ALNUM_LOWER):
                yield _emit(batch.column(0), w, span, short, keep)

    scanned = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(scan, f"id {kind}, {_OUT}")
    scanned = table(scanned.withColumnRenamed("id", "doc_id"), "benchmark-hits")

    side = max(0, -(-(span - K) // 2))
    theirs = _keyed(prints.select("h", F.col("id").alias("item_id"), "size", "words", "lead"), side).select("key", "item_id", F.col("size").alias("isize"), F.col("words").alias("iwords"), F.col("lead").alias("ilead"))
    ours = _keyed(scanned.where("h is not null and doc_id is not null").select("doc_id", "h", "at", "size", "words", "lead"), side)
    met = _met(ours, theirs).where("size = isize")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("at", "size", "words", "lead", "iwords", "ilead")}
            start, stop, ok = [], [], []
            for i, (at, size, words, lead, other, other_lead) in enumerate(zip(*c.values(), strict=True)):
                back, on = _longest(words, lead, other, other_lead, abs(size))
                if back + on >= (span if size > 0 else -size) > 0:
                    ok.append(i)
                    start.append(at - back)
                    stop.append(at + on)
            ok = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(ok), batch.column("item_id").take(ok), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["doc_id", "item_id", "start", "stop"])

    hits = met.mapInArrow(extend, f"doc_id {kind}, item_id {item_kind}, start int, stop int")
    # one exchange by document: its items and its runs, each once; both are bounded by the document's own words and hits
    by_doc = hits.groupBy("doc_id").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"), F.collect_set(F.struct("start", "stop")).alias("runs"))
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["stop"] - 1)))
    found = by_doc.select("doc_id", F.array_join(F.array_sort("ids"), ",").alias("ids"), F.size("ids").cast("long").alias("n_items"), F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    base = scanned.where("h is null").select("doc_id", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(found, "doc_id", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
