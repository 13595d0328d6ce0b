"""Leader clustering: each row joins the most similar running centroid, or the most similar growing token set, or leads a cluster of its own."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

#: Rows that are clustered together; a larger bucket is cut into blocks of so many in order.
BLOCK = 20_000


class Leaders:
    """The clusters of one block; a centroid is the mean of its rows so far."""

    def __init__(self, threshold: float):
        self.threshold, self.ids, self.n = threshold, [], []
        self.means = np.empty((0, 0))

    def place(self, id_, vector: np.ndarray):
        """The leader of the cluster that a row joins; of equally similar ones the first. A zero vector leads its own."""
        k = len(self.ids)
        if k and self.means.shape[1] == len(vector):
            means = self.means[:k]
            norm = np.sqrt((means * means).sum(axis=1)) * np.sqrt((vector * vector).sum())
            like = np.divide(means @ vector, norm, out=np.zeros(k), where=norm > 0)
            at = int(like.argmax())
            if like[at] > 0 and like[at] >= self.threshold:
                self.n[at] += 1
                self.means[at] = (self.means[at] * (self.n[at] - 1) + vector) / self.n[at]
                return self.ids[at]
        if k == len(self.means) or self.means.shape[1] != len(vector):
            grown = np.zeros((max(16, 2 * k), len(vector)))
            if k:
                grown[:k] = self.means[:k]
            self.means = grown
        self.means[k] = vector
        self.ids.append(id_)
        self.n.append(1)
        return id_


def _in_blocks(known: DataFrame, block: int) -> tuple[DataFrame, int]:
    """``(bucket, ord, id, block, part)`` and how many parts there are: the keys in order within their bucket, cut into blocks.

    Places are by ranges, so no task sorts a bucket. A part holds the blocks that begin within an eighth of a
    block's rows in the whole order: a full block and what small ones begin beside it, or small ones only.
    """
    keys = numbered(known.select("bucket", "ord", "id").distinct(), "bucket", "ord", "id")
    first = keys.groupBy("bucket").agg(F.min("place").alias("first"))
    at = F.floor((F.col("place") - F.col("first")) / block).cast("long")
    span = max(1, block // 8)
    placed = keys.join(first, "bucket").select("bucket", "ord", "id", at.alias("block"), F.floor((F.col("first") + at * block) / span).cast("int").alias("part"))
    return placed, keys.count() // span + 1


def leader_clusters(rows: DataFrame, bucket: str, order: str, *, id_col: str = "id", vector_col: str = "vector", threshold: float = 0.6, block: int = BLOCK) -> DataFrame:
    """``(bucket, block, id, leader)``: each row's cluster, named by the row that leads it, rows taken in ``order`` (ties by id).

    A row joins the cluster whose centroid (the mean of its rows so far) is most similar by cosine, if that
    reaches the threshold. Clusters lie within a bucket, and in a bucket of more than ``block`` rows within
    a block of so many in order, so that no task walks a whole hot bucket. A task streams its rows and holds
    one block's centroids. Vectors of one bucket have one length. Rows of null id, bucket or vector take no
    part; an empty table gives none.
    """
    kind, place = rows.schema[id_col].dataType.simpleString(), rows.schema[bucket].dataType.simpleString()
    known = rows.select(F.col(bucket).alias("bucket"), F.col(order).alias("ord"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("bucket is not null and id is not null and vector is not null")
    ranked, parts = _in_blocks(known, block)
    dealt = known.join(ranked, ["bucket", "id", "ord"]).repartitionById(parts, F.col("part")).sortWithinPartitions("bucket", "block", "ord", "id").select("bucket", "block", "id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            flat, off = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(batch.column(3).value_lengths().to_numpy())))
            out = []
            for i, (key, id_) in enumerate(zip(keys, batch.column(2).to_pylist(), strict=True)):
                if key != now:
                    now, leaders = key, Leaders(threshold)
                out.append(leaders.place(id_, flat[off[i] : off[i + 1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, batch.column(2).type)], names=["bucket", "block", "id", "leader"])

    return dealt.mapInArrow(run, f"bucket {place}, block long, id {kind}, leader {kind}")


class Growing:
    """Clusters as growing token sets, found by an inverted index: a token's clusters are an array of their numbers."""

    def __init__(self, threshold: float):
        self.threshold, self.names, self.held, self.index, self.sizes = threshold, [], [], {}, np.zeros(16, np.int64)

    def _add(self, at: int, tokens: set[str]) -> None:
        fresh = tokens - self.held[at]
        self.held[at] |= fresh
        self.sizes[at] += len(fresh)
        for t in fresh:
            own = self.index.get(t)
            if own is None:
                own = self.index[t] = array("q")
            own.append(at)

    def open(self, name: str, tokens: set[str]) -> str:
        if len(self.names) == len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.names.append(name)
        self.held.append(set())
        self._add(len(self.names) - 1, tokens)
        return name

    def place(self, name: str, tokens: set[str]) -> str:
        """The cluster of most overlap (of equals the first), which takes the tokens; one of its own below the threshold."""
        known = [np.frombuffer(self.index[t], np.int64) for t in tokens if t in self.index]
        if not known:
            return self.open(name, tokens)
        k = len(self.names)
        shared = np.bincount(np.concatenate(known), minlength=k)
        del known  # an array can't grow while it is looked at
        like = shared / (len(tokens) + self.sizes[:k] - shared)
        best = int(like.argmax())
        if like[best] < self.threshold:
            return self.open(name, tokens)
        self._add(best, tokens)
        return self.names[best]


def lexical_clusters(rows: DataFrame, *, threshold: float = 0.28, block: int = BLOCK) -> DataFrame:
    """``(bucket, block, id, cluster)`` of observations ``(bucket, ord, id, label, tokens)``.

    Rows with a label are its cluster (block 0). The others are taken in order (ties by id): each joins the
    cluster whose tokens overlap most by Jaccard, if that reaches the threshold, and adds its own; labels'
    clusters come first (by their first row), then the ones that opened. A cluster without a label is named
    by the id that opened it. A bucket of more than ``block`` unlabelled rows is cut into blocks of so many
    in order: each starts from the labels' clusters and knows nothing of what the others opened. A task
    streams its rows and holds one block's token sets. Rows of null id or bucket take no part, null tokens
    are none; an empty table gives none.
    """
    place = rows.schema["bucket"].dataType.simpleString()
    none = F.array().cast("array<string>")
    known = rows.where("bucket is not null and id is not null").select("bucket", "ord", F.col("id").cast("string").alias("id"), "label", F.coalesce("tokens", none).alias("tokens"))
    labelled, alone = known.where("label is not null"), known.where("label is null").drop("label")
    # a label's tokens are as many as its vocabulary has words
    seen = labelled.groupBy("bucket", "label").agg(F.min(F.struct("ord", "id")).alias("seen"))
    held = labelled.select("bucket", "label", F.explode("tokens").alias("token")).distinct().groupBy("bucket", "label").agg(F.collect_set("token").alias("tokens"))
    sets = seen.join(held, ["bucket", "label"], "left").select("bucket", "label", "seen", F.coalesce("tokens", none).alias("tokens"))
    ranked, parts = _in_blocks(alone, block)
    dealt = alone.join(ranked, ["bucket", "ord", "id"]).select("part", "bucket", "block", F.lit(1).alias("phase"), "ord", "id", "tokens")
    first = sets.join(ranked.select("bucket", "block", "part").distinct(), "bucket").select("part", "bucket", "block", F.lit(0).alias("phase"), F.col("seen.ord").alias("ord"), F.col("seen.id").alias("by"), F.col("label").alias("id"), "tokens")
    both = first.unionByName(dealt.withColumn("by", F.col("id"))).repartitionById(parts, F.col("part")).sortWithinPartitions("bucket", "block", "phase", "ord", "by")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, clusters = None, None
        for batch in batches:
            c = batch.to_pydict()
            out = []
            for i, key in enumerate(zip(c["bucket"], c["block"], strict=True)):
                if key != now:
                    now, clusters = key, Growing(threshold)
                out.append((clusters.place if c["phase"][i] else clusters.open)(c["id"][i], set(c["tokens"][i])))
            told = pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("block"), batch.column("id"), pa.array(out, pa.string())], names=["bucket", "block", "id", "cluster"])
            yield told.filter(pa.array([p == 1 for p in c["phase"]], pa.bool_()))

    found = both.select("bucket", "block", "phase", "id", "tokens").mapInArrow(run, f"bucket {place}, block long, id string, cluster string")
    return found.unionByName(labelled.select("bucket", F.lit(0).cast("long").alias("block"), "id", F.col("label").alias("cluster")))
