"""Integer k-means over partition-local ball trees.

Each task cuts its rows into blocks and builds a tree over each: a node is a ball that stores its rows'
centre, radius, count and exact integer sum. A round walks the trees against the centroids, level by level:
a centroid that the triangle inequality shows to be farther than another from every row of a ball is dropped
for that ball; a ball that is left with one centroid goes to it whole, by its count and sum; the others are
opened, and the rows of leaves are compared exactly. Trees are built and written once; what a round sends
through Spark is a count and a sum of each centroid and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a tree, and of a leaf at most (more only where they are equal).
BLOCK, LEAF = 4096, 16
#: Scaled components up to this keep squared distances within 64 bits.
MOST = 1 << 27
#: Rows that a leaf comparison holds at a time.
AT_ONCE = 1024


class Balls:
    """A ball tree over integer vectors, nodes level by level; ``rows`` are reordered so that a node's are a range."""

    def __init__(self, rows: np.ndarray, first: np.ndarray, last: np.ndarray, child: np.ndarray, centre: np.ndarray, radius: np.ndarray, total: np.ndarray):
        self.rows, self.first, self.last, self.child, self.centre, self.radius, self.total = rows, first, last, child, centre, radius, total

    @staticmethod
    def build(q: np.ndarray) -> tuple[Balls, np.ndarray]:
        """The tree of the rows of ``q``, and the order in which it holds them."""
        order = np.arange(len(q))
        first, last, child, centre, radius, total = [0], [len(q)], [], [], [], []
        at = 0
        while at < len(first):
            a, b = first[at], last[at]
            x = q[order[a:b]]
            total.append(x.sum(axis=0))
            centre.append(total[-1] / (b - a))
            radius.append(float(np.sqrt(((x - centre[-1]) ** 2).sum(axis=1)).max()))
            wide = x.max(axis=0) - x.min(axis=0)
            if b - a <= LEAF or not wide.any():
                child.append(-1)
            else:
                # the two halves along the widest component
                order[a:b] = order[a:b][np.argsort(x[:, int(wide.argmax())], kind="stable")]
                child.append(len(first))
                first += [a, (a + b) // 2]
                last += [(a + b) // 2, b]
            at += 1
        return Balls(q[order], *(np.array(v) for v in (first, last, child)), np.array(centre), np.array(radius), np.array(total)), order

    def columns(self) -> dict[str, bytes]:
        small = lambda v: v.astype(np.int32).tobytes()
        return {"q": small(self.rows), "first": small(self.first), "last": small(self.last), "child": small(self.child), "centre": self.centre.tobytes(), "radius": self.radius.tobytes(), "total": self.total.tobytes()}

    @staticmethod
    def read(row: dict[str, bytes], dim: int) -> Balls:
        ints = lambda k: np.frombuffer(row[k], np.int32).astype(np.int64)
        return Balls(ints("q").reshape(-1, dim), ints("first"), ints("last"), ints("child"), np.frombuffer(row["centre"]).reshape(-1, dim), np.frombuffer(row["radius"]), np.frombuffer(row["total"], np.int64).reshape(-1, dim))

    def walk(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(nodes, their centroid, True) of balls that go whole, and (rows, their centroid, False) of rows compared one by one."""
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            r = self.radius[nodes][:, None]
            d = np.where(may, _apart(self.centre[nodes], centroids), np.inf)
            nearest = d.min(axis=1, keepdims=True)
            # distances of doubles are right to far more than the margin
            may &= d - r <= nearest + r + 1e-9 * (nearest + r + 1)
            whole = may.sum(axis=1) == 1
            yield nodes[whole], may[whole].argmax(axis=1), True
            leaf = ~whole & (self.child[nodes] < 0)
            for a, b, m in zip(self.first[nodes[leaf]], self.last[nodes[leaf]], may[leaf], strict=True):
                some = np.flatnonzero(m)
                for at in range(a, b, AT_ONCE):
                    x = self.rows[at : min(at + AT_ONCE, b)]
                    d2 = ((x[:, None] - centroids[None, some]) ** 2).sum(axis=2)
                    yield np.arange(at, at + len(x)), some[d2.argmin(axis=1)], False  # the first of equals
            opened = ~whole & ~leaf
            left = self.child[nodes[opened]]
            nodes, may = np.concatenate([left, left + 1]), np.tile(may[opened], (2, 1))

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each centroid and their sum."""
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for which, to, whole in self.walk(centroids):
            np.add.at(count, to, self.last[which] - self.first[which] if whole else 1)
            np.add.at(total, to, self.total[which] if whole else self.rows[which])
        return count, total

    def assigned(self, centroids: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.rows), np.int64)
        for which, to, whole in self.walk(centroids):
            if whole:
                for n, k in zip(which, to, strict=True):
                    out[self.first[n] : self.last[n]] = k
            else:
                out[which] = to
        return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))


def _trees(rows: DataFrame, dim: int) -> DataFrame:
    """Trees over each task's rows ``(vec_id, q)``, BLOCK rows at a time."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tree(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(part)
            balls, order = Balls.build(t["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim))
            ids = t["vec_id"].combine_chunks().take(pa.array(order))
            cols = balls.columns()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([v], pa.binary()) for v in cols.values())], names=["ids", *cols])

        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                while len(part):
                    piece = part.slice(0, BLOCK - n)
                    held, n, part = [*held, piece], n + len(piece), part.slice(len(piece))
                    if n == BLOCK:
                        yield tree(held)
                        held, n = [], 0
        if n:
            yield tree(held)

    return rows.select("vec_id", "q").mapInArrow(run, f"ids array<{kind}>, q binary, first binary, last binary, child binary, centre binary, radius binary, total binary")


def _each(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Balls]]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            yield row["ids"].flatten(), Balls.read({k: row[k][0].as_py() for k in batch.schema.names[1:]}, dim)


def _next(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's exact floor of the mean of its rows; one without rows stays."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, balls in _each(batches, dim):
            c, t = balls.sums(centroids)
            count, total = count + c, total + t
        some = np.flatnonzero(count)
        names = ["cluster", "place", "n", "s"]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dim)), pa.array(np.tile(np.arange(dim), len(some))), pa.array(np.repeat(count[some], dim)), pa.array(total[some].ravel())], names=names)

    parts = trees.mapInArrow(run, "cluster long, place long, n long, s long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    # a row a centroid and component, whatever the input
    found = parts.groupBy("cluster", "place").agg(whole("n").alias("n"), whole("s").alias("s")).collect()
    out = centroids.copy()
    for r in found:
        out[r["cluster"], r["place"]] = int(r["s"]) // int(r["n"])
    return out


def cluster(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1", scratch: Scratch | None = None
) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; components become
    floor(scale * x). The first centroids are the ``k`` kept vectors of least sha256 of ``seed:id`` (ties by
    components), in that order; each round assigns every vector to the nearest (ties: the smaller number)
    and replaces each centroid that has vectors by the floor of their mean; vectors are assigned once more
    at the end. ``distance`` is squared.

    Vectors with a scaled component beyond 2^27 are not kept, as their distances could leave 64 bits; an
    inertia that does is null. Repeated rows, ids and null ids (hashed as without an id) are vectors each;
    with fewer than ``k`` kept vectors there are as many centroids; an empty table gives none; other columns
    are ignored.
    """
    spark = embeddings.sparkSession
    keep, passing = scratch or Scratch(spark), Scratch(spark)
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= MOST / scale))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), x.alias("x")).where(F.size("x") == dim).where(fine)
    rows = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * float(scale))).alias("q"))
    trees = passing.table(_trees(rows, dim), "ball-trees")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(named.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(first) else 0):
        centroids = _next(trees, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, balls in _each(batches, dim):
            to = balls.assigned(centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(((balls.rows - centroids[to]) ** 2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    out = keep.table(trees.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "ball-assigned")
    passing.drop()
    inertia = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of_cluster"))
    # a row a centroid
    inertia = inertia.crossJoin(F.broadcast(inertia.groupBy().agg(F.sum("of_cluster").alias("of_all"))))
    names = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()]
    sha = F.array(*names)[F.col("cluster")] if names else F.lit(None).cast("string")
    fits = lambda c: F.expr(f"try_cast({c} as bigint)")
    inertia = inertia.select("cluster", fits("of_cluster").alias("cluster_inertia"), fits("of_all").alias("inertia"), sha.alias("centroid_sha256"))
    return out.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
