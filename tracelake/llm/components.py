"""Connected components: forests within tasks, contraction across tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that one task turns into a forest at a time; also what a task of a round is given.
EDGES_PER_TASK = 1 << 20
_PAIR = "a long, b long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the edges and the least vertex each can reach: roots hook to lesser roots, paths are compressed."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return ids, ids[root]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, root[root]):
            root = root[root]


def _forest(batches: Iterator[pa.RecordBatch], loops: bool = False) -> Iterator[pa.RecordBatch]:
    """(vertex, least vertex reachable) within a task; ``loops``: roots too. Memory grows with the task's vertices, not its edges."""
    a = b = np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= EDGES_PER_TASK:
            a, b = roots(*(np.concatenate(z) for z in zip((a, b), *held, strict=True)))
            held, size = [], 0
    if held:
        a, b = roots(*(np.concatenate(z) for z in zip((a, b), *held, strict=True)))
    if not loops:
        a, b = a[a != b], b[a != b]
    for at in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], names=["a", "b"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, scratch: Scratch | None = None, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``(id, component)`` for every id that occurs in ``edges``; component is the least id reachable.

    Every task first replaces its edges by a forest, which has fewer of them than vertices. While the
    forests fill more than one task, a round contracts: every vertex takes the vertex of least random
    priority among itself and its neighbours and the edges are rewritten to those, so that the number
    of vertices falls by a constant factor in expectation, whatever the order of ids. The least-priority
    neighbour is a partial aggregate, so a vertex with very many neighbours is no hot group; the joins
    that follow have one row per vertex on one side, and AQE splits their skewed side. A graph that
    fits one task needs no round.

    Self-loops (the id is its own component), repeated edges and edges with a null end (left out) are
    allowed; an empty edge table gives an empty result. ``scratch`` gets the tables that the result
    depends on; those of finished rounds are deleted.
    """
    keep = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    now = Scratch(edges.sparkSession)
    e = now.table(e.mapInArrow(lambda x: _forest(x, True), _PAIR), "edges")
    maps: list[DataFrame] = []
    while (n := e.count()) > per_task:
        later = Scratch(edges.sparkSession)
        salt = len(maps)
        priority = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("p"), F.col(c).alias("v"))  # noqa: B023, E731
        both = e.union(e.select("b", "a"))
        best = both.groupBy("a").agg(F.min(priority("b")).alias("m")).select("a", F.least(priority("a"), "m")["v"].alias("to"))
        best = keep.table(best, "contracted")
        maps.append(best)
        left, right = best.select("a", F.col("to").alias("x")), best.select(F.col("a").alias("b"), F.col("to").alias("y"))
        met = e.join(left, "a").join(right, "b").where("x <> y").select("x", "y")
        spread = met.coalesce(max(1, n // per_task))
        e = later.table(spread.mapInArrow(_forest, _PAIR), "edges")
        now.drop()
        now = later
    last = keep.table(e.coalesce(1).mapInArrow(lambda x: _forest(x, True), _PAIR), "forest")
    now.drop()
    root = last.select("a", F.col("b").alias("to"))
    for m in reversed(maps):
        onward = root.select(F.col("a").alias("to"), F.col("to").alias("last"))
        root = m.join(onward, "to", "left").select("a", F.coalesce("last", "to").alias("to"))
    if not maps:
        return root.select(F.col("a").alias("id"), F.col("to").alias("component"))
    least = root.groupBy("to").agg(F.min("a").alias("component"))
    return root.join(least, "to").select(F.col("a").alias("id"), "component")
