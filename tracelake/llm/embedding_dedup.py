"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells; a vector lives in the cell of
its two nearest codewords. It visits cells in the order of the sum of its two squared distances
(multi-sequence order) for as many cells as it took, on a bounded sample, to reach the target recall
on pairs at the threshold; every visited resident is then verified in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

#: Vectors that the codebooks and the number of visits are fitted on (those of least id hash).
SAMPLE = 8_192
#: Share of pairs at the threshold that one of the two must find.
TARGET_RECALL = 0.98
#: Codewords of a half; the grid has their square of cells, and what the driver knows of cells is bounded by that.
MOST_CODEWORDS = 1_024
#: Residents that meet in a block: neighbouring cells of one first codeword, or a part of a cell that has more.
BLOCK = 4_096


@dataclass
class MultiIndex:
    """Codebooks and number of visits; bounded by the codebooks' size."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def order(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The ``visits`` nearest cells of each row, nearest first, as first * k + second: the multi-sequence traversal, one step of all rows at a time."""
        a, b = _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)
        # the t nearest cells of the grid use the t nearest codewords of either half at most
        t, n, row = min(visits, a.shape[1]), len(x), np.arange(len(x))
        ia, ib = np.argsort(a, axis=1, kind="stable")[:, :t], np.argsort(b, axis=1, kind="stable")[:, : min(visits, b.shape[1])]
        sa, sb = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        wide = sb.shape[1]
        # the frontier: of the r-th nearest first codeword, the next second codeword and its sum, once the one before it is further on
        at = np.zeros((n, t + 1), np.int32)
        edge = np.full((n, t + 1), np.inf)
        edge[:, 0] = sa[:, 0] + sb[:, 0]
        out = np.zeros((n, min(visits, a.shape[1] * b.shape[1])), np.int64)
        for step in range(out.shape[1]):
            r = edge.argmin(axis=1)
            j = at[row, r]
            out[:, step] = ia[row, r] * b.shape[1] + ib[row, j]
            at[row, r] = j + 1
            free = (j + 1 < wide) & ((r == 0) | (at[row, r - 1] > j + 1))
            edge[row, r] = np.where(free, sa[row, r] + sb[row, np.minimum(j + 1, wide - 1)], np.inf)
            up = np.minimum(r + 1, t - 1)
            k = at[row, up]
            free = (r + 1 < t) & (k < j + 1) & (k < wide)
            edge[row[free], up[free]] = sa[row[free], up[free]] + sb[row[free], k[free]]
        return out

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, threshold: float, target: float, seed: int = 5) -> MultiIndex:
        rng = np.random.default_rng(seed)
        k = int(np.clip((rows / 64) ** 0.5, 2, MOST_CODEWORDS))
        half = max(1, sample.shape[1] // 2)
        index = cls(_codebook(sample[:, :half], k, rng), _codebook(sample[:, half:], k, rng), 1)
        # partners at exactly the threshold, in random directions
        some = sample[rng.permutation(len(sample))[:1024]]
        aside = rng.normal(size=some.shape)
        aside -= (aside * some).sum(axis=1, keepdims=True) * some
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
        other = threshold * some + (1 - threshold**2) ** 0.5 * aside
        cells = index.first.shape[0] * index.second.shape[0]
        visits = 4
        while visits < cells:
            there, back = index.order(some, visits), index.order(other, visits)
            found = (there == back[:, :1]).any(axis=1) | (back == there[:, :1]).any(axis=1)
            if found.mean() >= target:
                break
            visits = int(visits * 1.5)
        index.visits = min(visits, cells)
        return index


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means codewords (fewer where there are fewer distinct rows)."""
    distinct = np.unique(x, axis=0)
    codes = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = _distances(x, codes).argmin(axis=1)
        size = np.bincount(own, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, own, x)
        codes = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], codes)
    return codes


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if dim == 1:  # so that there are two halves
        x = np.hstack([x, np.zeros_like(x)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, target: float = TARGET_RECALL, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Pairs are linked where their cosine in double precision is at least ``threshold``; n_links counts
    the other vectors linked directly, component_id is the least id reachable, kept marks that vector.
    Each length of vectors has an index of its own. Null or zero vectors, those with null or non-finite
    components, and rows of null id link with nothing (their component is their own id). Equal vectors are
    one class from the start, so copies are never paired; a repeated row is the same vector, and of an id with
    several vectors the least (as arrays sort) counts for all its rows. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    whole = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(whole, F.lit(False)))
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).where("n > 1").orderBy("dim").collect()
    alone = (F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not sizes:
        return rows.select("vec_id", *alone)
    good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    keep = Scratch(spark)
    if len(sizes) > 1:  # an id has one vector in all indexes
        good = keep.table(good, "vectors")
    judged = reduce(DataFrame.unionByName, [_of_length(good.where(F.size("v") == dim), dim, n, threshold, target, sample, keep) for dim, n in sizes])
    out = rows.select("vec_id").join(judged, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _of_length(good: DataFrame, dim: int, n: int, threshold: float, target: float, sample: int, keep: Scratch) -> DataFrame:
    """``vec_id, n_links, component_id`` of the vectors of one length, each id once; ``keep`` gets the tables that this depends on."""
    spark = good.sparkSession
    passing = Scratch(spark)
    classes = keep.table(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")

    picked = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    index = MultiIndex.fit(_matrix(picked.column("v").combine_chunks(), dim), n, threshold, target)
    shared = spark.sparkContext.broadcast(index)
    k = len(index.second)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cells = m.order(_matrix(part.column(1), dim), m.visits)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "v", "copies", "cells"])

    vector = classes.schema["v"].dataType.simpleString()
    placed = passing.table(classes.select("id", "v", "copies").mapInArrow(place, f"id long, v {vector}, copies long, cells array<int>"), "vector-cells")
    # a row a cell that has residents: bounded by the codebooks
    counts = placed.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n")).toArrow()
    deal = spark.sparkContext.broadcast(_blocks(counts.column("cell").to_numpy(), counts.column("n").to_numpy(), k, len(index.first) * k))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = deal.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cells = part.column(3).flatten().to_numpy().astype(np.int64).reshape(part.num_rows, -1)
                row, block, visitor = _addresses(cells, part.column(0).to_numpy(), first, parts)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(visitor, pa.int32()), *part.take(pa.array(row)).columns], names=["block", "visitor", "id", "v", "copies", "cells"])

    meet = placed.mapInArrow(dealt, f"block long, visitor int, id long, v {vector}, copies long, cells array<int>")
    meet = meet.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (4 * BLOCK)), "block").sortWithinPartitions("block", "visitor", "id")
    met = keep.table(meet.mapInArrow(lambda b: _meet(b, dim, k, threshold), "id long, links long, root long"), "vector-links")

    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    comp = connected_components(met.where("root is not null").select("id", "root"), "id", "root", scratch=keep)
    passing.drop()
    per_class = classes.join(links, "id", "left").join(comp, "id", "left").select("v", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    return good.join(per_class, "v").select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))


def _blocks(cell: np.ndarray, n: np.ndarray, k: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks (0: no residents) of each cell: cells of one first codeword share a block up to BLOCK residents, a larger cell has several."""
    first, parts = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    block, held, codeword = 0, BLOCK, -1
    for i in np.argsort(cell):
        c, size = int(cell[i]), int(n[i])
        if held + size > BLOCK or c // k != codeword:
            block, held, codeword = block + 1, 0, c // k
        first[c], parts[c] = block, -(-size // BLOCK)
        block, held = block + parts[c] - 1, held + size
    return first, parts


def _addresses(cells: np.ndarray, ids: np.ndarray, first: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, block, visitor): every row once at home, and once as a visitor in each block with cells that it visits."""
    n, visits = cells.shape
    home = cells[:, 0]
    salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
    own = first[home] + salt % parts[home]
    row, cell = np.repeat(np.arange(n), visits), cells.ravel()
    times = parts[cell]
    row, base = np.repeat(row, times), np.repeat(first[cell], times)
    step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    seen = np.unique(np.stack([row, base + step], axis=1), axis=0)
    return np.concatenate([np.arange(n), seen[:, 0]]), np.concatenate([own, seen[:, 1]]), np.concatenate([np.zeros(n, np.int32), np.ones(len(seen), np.int32)])


class _Residents:
    """The residents of one block, by cell."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, k: int):
        whole = pa.Table.from_batches(batches).combine_chunks()
        self.id, self.copies = whole.column("id").to_numpy(), whole.column("copies").to_numpy()
        self.x = _matrix(whole.column("v").combine_chunks(), dim)
        cells = whole.column("cells").combine_chunks()
        flat = cells.flatten().to_numpy().astype(np.int64)
        self.visits = flat.reshape(len(self.id), -1)
        self.home = self.visits[:, 0]
        self.root = np.arange(len(self.id))
        self.cells = {c: np.flatnonzero(self.home == c) for c in np.unique(self.home)}
        # (resident, visited cell) as one sorted number: who visits whom back
        self.k2 = k * k
        self.back = np.sort((np.arange(len(self.id))[:, None] * self.k2 + self.visits).ravel())

    def visits_back(self, resident: np.ndarray, cell: np.ndarray) -> np.ndarray:
        key = resident * self.k2 + cell
        at = np.minimum(np.searchsorted(self.back, key), len(self.back) - 1)
        return self.back[at] == key


def _meet(batches: Iterator[pa.RecordBatch], dim: int, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of visitors to residents, from rows sorted by (block, residents first).

    Out: (id, links, root): what the visit adds to an id's links, and a vector of its component. A pair
    that both will find counts for the visitor only, else for both.
    """
    now, waiting, block = None, [], None

    def finish() -> Iterator[pa.RecordBatch]:
        if block is not None:
            far = np.flatnonzero(block.root != np.arange(len(block.root)))
            if len(far):
                yield _rows(block.id[far], np.zeros(len(far), np.int64), block.id[block.root[far]])

    for batch in batches:
        key = batch.column(0).to_numpy() << 1 | batch.column(1).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else []
        for a, b in zip(edges, [*edges[1:], len(key)], strict=True):
            part = batch.slice(a, b - a)
            if key[a] >> 1 != now:
                yield from finish()
                now, waiting, block = key[a] >> 1, [], None
            if not key[a] & 1:
                waiting.append(part)
                continue
            if block is None:
                if not waiting:
                    continue
                block, waiting = _Residents(waiting, dim, k), []
            for at in range(0, part.num_rows, 512):
                yield from _visit(part.slice(at, 512), block, dim, k, threshold)
    yield from finish()


def _rows(i: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], names=["id", "links", "root"])


def _visit(part: pa.RecordBatch, block: _Residents, dim: int, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    ids, copies = part.column("id").to_numpy(), part.column("copies").to_numpy()
    x = _matrix(part.column("v"), dim)
    cells = part.column("cells").flatten().to_numpy().astype(np.int64).reshape(len(ids), -1)
    mine, theirs = np.zeros(len(ids), np.int64), np.zeros(len(block.id), np.int64)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    here = {c for c in np.unique(cells).tolist() if c in block.cells}
    for c in sorted(here):
        q, r = np.flatnonzero((cells == c).any(axis=1)), block.cells[c]
        i, j = np.nonzero(x[q] @ block.x[r].T >= threshold)
        i, j = q[i], r[j]
        other = ids[i] != block.id[j]
        i, j = i[other], j[other]
        if not len(i):
            continue
        np.add.at(mine, i, block.copies[j])
        once = ~block.visits_back(j, cells[i, 0])
        np.add.at(theirs, j[once], copies[i[once]])
        pairs.append((i, j))
    if not pairs:
        return
    i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    root = np.zeros(len(first), np.int64)
    for at, (a, b) in enumerate(zip(first, np.append(first[1:], len(i)), strict=True)):
        roots = np.unique(block.root[j[a:b]])
        if len(roots) > 1:  # this visitor joins what were several components here
            block.root[np.isin(block.root, roots[1:])] = roots[0]
        root[at] = block.id[roots[0]]
    yield _rows(ids[i[first]], mine[i[first]], root)
    t = np.flatnonzero(theirs)
    if len(t):
        yield _rows(block.id[t], theirs[t], block.id[t])
