"""Lessons and references: similarity search, neighbours, merge routing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a bucket of more is compared in pairs of blocks.
BLOCK = 8192
#: Similarities that are held at a time, and pairs whose cosine is computed at a time.
HELD, PAIRS = 1 << 22, 1 << 18
#: Columns whose greatest similarity stands for them when a row's bound is sought.
GROUP = 32


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros, and their lengths; a null vector, or one that holds a null, has length -1 and is zero."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    at = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(lengths), max(1, lengths.max(initial=0))))
    out[at, place] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    bad = lists.is_null().to_numpy(zero_copy_only=False).copy()
    bad[at[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    out[bad], lengths[bad] = 0.0, -1
    return out, lengths


def _distinct(vectors: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each different vector, and each row's number among these."""
    keys = np.ascontiguousarray(np.column_stack([lengths.astype(float), vectors]))
    _, first, of = np.unique(keys.view(np.dtype((np.void, keys.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    return first, of.ravel()


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in the order of the components, as in functions.text.cosine."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def _unit(vectors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in single precision, and which have none in that sense (not zero, but too long, too short or not finite)."""
    plain = (norms > 1e-100) & (norms < 1e100)
    unit = np.zeros(vectors.shape, np.float32)
    unit[plain] = vectors[plain] / norms[plain, None]
    return unit, ~plain & (vectors != 0).any(axis=1)


def nearest_in_block(a: pa.ChunkedArray, va: pa.ChunkedArray, b: pa.ChunkedArray, vb: pa.ChunkedArray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` and the cosine, for each of ``a`` its k nearest of ``b`` with another id, ties by id.

    All pairs are compared by a product of unit vectors in single precision. What is within its error of a
    row's bound, or can't be judged by it, gets its cosine in double precision, which decides. Equal vectors
    are compared once: of those in ``b`` only so many of least id as can be a result.
    """
    ids = pa.chunked_array([*a.chunks, *b.chunks]) if a.type == b.type else pa.chunked_array([*a.cast(b.type).chunks, *b.chunks])
    order = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
    ia, ib = order[: len(a)], order[len(a) :]
    # its own id may stand on the other side, as often as an id repeats there
    most = k + int(np.unique(ib, return_counts=True)[1].max())
    (x, nx), (y, ny) = _matrix(va), _matrix(vb)
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
    first, of = _distinct(x, nx)
    _, same = _distinct(y, ny)
    by = np.lexsort((ib, same))
    starts = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
    within = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    kept = np.sort(by[within < most])
    rx, rn, y, ny, iy = x[first], nx[first], y[kept], ny[kept], ib[kept]
    with np.errstate(all="ignore"):
        norm_x, norm_y = np.sqrt(_sums(rx, rx)), np.sqrt(_sums(y, y))
        unit_x, odd_x = _unit(rx, norm_x)
        unit_y, odd_y = _unit(y, norm_y)
        slack = (width + 8) * 2.0**-23
        m = len(y)
        room = -m % GROUP
        turned = np.vstack([unit_y, np.zeros((room, width), np.float32)]).T
        mixed = len(np.unique(np.r_[rn, ny])) > 1
        hits_x, hits_y, hits_c = [], [], []
        step = max(1, HELD // (m + room))
        for at in range(0, len(rx), step):
            like = unit_x[at : at + step] @ turned
            if mixed:
                like[:, :m][rn[at : at + step, None] != ny] = 0
            like[:, m:] = -np.inf
            like[:, :m][:, odd_y] = -np.inf
            tops = like.reshape(len(like), -1, GROUP).max(axis=2)
            # the last of so many groups' greatest is reached by so many of the row
            bound = np.partition(tops, tops.shape[1] - most, axis=1)[:, tops.shape[1] - most] if tops.shape[1] >= most else np.full(len(like), -np.inf, np.float32)
            near = like >= (np.maximum(bound.astype(float), least) - slack).astype(np.float32)[:, None] - np.float32(2.0**-23)
            near[:, m:] = False
            near[:, :m][:, odd_y] = True
            near[odd_x[at : at + step], :m] = True
            p, q = np.nonzero(near)
            p += at
            c = np.empty(len(p))
            for o in range(0, len(p), PAIRS):
                i, j = p[o : o + PAIRS], q[o : o + PAIRS]
                by_norms = norm_x[i] * norm_y[j]
                c[o : o + PAIRS] = np.where((rn[i] != ny[j]) | (by_norms == 0), 0.0, _sums(rx[i], y[j]) / by_norms)
            good = (c >= least) | np.isnan(c)
            p, q, c = p[good], q[good], c[good]
            best = np.lexsort((iy[q], -c, ~np.isnan(c), p))
            p, q, c = p[best], q[best], c[best]
            begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, int)
            rank = np.arange(len(p)) - np.repeat(begin, np.diff(np.r_[begin, len(p)]))
            hits_x.append(p[rank < most])
            hits_y.append(q[rank < most])
            hits_c.append(c[rank < most])
    p, q, c = np.concatenate(hits_x), np.concatenate(hits_y), np.concatenate(hits_c)
    # every row takes what its vector has found, but not its own id
    n = np.bincount(p, minlength=len(first))
    begin = np.cumsum(n) - n
    rows = np.repeat(np.arange(len(of)), n[of])
    at = np.arange(len(rows)) - np.repeat(np.cumsum(n[of]) - n[of], n[of]) + begin[of[rows]]
    other = ia[rows] != iy[q[at]]
    rows, at = rows[other], at[other]
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    few = np.arange(len(rows)) - np.repeat(begin, np.diff(np.r_[begin, len(rows)])) < k
    return rows[few], kept[q[at[few]]], c[at[few]]


def _blocks(rows: DataFrame, bucket: str) -> DataFrame:
    return rows.groupBy(bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))


def neighbours(left: DataFrame, right: DataFrame, bucket: str, k: int, least: float) -> DataFrame:
    """For each (id, vector) on the left the k nearest on the right in its bucket, by cosine, ties by id.

    Every pair of a bucket is compared, in blocks of both sides, so that no task holds a large bucket; each
    pair of blocks gives its own first k, which are ranked by id. Rows of null id or bucket take no part.
    """
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a, b = (df.where(F.col("id").isNotNull() & F.col(bucket).isNotNull()).select(F.col(bucket).alias("bucket"), "id", "vector") for df in (left, right))
    n_a, n_b = _blocks(a, "bucket").withColumnRenamed("blocks", "na"), _blocks(b, "bucket").withColumnRenamed("blocks", "nb")
    sizes = n_a.join(n_b, "bucket")
    kinds = [df.schema["id"].dataType.simpleString() for df in (a, b)]
    a = a.join(sizes, "bucket").select("bucket", F.col("id").alias("a"), F.col("vector").alias("va"), mine("na").alias("i"), every("nb").alias("j"))
    b = b.join(sizes, "bucket").select("bucket", F.col("id").alias("b"), F.col("vector").alias("vb"), mine("nb").alias("j"), every("na").alias("i"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"a": x["a"].slice(0, 0), "b": y["b"].slice(0, 0), "cosine": pa.array([], pa.float64())})
        p, q, c = nearest_in_block(x["a"], x["va"], y["b"], y["vb"], k, least)
        return pa.table({"a": x["a"].take(pa.array(p)), "b": y["b"].take(pa.array(q)), "cosine": pa.array(c)})

    cells = [df.groupBy("bucket", "i", "j") for df in (a, b)]
    both = cells[0].cogroup(cells[1]).applyInArrow(compare, f"a {kinds[0]}, b {kinds[1]}, cosine double")
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def route(near: DataFrame, candidates: DataFrame, gain: str, least_gain: int = 3) -> DataFrame:
    """ADD without a strong neighbour, NOOP or UPDATE with one (by information gain), MERGE with more."""
    by = near.groupBy("id").agg(F.count("*").alias("n"), F.max(gain).alias("gain"))
    out = candidates.select("id").join(by, "id", "left")
    action = F.when(F.col("n").isNull(), "ADD").when(F.col("n") > 1, "MERGE").when(F.col("gain") < least_gain, "NOOP").otherwise("UPDATE")
    return out.select("id", action.alias("action"))
