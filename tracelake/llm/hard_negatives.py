"""Hard-negative mining over bit-sliced integer products.

Anchors meet all rows in cells of two blocks. In a cell the rows' components are cut into bit-planes; the
product with each plane, most significant first, narrows every pair's score to an interval whose width is
what the planes below can still add. A pair goes as soon as its interval can't qualify any more, and rows
that are left without pairs are not multiplied with the planes below.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import Scratch

#: Rows of a block of candidates and of a block of anchors: a cell's two sides, whatever the table's size.
ROWS, ANCHORS = 4096, 4096
#: Anchors whose intervals are held at a time.
AT_ONCE = 32
#: Squared norms, after scaling, that keep every interval within 64 bits.
MOST_NORM = float(1 << 54)
_FAR = np.int64(1) << 62
_NONE = np.empty(0, np.int64)


def scaled(rows: DataFrame, scale: int, *, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, dim, row, q array<long>)``: floor(scale * x) of the rows that take part, each once; ``row`` tells rows of one id apart."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v * float(scale * scale))
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), x.alias("x")).where("id is not null and label is not null and x is not null").where(whole).where(norm < MOST_NORM)
    q = kept.select("id", "label", F.transform("x", lambda v: F.floor(v * float(scale))).alias("q"))
    return q.select("id", "label", F.size("q").alias("dim"), F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("q").cast("array<string>"))).alias("row"), "q").distinct()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks()
    if not len(x):
        return np.empty((0, 0), np.int64)
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), -1)


class Planes:
    """Rows of integers as bit-planes above their least component."""

    def __init__(self, q: np.ndarray):
        self.least = int(q.min()) if q.size else 0
        u = q - self.least
        self.n = int(u.max()).bit_length() if q.size else 0
        self.bits = [((u >> k) & 1).astype(np.float32) for k in range(self.n)]

    def narrow(self, a: np.ndarray, alive: np.ndarray, qualify: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs of ``alive`` (anchors x rows) that ``qualify(alive, low, high)`` leaves after every plane."""
        # a plane's product is at most the sum of an anchor's components: exact in single precision below 2^24
        kind = np.float32 if not a.size or np.abs(a).sum(axis=1).max() < 1 << 24 else np.float64
        f = a.astype(kind)
        up, down = np.maximum(a, 0).sum(axis=1)[:, None], np.minimum(a, 0).sum(axis=1)[:, None]
        cols = np.flatnonzero(alive.any(axis=0))
        alive = alive[:, cols]
        s = np.repeat(a.sum(axis=1)[:, None] * self.least, len(cols), axis=1)
        for k in range(self.n - 1, -1, -1):
            s += (f @ self.bits[k][cols].T.astype(kind)).astype(np.int64) << k
            rest = (1 << k) - 1
            alive &= qualify(alive, s + down * rest, s + up * rest)
            some = alive.any(axis=0)
            if some.sum() < 0.8 * len(cols):
                cols, s, alive = cols[some], s[:, some], alive[:, some]
        if not self.n:
            alive &= qualify(alive, s, s)
        i, j = np.nonzero(alive)
        return i, cols[j], s[i, j]


def _kth(low: np.ndarray, k: int) -> np.ndarray:
    """Each line's k-th greatest value, as a column (very small where there are fewer)."""
    if low.shape[1] < k:
        return np.full((len(low), 1), -_FAR)
    return np.partition(low, low.shape[1] - k, axis=1)[:, [low.shape[1] - k]]


def _first(i: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each anchor ``i``: higher scores first, ties by ``order``."""
    by = np.lexsort((order, -score, i))
    i = i[by]
    start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, np.int64)
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
    return by[place < k]


def _names(rows: pa.Table) -> list[tuple]:
    return list(zip(rows["id"].to_pylist(), rows["row"].to_pylist(), strict=True))


def _order(names: list[tuple]) -> np.ndarray:
    """The place of each (id, row) in their order."""
    order = np.empty(len(names), np.int64)
    order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return order


def _labels(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' labels as numbers."""
    both = pa.chunked_array([*anchors["label"].chunks, *rows["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    return both[: len(anchors)], both[len(anchors) :]


def _nearest_alike(k: int) -> Callable:
    """The k highest-scored other rows of each anchor's label in a cell."""

    def best(alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= _kth(np.where(alive, low, -_FAR), k)

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        # blocks are by hash, so one side of a cell may have no rows of a rare length
        a, planes = _matrix(anchors["q"]) if len(rows) else _NONE, Planes(_matrix(rows["q"]))
        label_a, label_r = _labels(anchors, rows)
        names = _names(rows)
        where = {n: at for at, n in enumerate(names)}
        own = np.array([where.get(n, -1) for n in _names(anchors)], np.int64)
        order = _order(names)
        out = [(_NONE, _NONE, _NONE)]
        for at in range(0, len(a), AT_ONCE):
            alive = label_a[at : at + AT_ONCE, None] == label_r[None]
            here = np.flatnonzero(own[at : at + AT_ONCE] >= 0)
            alive[here, own[at + here]] = False
            i, j, s = planes.narrow(a[at : at + AT_ONCE], alive, best)
            top = _first(i, s, order[j], k)
            out.append((i[top] + at, j[top], s[top]))
        i, j, s = map(np.concatenate, zip(*out, strict=True))
        return pa.table([anchors["id"].take(i), anchors["row"].take(i), rows["id"].take(j), rows["row"].take(j), pa.array(s)], names=["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score"])

    return run


def _band(alive: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Pairs that may be among the first k with a score from ``least`` to ``most`` (columns)."""
    sure = alive & (low >= least) & (high <= most)
    floor = np.maximum(least, _kth(np.where(sure, low, -_FAR), k)) if sure.any() else least
    return (high >= floor) & (low <= most)


def _nearest_unlike(k: int, low_pct: int, high_pct: int) -> Callable:
    """For each of an anchor's positives, the k highest-scored rows of other labels in its band, in a cell."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, planes = _matrix(anchors["q"]) if len(rows) else _NONE, Planes(_matrix(rows["q"]))
        label_a, label_r = _labels(anchors, rows)
        order = _order(_names(rows))
        scores = [[p["positive_score"] for p in ps] for ps in anchors["positives"].to_pylist()]
        width = max(map(len, scores), default=0)
        # bands of whole numbers: 100 n >= low * p and 100 n <= high * p
        least = np.array([[-(-low_pct * p // 100) for p in ps] + [int(_FAR)] * (width - len(ps)) for ps in scores], np.int64)
        most = np.array([[high_pct * p // 100 for p in ps] + [-int(_FAR)] * (width - len(ps)) for ps in scores], np.int64)
        out = [(_NONE, _NONE, _NONE, _NONE)]
        for at in range(0, len(a), AT_ONCE):
            part = slice(at, at + AT_ONCE)

            def some(alive: np.ndarray, low: np.ndarray, high: np.ndarray, part: slice = part) -> np.ndarray:
                keep = np.zeros_like(alive)
                for p in range(width):
                    keep |= _band(alive, low, high, least[part, p, None], most[part, p, None], k)
                return keep

            i, j, s = planes.narrow(a[part], label_a[part, None] != label_r[None], some)
            for p in range(width):
                within = np.flatnonzero((s >= least[i + at, p]) & (s <= most[i + at, p]))
                top = within[_first(i[within], s[within], order[j[within]], k)]
                out.append((i[top] + at, np.full(len(top), p), j[top], s[top]))
        i, p, j, s = map(np.concatenate, zip(*out, strict=True))
        return pa.table([anchors["id"].take(i), anchors["row"].take(i), pa.array(p, pa.int32()), rows["id"].take(j), rows["row"].take(j), pa.array(s)], names=["anchor_id", "anchor_row", "at", "negative_id", "negative_row", "negative_score"])

    return run


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over every cell of a block of anchors and a block of rows of one length."""
    of_anchors, of_rows = -(-n_anchors // ANCHORS) or 1, -(-n_rows // ROWS) or 1
    block = lambda n: F.pmod(F.xxhash64("id", "row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.select("*", block(of_anchors).alias("a"), every(of_rows).alias("r"))
    r = rows.select("*", block(of_rows).alias("r"), every(of_anchors).alias("a"))
    keys = ["dim", "a", "r"]

    # new names of the columns' own, as both sides come from one table
    a, r = a.toDF(*a.columns), r.toDF(*r.columns)
    return a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(run, schema)


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Callable[[Column], Column],
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low_pct: int = 50,
    high_pct: int = 95,
    scratch: Scratch | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Components become floor(scale * x); a row's score is its integer inner product with the anchor, higher
    scores first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of its
    label; for each, the first ``negatives`` rows of other labels come whose score is ``low_pct`` to
    ``high_pct`` percent of the positive's. ``is_anchor`` is a condition on the id.

    Rows of null id, label or vector, or with a null or non-finite component, take no part; nor do vectors
    of a scaled norm of 2^27 or more, whose scores could leave 64 bits. Vectors are compared with those of
    their length. Rows that repeat id, label and components count once; an id with several is several rows,
    none the other's own. An anchor without a positive, and a positive without a negative in its band, have
    no row; an empty table gives none; other columns are ignored. No candidate is capped: a cell gives each
    anchor's first few of its rows, and the first few of those are the first few of all.
    """
    spark = embeddings.sparkSession
    keep, passing = scratch or Scratch(spark), Scratch(spark)
    rows = keep.table(scaled(embeddings, scale, id_col=id_col, vector_col=vector_col, label_col=label_col), "vectors-scaled")
    anchors = rows.where(is_anchor(F.col("id")))
    kind = rows.schema["id"].dataType.simpleString()
    n_rows, n_anchors = rows.count(), anchors.count()
    alike = _cells(anchors, rows, n_anchors, n_rows, _nearest_alike(positives), f"anchor_id {kind}, anchor_row string, positive_id {kind}, positive_row string, positive_score long")
    w = Window.partitionBy("anchor_id", "anchor_row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    alike = alike.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives)
    found = alike.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    with_positives = passing.table(anchors.join(found, ["id", "row"]), "anchors-positives")
    unlike = _cells(with_positives, rows, n_anchors, n_rows, _nearest_unlike(negatives, low_pct, high_pct), f"anchor_id {kind}, anchor_row string, at int, negative_id {kind}, negative_row string, negative_score long")
    w = Window.partitionBy("anchor_id", "anchor_row", "at").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    first = unlike.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    named = with_positives.select(F.col("id").alias("anchor_id"), F.col("row").alias("anchor_row"), "positives")
    out = first.join(named, ["anchor_id", "anchor_row"]).select("anchor_id", F.col("positives")[F.col("at")].alias("p"), "rank", "negative_id", "negative_score")
    out = keep.table(out.select("anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", "negative_id", F.col("p.positive_score").alias("positive_score"), "negative_score"), "hard-negatives")
    passing.drop()
    return out
