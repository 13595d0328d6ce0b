"""N-gram Jaccard self-join with PartEnum signatures.

A document is the set of its distinct word n-grams. Two sets x, y of sizes a, b with Jaccard
>= t differ in at most H(a, b) = (a + b)(1 - t) / (1 + t) elements. The feature domain is
partitioned by hash into the parts of a size band; as each part with a difference uses one of at
most H, among any H + 1 + e parts, e of them empty in both, one agrees and is not empty. So a set
signs its first H + 1 nonempty parts in the band's fixed order, each signature being the band, the
part and the hash of all its elements in that part: of two sets whose cuts lie at parts i <= j, an
agreeing nonempty part lies before i and both have signed it. A set with too few nonempty parts
signs them all and a spill signature of the band besides. For the smallest bands all subsets of
(parts - H) of a few parts are enumerated instead, so that an agreeing subset is hardly ever empty.

Sizes are cut into bands [l, floor(l / t)], so similar sets are in the same or adjacent bands and a
set signs in its own and in the next one. No signature, bucket or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Scratch, release
from .components import connected_components

U = np.uint64
#: Bands that allow up to so many differences enumerate subsets of parts.
ENUMERATE_UP_TO = 3
#: Buckets up to this size list all their pairs; larger ones are joined to their least member first
#: and later compared in full between the components that this leaves.
SMALL_BUCKET = 6
#: Sets of up to so many elements are told apart by their words: in larger ones all that differs would have to collide.
WORDS_UP_TO = 8
#: Elements of a family of mixed buckets that one task compares; larger families are dealt in blocks by size range and salt.
BLOCK_ELEMENTS = 2_000_000
MAX_SIZE = 1 << 31


class Bands:
    """Size bands and their partitions for a similarity threshold."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.lower: list[int] = []
        low = 1
        while low < MAX_SIZE:
            self.lower.append(low)
            low = int(low / threshold) + 1
        self.edges = np.array(self.lower, np.int64)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def upper(self, band: int) -> int:
        return int(self.lower[band] / self.t)

    def differences(self, a: int, b: int) -> int:
        """The most elements in which sets of these sizes may differ."""
        return int((a + b) * (1 - self.t) / (1 + self.t))

    def reach(self, size: int, band: int) -> int:
        """The most differences from any partner that meets a set of this size in this band."""
        return self.differences(size, max(size, min(int(size / self.t), self.upper(band))) if band == self.of(size) else int(size / self.t))

    def parts(self, band: int) -> tuple[int, int]:
        """(number of parts, subset size; 0: one signature a part)."""
        k = self.differences(self.upper(band), self.upper(band))
        if k <= ENUMERATE_UP_TO:
            return k + 3, 3
        return int(k * Fraction(27, 20)) + 8, 0


def _sets(w: tk.Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document; fewer words: one hash of the whole sequence."""
    g = tk.grams(w.hash, n)
    out = []
    for d in range(w.n_docs):
        a, b = int(w.bounds[d]), int(w.bounds[d + 1])
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(tk.grams(w.hash[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.empty(0, U))
    return out


class Keys:
    """The 64-bit numbers of classes (documents of equal sets), which differ where 128 bits of the sets do.

    ``first`` is an order-free hash of the elements. ``second`` tells classes apart that share it: of small
    sets it is a digest of the elements' words, of larger ones another hash of the elements. ``renamed``
    has a number of its own for each class but one of those that share their first.
    """

    def __init__(self, bits: int = 64, renamed: dict[tuple[int, int], int] | None = None):
        self.mask, self.renamed = U((1 << bits) - 1), renamed or {}
        self.shared = {c for c, _ in self.renamed}

    def first(self, s: np.ndarray) -> int:
        return int(((tk.mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) + U(len(s))) & self.mask).view(np.int64))

    @staticmethod
    def second(w: tk.Words, d: int, s: np.ndarray, n: int) -> int:
        if len(s) > WORDS_UP_TO:
            return int(tk.mix(tk.mix(s + U(0x2545F4914F6CDD1D)) * U(0xD6E8FEB86659FD93) + U(len(s))).sum(dtype=U).view(np.int64))
        a, b = int(w.bounds[d]), int(w.bounds[d + 1])
        held = sorted({w.text(i, i + n).lower() for i in range(a, b - n + 1)} if b - a >= n else {w.text(a, b).lower()})
        return int.from_bytes(blake2b(b"\n".join(held), digest_size=8).digest(), "little", signed=True)

    def of(self, w: tk.Words, d: int, s: np.ndarray, n: int) -> int:
        c = self.first(s)
        return self.renamed.get((c, self.second(w, d, s, n)), c) if c in self.shared else c


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the elements' counts in about len(s) hash cells: two sets differ in at least as many elements as parities."""
    m = 64
    while m < len(s):
        m *= 2
    cells = np.bincount((tk.mix(s + U(77)) & U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def _signatures(s: np.ndarray, bands: Bands) -> list[np.ndarray]:
    size = len(s)
    own = bands.of(size)
    out = []
    for band in (own, own + 1):
        reach = bands.reach(size, band)
        n, subset = bands.parts(band)
        salt = U((band + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        if bands.differences(bands.upper(band), bands.upper(band)) == 0:
            continue  # only equal sets link here, and those are one class already
        m = tk.mix(s + salt)
        part = ((m >> U(32)) * U(n) >> U(32)).astype(np.int64)
        if subset:
            sums = np.zeros(n, U)
            np.add.at(sums, part, tk.mix(m + salt))
            picks = np.array(list(combinations(range(n), subset)), np.int64)
            sig = sums[picks] * np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], U)
            out.append(tk.mix(sig.sum(axis=1, dtype=U) + tk.mix(np.arange(len(picks)).astype(U) + salt)))
            continue
        order = np.argsort(part, kind="stable")
        p = part[order]
        first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        sums = np.add.reduceat(tk.mix(m + salt)[order], first)
        sig = tk.mix(sums + tk.mix(p[first].astype(U) + salt))
        if len(sig) >= reach + 1:
            out.append(sig[: reach + 1])
        else:
            out.append(np.append(sig, tk.mix(np.array([salt], U))))
    return out


def document_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, bits: int = 64) -> DataFrame:
    """``(doc_id, n_shingles, c, c2)``: set size and the two halves of the set's key; null where the set is empty."""
    keys = Keys(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for w in tk.slices(batch.column(1), tk.SPACED_LOWER, strong=True):
                sets = _sets(w, n)
                first = [keys.first(s) if len(s) else None for s in sets]
                second = [keys.second(w, d, s, n) if len(s) else None for d, s in enumerate(sets)]
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.n_docs), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["doc_id", "n_shingles", "c", "c2"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, n_shingles long, c long, c2 long")


def _told_apart(base: DataFrame, bits: int) -> tuple[DataFrame, Keys]:
    """``(doc_id, n_shingles, c)`` with a number for each class, and the keys that give it.

    Classes that share a first half are as rare as collisions of 64 bits (of m classes some m^2 / 2^65
    pairs: a few at 10^10 classes), so the driver numbers them.
    """
    shared = base.where("c is not null").groupBy("c").agg(F.min("c2").alias("lo"), F.max("c2").alias("hi")).where("lo <> hi")
    found = base.join(shared, "c").select("c", "c2", "lo").where("c2 <> lo").distinct().collect()
    spark, renamed = base.sparkSession, {}
    left, turn = [(r["c"], r["c2"]) for r in found], 0
    while left:
        turn += 1
        tried = {k: int(tk.mix(tk.mix(np.array([k[0]]).view(U) + U(turn)) ^ np.array([k[1]]).view(U)).view(np.int64)[0]) for k in left}
        rows = spark.createDataFrame(list(set(tried.values())), "long").toDF("c")
        taken = {r["c"] for r in rows.join(base.select("c"), "c", "left_semi").collect()} | set(renamed.values())
        for k, c in tried.items():
            if c not in taken:
                renamed[k] = c
                taken.add(c)
        left = [k for k in left if k not in renamed]
    if renamed:
        new = spark.createDataFrame([(*k, c) for k, c in renamed.items()], "c long, c2 long, new long")
        base = base.join(F.broadcast(new), ["c", "c2"], "left").select("doc_id", "n_shingles", F.coalesce("new", "c").alias("c"))
    return base.select("doc_id", "n_shingles", "c"), Keys(bits, renamed)


def _signed(docs: DataFrame, text_col: str, n: int, bands: Bands, keys: Keys) -> DataFrame:
    """``(sig, c)``: each class's signatures, once in a task however many copies the task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for w in tk.slices(batch.column(0), tk.SPACED_LOWER, strong=True):
                sigs, owner = [], []
                for d, s in enumerate(_sets(w, n)):
                    if not len(s):
                        continue
                    c = keys.of(w, d, s, n)
                    if c in done:
                        continue
                    done.add(c)
                    mine = _signatures(s, bands)
                    sigs += mine
                    owner.append(np.full(sum(map(len, mine)), c, np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owner))], names=["sig", "c"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "sig long, c long")


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Blocks of whole groups of equal first columns from batches sorted by them; the last group of a batch waits for the next."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        last = np.ones(len(cols[0]), bool)
        for k in cols[:keys]:
            last &= k == k[-1]
        cut_at = int(np.argmax(last))
        if cut_at or held and any(k[0] != h[-1] for k, h in zip(cols[:keys], held[-1], strict=False)):
            block = [np.concatenate([h[i] for h in held] + [cols[i][:cut_at]]) for i in range(len(cols))]
            held = []
            if len(block[0]):
                yield block
            cols = [c[cut_at:] for c in cols]
        held.append(cols)
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(len(held[0]))]


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and class: all pairs of small buckets, links to the least member of large ones (with their signature).

    Only the first members of the bucket that runs on are held, so a bucket of any size passes through.
    """
    sig_now, members, count, last = 0, np.empty(0, np.int64), 0, 0

    def pairs_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.tril_indices(len(m), -1)
        return m[i], m[j]

    for batch in batches:
        sig, c = (x.to_numpy() for x in batch.columns)
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
        if len(sig) and count and sig[0] == sig_now and c[0] == last:
            fresh[0] = False
        sig, c = sig[fresh], c[fresh]
        if not len(sig):
            continue
        last = c[-1]
        told = len(members) if count > SMALL_BUCKET else 0  # of the held bucket, members that have had their row
        before = count - len(members)
        sig, c = np.concatenate([np.full(len(members), sig_now, np.int64), sig]), np.concatenate([members, c])
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(first, len(sig)))
        size[0] += before
        length = np.diff(np.append(first, len(sig)))
        many, at = np.repeat(size, length), np.repeat(first, length)
        large = many > SMALL_BUCKET
        large[:told] = False
        i = np.flatnonzero(large)
        xs, ys, gs = [c[i]], [c[at[i]]], [sig[i]]
        open_at = int(first[-1])
        small = (many <= SMALL_BUCKET) & (np.arange(len(sig)) < open_at)
        place = np.arange(len(sig)) - at
        for d in range(1, SMALL_BUCKET):
            i = np.flatnonzero(small & (place >= d))
            xs.append(c[i])
            ys.append(c[i - d])
            gs.append(np.zeros(len(i), np.int64))
        x, y, g = map(np.concatenate, (xs, ys, gs))
        sig_now, count = int(sig[-1]), int(size[-1])
        members = c[open_at : open_at + (1 if count > SMALL_BUCKET else SMALL_BUCKET)]
        if len(x):
            yield _pair_rows(x, y, g)
    if 1 < count <= SMALL_BUCKET:
        x, y = pairs_of(members)
        yield _pair_rows(x, y, np.zeros(len(x), np.int64))


def _pair_rows(x: np.ndarray, y: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    """Pairs of small buckets once a batch, greater class first; links of large ones as they are."""
    small = g == 0
    pair = np.unique(np.stack([np.maximum(x[small], y[small]), np.minimum(x[small], y[small])], axis=1), axis=0) if small.any() else np.empty((0, 2), np.int64)
    x, y, g = np.concatenate([pair[:, 0], x[~small]]), np.concatenate([pair[:, 1], y[~small]]), np.concatenate([np.zeros(len(pair), np.int64), g[~small]])
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(g)], names=["x", "y", "sig"])


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def _fold(s: np.ndarray, size: int) -> np.ndarray:
    while len(s) > size:
        half = len(s) // 2
        s = s[:half] ^ s[half:]
    return s


def _may_link(na: int, sa: np.ndarray, nb: int, sb: np.ndarray, bands: Bands) -> bool:
    """False only where sizes or parities prove that two sets aren't similar."""
    if min(na, nb) < bands.t * max(na, nb):
        return False
    m = min(len(sa), len(sb))
    return int(_BITS[_fold(sa, m) ^ _fold(sb, m)].sum()) <= bands.differences(na, nb)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Sorted distinct arrays: den * |intersection| >= num * |union|, exactly."""
    if not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The pairs (x, y) of classes whose texts' sets are similar; one text per class in ``texts(c, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by y: y's set is computed once for a run of equal y
        last_y, set_y = None, None
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(x), 64):
                tx = batch.column(2).slice(at, 64)
                sets: list[np.ndarray] = []
                for w in tk.slices(tx, tk.SPACED_LOWER, strong=True):
                    sets += _sets(w, n)
                out = []
                for i, s in enumerate(sets, at):
                    if y[i] != last_y:
                        set_y = [z for w in tk.slices(batch.column(3).slice(i, 1), tk.SPACED_LOWER, strong=True) for z in _sets(w, n)][0]
                        last_y = y[i]
                    if similar(s, set_y, t.numerator, t.denominator):
                        out.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in out], pa.int64()), pa.array([y[i] for i in out], pa.int64())], names=["x", "y"])

    tx = texts.select(F.col("c").alias("x"), F.col("text").alias("tx"))
    ty = texts.select(F.col("c").alias("y"), F.col("text").alias("ty"))
    both = pairs.select("x", "y").join(tx, "x").join(ty, "y").select("x", "y", "tx", "ty")
    return both.sortWithinPartitions("y").mapInArrow(run, "x long, y long")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: Fraction = Fraction(4, 5), scratch: Scratch | None = None, key_bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a document of fewer than ``n`` words
    is its whole sequence as one element. Rows link where the Jaccard similarity of their sets is at
    least ``threshold``, computed on 64-bit element hashes; component_id is the least id reachable.
    Sets are equal where 128 bits are: a word's hash is nonlinear, and the words of small sets are digested
    (``key_bits`` shortens the first half, for tests). A very long text is one set. Rows without words or text link with nothing and are their own component; a null id
    gets a null component. Rows of equal sets are one class from the start (so copies never meet in
    pairs), repeated rows included; an id with several texts has a row for each, and all its texts
    count as that document. Empty tables give an empty result; other columns are ignored. ``scratch``
    gets the tables that the result depends on; all others are deleted before this returns.
    """
    bands = Bands(threshold)
    spark = docs.sparkSession
    keep, passing = scratch or Scratch(spark), Scratch(spark)
    base, keys = _told_apart(keep.table(document_classes(docs, id_col=id_col, text_col=text_col, n=n, bits=key_bits), "ngram-sets"), key_bits)
    classes = base.where("c is not null and doc_id is not null").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = _signed(docs, text_col, n, bands, keys).repartition(parts, "sig").sortWithinPartitions("sig", "c")
    found = passing.table(buckets.mapInArrow(_bucket_pairs, "x long, y long, sig long"), "ngram-pairs")
    del buckets
    release(spark)

    sketched = passing.table(_class_sketches(docs, found, classes, id_col, text_col, n, keys), "ngram-sketches")
    release(spark)
    likely = passing.table(_likely(found.where("x <> y").select("x", "y").distinct(), sketched, bands), "ngram-likely")
    # links are written first: a stage with two Arrow functions would hold two Python workers a task
    links = passing.table(_verified(likely, sketched, n, bands.t), "ngram-links")
    comp = passing.table(connected_components(links, "x", "y", scratch=passing), "ngram-components")
    release(spark)
    # large buckets that still hold several components: compare across them, and join the components that meet
    mixed = passing.table(_mixed(found, comp), "ngram-mixed")
    labels = comp.select(F.col("id").alias("c"), "component")
    if not mixed.isEmpty():
        more = passing.table(_across(mixed, sketched, bands, n), "ngram-more")
        over = passing.table(connected_components(more, "x", "y", scratch=passing), "ngram-across")
        up = over.select(F.col("id").alias("component"), F.col("component").alias("upper"))
        singles = up.join(labels, up["component"] == labels["c"], "left_anti").select(F.col("component").alias("c"), F.col("upper").alias("component"))
        labels = labels.join(up, "component", "left").select("c", F.coalesce("upper", "component").alias("component")).unionByName(singles)
    named = labels.join(classes.select("c", "doc_id"), "c")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = keep.table(named.join(least, "component").select("c", "component_id"), "ngram-labels")
    passing.drop()
    del found, sketched, likely, links, comp, mixed, labels, least
    release(spark)
    by_class = classes.join(named, "c", "left").select("c", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = base.join(by_class, "c", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def _class_sketches(docs: DataFrame, found: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int, keys: Keys) -> DataFrame:
    """``(c, size, sketch, text)`` of the classes that share a bucket with another, from one document of each."""
    wanted = found.select("x").union(found.select("y")).distinct().withColumnRenamed("x", "c")
    ids = classes.join(wanted, "c", "left_semi").select("c", "doc_id", "size")
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(ids, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, named = [], []
            for w in tk.slices(batch.column(2), tk.SPACED_LOWER, strong=True):
                mine = _sets(w, n)
                sets += mine
                named += [keys.of(w, d, s, n) if len(s) else None for d, s in enumerate(mine)]
            # an id with several texts meets the classes of all of them: each text goes to its own
            own = pa.array([k == c for k, c in zip(named, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(map(_sketch, sets), pa.binary())], names=["c", "size", "text", "sketch"]).filter(own)

    # a repeated row would repeat its class; any one will do
    return one.select("c", "size", "text").mapInArrow(run, "c long, size long, text string, sketch binary")


def _likely(pairs: DataFrame, sketched: DataFrame, bands: Bands) -> DataFrame:
    """Candidate pairs that sizes and parities don't rule out."""

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            sx, sy = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            keep = [_may_link(a, np.frombuffer(p, np.uint8), b, np.frombuffer(q, np.uint8), bands) for a, p, b, q in zip(nx, sx, ny, sy, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    sx = sketched.select(F.col("c").alias("x"), F.col("size").alias("nx"), F.col("sketch").alias("sx"))
    sy = sketched.select(F.col("c").alias("y"), F.col("size").alias("ny"), F.col("sketch").alias("sy"))
    return pairs.join(sx, "x").join(sy, "y").select("x", "y", "nx", "sx", "ny", "sy").mapInArrow(maybe, "x long, y long").distinct()


def _mixed(found: DataFrame, comp: DataFrame) -> DataFrame:
    """``(leader, c, component)`` of the large buckets that hold several components.

    Near copies share many buckets, mostly with the same least member, so mixed buckets of one least
    member are looked at together and each class once.
    """
    label = comp.select(F.col("id").alias("x"), "component")
    rows = found.where("sig <> 0").join(label, "x", "left").select("sig", F.col("y").alias("leader"), F.col("x").alias("c"), F.coalesce("component", "x").alias("component"))
    mixed = rows.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    return rows.join(mixed, "sig", "left_semi").select("leader", "c", "component").distinct()


def _dealt(rows: DataFrame, bands: Bands) -> DataFrame:
    """The members of a family (rows of one leader) with the blocks ``(leader, g, kind, i, j)`` in which they are compared, and their side in it.

    A family of up to BLOCK_ELEMENTS elements is one block of one side. In a larger one similar sets are in
    the same size band or in neighbours, so members of band g, dealt over salts, meet each other (kind 0:
    salt i with salt j) and those of band g - 1 (kind 1: salt i of g with salt j of g - 1).
    """
    rows = rows.withColumn("g", F.size(F.filter(F.array(*map(F.lit, bands.lower)), lambda low: low <= F.col("size"))))
    w = Window.partitionBy("leader")
    of_band = rows.groupBy("leader", "g").agg(F.sum("size").alias("elements")).select("leader", "g", F.sum("elements").over(w).alias("all"), F.ceil(F.col("elements") / BLOCK_ELEMENTS).cast("int").alias("s"))
    o = w.orderBy("g")
    beside = lambda f, step: F.when(f("g").over(o) == F.col("g") + step, f("s").over(o)).otherwise(0)
    of_band = of_band.select("leader", "g", "all", "s", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    mine = F.pmod(F.xxhash64("c"), F.col("s")).cast("int")
    block = lambda g, kind, i, j, side: F.struct(g.cast("int").alias("g"), F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), f)).otherwise(F.array().cast("array<struct<g:int,kind:int,i:int,j:int,side:int>>"))
    blocks = F.concat(
        upto(F.col("s"), lambda t: block(F.col("g"), 0, F.least(mine, t), F.greatest(mine, t), mine)),
        upto(F.col("below"), lambda t: block(F.col("g"), 1, mine, t, F.lit(0))),
        upto(F.col("above"), lambda t: block(F.col("g") + 1, 1, t, mine, F.lit(1))),
    )
    whole = F.array(block(F.lit(-1), 0, F.lit(0), F.lit(0), F.lit(0)))
    dealt = rows.join(of_band, ["leader", "g"]).withColumn("block", F.explode(F.when(F.col("all") <= BLOCK_ELEMENTS, whole).otherwise(blocks)))
    return dealt.select("leader", "block.*", "c", "component", "size")


def _across(mixed: DataFrame, sketched: DataFrame, bands: Bands, n: int) -> DataFrame:
    """Pairs (x, y) of components that a link between members of one large bucket joins."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _sorted_groups(batches, 5):
            component, size, side, sketch, text = cols[6:]
            key = np.stack(cols[:5], axis=1)
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            for a, b in zip(first, np.append(first[1:], len(key)), strict=True):
                across_only = key[a, 2] == 1 or key[a, 3] != key[a, 4]
                pairs = _Family(component[a:b], size[a:b], side[a:b] if across_only else None, sketch[a:b], bands).links(text[a:b], n)
                if pairs:
                    x, y = zip(*pairs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    sizes = sketched.select("c", "size").dropDuplicates(["c"])
    dealt = _dealt(mixed.join(sizes, "c"), bands).join(sketched.select("c", "sketch", "text").dropDuplicates(["c"]), "c")
    key = ["leader", "g", "kind", "i", "j"]
    ordered = dealt.select(*key, "c", "component", "size", "side", "sketch", "text").repartition(*key).sortWithinPartitions(*key, "size", "c")
    return ordered.mapInArrow(across, "x long, y long")


class _Family:
    """Classes of mixed buckets with one least member, sorted by size; with sides, only those of different sides are compared."""

    def __init__(self, component: np.ndarray, size: np.ndarray, side: np.ndarray | None, sketch: np.ndarray, bands: Bands):
        self.size, self.side, self.bands = size, side, bands
        self.names, self.component = np.unique(component, return_inverse=True)
        self.own = self.component.copy()
        self.sketch = [np.frombuffer(s, np.uint8) for s in sketch]
        self.width = np.array([len(s) for s in self.sketch])
        self.folded: dict[int, np.ndarray] = {}

    def _of_width(self, width: int) -> np.ndarray:
        """Sketches folded to a width (those that are narrower are left zero)."""
        if width not in self.folded:
            self.folded[width] = np.stack([_fold(s, width) if len(s) >= width else np.zeros(width, np.uint8) for s in self.sketch])
        return self.folded[width]

    def near(self, i: int) -> np.ndarray:
        """Smaller (or earlier) classes of other components that sizes and parities don't rule out, nearest first."""
        t = self.bands.t
        lo = int(np.searchsorted(self.size, self.size[i] * float(t) - 1e-6))
        other = self.component[lo:i] != self.component[i]
        if self.side is not None:
            other &= self.side[lo:i] != self.side[i]
        j = lo + np.flatnonzero(other)
        found, apart = [], []
        for width in np.unique(self.width[j]):
            z = j[self.width[j] == width]
            m = int(min(width, self.width[i]))
            d = _BITS[self._of_width(m)[z] ^ _fold(self.sketch[i], m)].sum(axis=1)
            most = (self.size[z] + self.size[i]) * (t.denominator - t.numerator) // (t.denominator + t.numerator)
            found.append(z[d <= most])
            apart.append(d[d <= most])
        if not found:
            return np.empty(0, np.int64)
        return np.concatenate(found)[np.argsort(np.concatenate(apart), kind="stable")]

    def links(self, text: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Links that join the family's components as far as they go; a pair already joined isn't compared."""
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = [s for w in tk.slices(pa.array([text[i]]), tk.SPACED_LOWER, strong=True) for s in _sets(w, n)][0]
            return sets[i]

        t, out = self.bands.t, []
        for i in range(1, len(self.size)):
            for j in self.near(i).tolist():
                if self.component[i] != self.component[j] and similar(of(i), of(j), t.numerator, t.denominator):
                    out.append((int(self.names[self.own[i]]), int(self.names[self.own[j]])))
                    self.component[self.component == self.component[j]] = self.component[i]
        return out
