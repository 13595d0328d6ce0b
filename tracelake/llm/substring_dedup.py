"""Removal of word passages that start earlier in the corpus, by suffix automata over reference shards.

Every window of 20 words has one anchor: the least-hash word k-gram in it (winnowing), so equal
windows share an anchor. Stages, all on one shuffle of the texts by id:

1. anchors of every document meet by hash; those that occur twice or more remain;
2. each run of windows with one such anchor (about 25 words) is routed by that anchor, so all
   windows that could be equal are in one shard. Within a task, later copies of a run are marked
   at once and only the first travels, which keeps a passage of very many documents small;
3. a shard reads its runs in order of (document, start), streams each through the suffix automaton
   of what came before (matching statistics), marks spans matched for 20 words or more, and adds
   the runs whose windows come again;
4. the marks meet the texts.

The automata aren't broadcast: their total size grows with the corpus, so reference shards and the
runs that need them meet by shuffle instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk

U = np.uint64
#: Words of an anchor; a window of 20 words has 9 of them.
ANCHOR = 12


class SuffixAutomaton:
    """Online generalised suffix automaton over hashable symbols."""

    __slots__ = ("next", "link", "length")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state for the shorter strings of q that are reached from p by c."""
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def add(self, symbols) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            cur = self._state(length[last] + 1, {}, 0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = cur

    def matching_statistics(self, symbols) -> Iterator[int]:
        """For each symbol, the length of the longest substring ending there that was added."""
        nxt, link, length = self.next, self.link, self.length
        at = n = 0
        for c in symbols:
            while at and c not in nxt[at]:
                at = link[at]
                n = length[at]
            if c in nxt[at]:
                at = nxt[at][c]
                n += 1
            yield n


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``(h, doc_id, pos, sure)`` of anchors. Of an anchor that a slice of documents has several times, two go by its
    hash; the rest are known to be repeated and are dealt by place, so an anchor of very many documents is no hot key."""
    for batch in batches:
        for w in tk.slices(batch.column(1), tk.SPACED):
            at = tk.winnow(w, ANCHOR, window)
            if len(at):
                h = tk.grams(w.hash, ANCHOR)[at]
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                sure = np.zeros(len(h), bool)
                sure[order[2:]] = same[1:] & same[:-1]
                doc = w.doc[at]
                pos = (at - w.bounds[doc]).astype(np.int32)
                ids = batch.column(0).take(pa.array(doc + w.first))
                h[sure] = tk.mix(h[sure] + tk.mix(at[sure].astype(U) + U(batch.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array(pos), pa.array(sure)], names=["h", "doc_id", "pos", "sure"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, those that have an equal neighbour or are sure to; one row waits for the next batch."""
    held: pa.RecordBatch | None = None
    before = None  # hash of the row ahead of ``held``
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = batch.column(0).to_numpy()
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[0] = before is not None and h[0] == before
        later = np.zeros(len(h), bool)
        later[:-1] = same[1:]
        out = (same | later | batch.column(3).to_numpy(zero_copy_only=False))[:-1]
        if len(h) > 1:
            before = h[-2]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["doc_id", "pos"]).slice(0, len(h) - 1).filter(pa.array(out))
        held = batch.slice(len(h) - 1)
    if held is not None and (held.column(3)[0].as_py() or before is not None and held.column(0)[0].as_py() == before):
        yield pa.RecordBatch.from_arrays([held.column(1), held.column(2)], names=["doc_id", "pos"])


def _runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows around repeated anchors, from (doc_id, text, positions) sorted by doc_id.

    Out: (key, doc_id, start, n, words). A run whose words were seen in this task already has
    null words and a key of its own: all of it is marked.
    """
    seen: dict[bytes, tuple] = {}  # digests of runs, so as many bytes a run however long it is
    for batch in batches:
        ids, places = batch.column(0), batch.column(2)
        for w in tk.slices(batch.column(1), tk.SPACED):
            g = tk.grams(w.hash, ANCHOR)
            steps = window - ANCHOR + 1
            n = len(w.hash) - window + 1
            if n <= 0:
                continue
            least, at = g[:n].copy(), np.zeros(n, np.int64)
            for j in range(1, steps):
                x = g[j : j + n]
                take = x <= least
                least[take] = x[take]
                at[take] = j
            anchor = at + np.arange(n)
            hot = np.zeros(len(w.hash), bool)
            mine = places.slice(w.first, w.n_docs)
            flat = mine.flatten().to_numpy(zero_copy_only=False)
            hot[np.repeat(w.bounds[:-1], np.diff(mine.offsets.to_numpy())) + flat] = True
            live = np.flatnonzero(tk.within(w.doc, window) & hot[anchor])
            if not len(live):
                continue
            new = np.ones(len(live), bool)
            new[1:] = (anchor[live[1:]] != anchor[live[:-1]]) | (live[1:] != live[:-1] + 1)
            first = live[new]
            last = live[np.append(new[1:], True)] + window
            keys, docs, starts, sizes, texts = [], [], [], [], []
            for a, b, h, d in zip(first.tolist(), last.tolist(), g[anchor[first]].view(np.int64).tolist(), w.doc[first].tolist(), strict=True):
                words = w.text(a, b)
                place = (ids[w.first + d].as_py(), a - int(w.bounds[d]))
                if seen.setdefault(hashlib.blake2b(words, digest_size=16, key=h.to_bytes(8, "big", signed=True)).digest(), place) == place:
                    texts.append(words)
                else:
                    texts.append(None)
                    h = hash(place) ^ (a << 20)
                keys.append(h)
                docs.append(d + w.first)
                starts.append(place[1])
                sizes.append(b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), ids.take(pa.array(docs)), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary())], names=["key", "doc_id", "start", "n", "words"]
            )


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of equal first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        at = int(np.searchsorted(key, key[-1], side="left"))
        if held and (at or held[-1].column(0)[held[-1].num_rows - 1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
        elif at:
            yield pa.Table.from_batches([batch.slice(0, at)])
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _marks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Spans (doc_id, start, stop) whose windows start earlier, from runs sorted by (key, doc_id, start)."""
    for rows in _whole_groups(batches):
        rows = rows.combine_chunks()
        key, start, size = (rows.column(i).to_numpy() for i in (0, 2, 3))
        null = rows.column(4).is_null().to_numpy(zero_copy_only=False)
        spans = [(i, int(start[i]), int(start[i] + size[i])) for i in np.flatnonzero(null)]
        routed = np.flatnonzero(~null)
        if len(routed):
            ids = rows.column(1).take(pa.array(routed))
            # a repeated input row repeats its runs; they are the same place, not an earlier one
            twice = np.zeros(len(routed), bool)
            if len(routed) > 1:
                same_id = pa.compute.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
                twice[1:] = (key[routed][1:] == key[routed][:-1]) & (start[routed][1:] == start[routed][:-1]) & same_id.astype(bool)
            routed = routed[~twice]
            texts = rows.column(4).take(pa.array(routed))
            spans += [(int(routed[i]), int(start[routed[i]]) + a, int(start[routed[i]]) + b) for i, a, b in _earlier(key[routed], texts, window)]
        if spans:
            i, a, b = zip(*spans, strict=True)
            ids = rows.column(1).take(pa.array(i))
            yield pa.RecordBatch.from_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "start", "stop"])


def _earlier(key: np.ndarray, texts: pa.ChunkedArray, window: int) -> list[tuple[int, int, int]]:
    """(run, from, to) in words: what an earlier run of the same key has as a window."""
    owner, hashes, offset = [], [], []
    for w in tk.slices(texts.cast(pa.string()), tk.SPACED):
        ok = np.flatnonzero(tk.within(w.doc, window))
        owner.append(w.doc[ok] + w.first)
        offset.append(ok - w.bounds[w.doc[ok]])
        hashes.append(tk.mix(tk.grams(w.hash, window)[ok] ^ tk.mix(key[w.doc[ok] + w.first].astype(np.int64).view(U))))
    run, at, h = map(np.concatenate, (owner, offset, hashes))
    # which windows come twice is a hint that keeps the automata small; equality is theirs to decide
    _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    original = np.zeros(len(h), bool)
    original[first] = True
    out: list[tuple[int, int, int]] = []
    automaton, shard = SuffixAutomaton(), None
    live = np.flatnonzero(again)
    if not len(live):
        return out
    edges = np.flatnonzero(np.concatenate(([True], run[live][1:] != run[live][:-1])))
    for a, b in zip(edges, [*edges[1:], len(live)], strict=True):
        mine = live[a:b]
        i = int(run[mine[0]])
        if shard != key[i]:
            automaton, shard = SuffixAutomaton(), key[i]
        words = texts[i].as_py().split(b" ")
        later = mine[~original[mine]]
        if len(later):
            lo, hi = int(at[later[0]]), int(at[later[-1]]) + window
            begin = None
            for e, n in enumerate(automaton.matching_statistics(words[lo:hi]), lo + 1):
                if n >= window:
                    if begin is None or e - window > out[-1][2]:
                        out.append((i, e - window, e))
                        begin = e
                    else:
                        out[-1] = (i, out[-1][1], e)
        if len(later) < len(mine):
            new = mine[original[mine]]
            automaton.add(words[int(at[new[0]]) : int(at[new[-1]]) + window])
    return out


def _masked(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Digest of each text without its marked words, from (doc_id, text, copy, spans, carried columns)."""
    for batch in batches:
        raw = batch.column(1).cast(pa.large_binary())
        n_words, n_removed, digest, left = [], [], [], []
        for text, copy, spans in zip(raw, batch.column(2).to_pylist(), batch.column(3), strict=True):
            words = (text.as_py() or b"").split()
            n = len(words)
            if copy and n >= window:
                kept = []
            elif spans.is_valid and len(spans):
                keep = bytearray(b"\x01") * n
                for s in spans.as_py():
                    keep[s["start"] : s["stop"]] = bytes(s["stop"] - s["start"])
                kept = [x for x, k in zip(words, keep, strict=True) if k]
            else:
                kept = words
            joined = b" ".join(kept)
            n_words.append(n)
            n_removed.append(n - len(kept))
            digest.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                left.append(joined.decode() if len(kept) < n else text.as_py().decode() if text.is_valid else None)
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(left, pa.string()))
            names.append("text")
        columns += batch.columns[4:]
        names += batch.schema.names[4:]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_earlier_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256``.

    ``with_text`` adds ``text``: the kept words joined by one space where some go, else the text as it is.
    ``carry`` names other columns to pass through; they come back as ``c0, c1, ...`` in that order.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if some window of ``window`` consecutive
    words over it starts earlier too: in a document of smaller id, or earlier in its own. Windows are
    those of the input. Null and empty texts have no words; texts shorter than the window lose none;
    rows that repeat an id are the same document and don't count as earlier; rows of null id are
    neither judged nor a reference. An empty table gives an empty result; columns that aren't carried are ignored.
    """
    spark = docs.sparkSession
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # renamed as a whole: an alias would keep Spark from seeing that the exchanges are the same
    extra = [f"c{i}" for i in range(len(carry))]
    every = docs.select(id_col, text_col, *carry)
    if every.columns != ["doc_id", "text", *extra]:
        every = every.toDF("doc_id", "text", *extra)
    rows = every.where("doc_id is not null")
    # copies: all windows of a later copy start earlier in the first one, so only first copies go on
    keyed = rows.where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("m"))
    first = keyed.groupBy("m").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    copies = keyed.join(first, "m").where("doc_id <> first").select("doc_id").distinct().withColumn("copy", F.lit(True))
    # one exchange of the texts serves the anchors, the runs and the result
    base = rows.repartition(parts, "doc_id").join(copies, "doc_id", "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), *extra)
    fresh = base.where("not copy").select("doc_id", "text")

    anchors = fresh.mapInArrow(lambda b: _anchor_rows(b, window), f"h long, doc_id {kind}, pos int, sure boolean")
    repeated = anchors.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_repeated, f"doc_id {kind}, pos int")
    places = repeated.groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
    runs = fresh.join(places, "doc_id").sortWithinPartitions("doc_id").mapInArrow(lambda b: _runs(b, window), f"key long, doc_id {kind}, start int, n int, words binary")
    marks = runs.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(lambda b: _marks(b, window), f"doc_id {kind}, start int, stop int")
    spans = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    judged = base.join(spans, "doc_id", "left").select("doc_id", "text", "copy", "spans", *extra)
    unnamed = every.where("doc_id is null").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<start:int,stop:int>>").alias("spans"), *extra)
    out = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text + "".join(f", {c} {every.schema[c].dataType.simpleString()}" for c in extra)
    return judged.unionByName(unnamed).mapInArrow(lambda b: _masked(b, window, with_text), out)
