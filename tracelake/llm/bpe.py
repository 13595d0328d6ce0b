"""Byte-level BPE on padded numpy matrices.

Pieces of text are put into matrices by length, one row a piece and one column a token. In each
round every row merges its leftmost pair of least rank; the pair's rank comes from a hash table of
all mergeable pairs of token ids. A merge takes one column out of its row, so the matrix of the
rows that are still at work is compacted to one column less. Rows without a mergeable pair leave.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
NONE = np.int32(2**31 - 1)
#: Matrix widths; a longer piece is merged in the same order with a heap, as a matrix would take rounds x width steps.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Pieces whose ids a task keeps; then it starts afresh.
CACHE = 200_000
SLICE_CHARS = 1 << 20
#: The characters of the White_Space property, which ``\\s`` means to the tokenizer's own pattern engine.
WHITE_SPACE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def own_pattern(pattern: str) -> str:
    """The pattern with white space spelt out."""
    for before, after in (("[^\\s", f"[^{WHITE_SPACE}"), ("\\S", f"[^{WHITE_SPACE}]"), ("\\s", f"[{WHITE_SPACE}]")):
        pattern = pattern.replace(before, after)
    return pattern


class Vocabulary:
    """Ranks as arrays; of a size fixed by the vocabulary, so fit to be broadcast."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * top
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.whole = ranks
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = np.array(left, U) << U(32) | np.array(right, U)
        self.shift = 64 - (len(key) * 4).bit_length()
        self.keys = np.full(1 << (64 - self.shift), np.iinfo(np.uint64).max, U)
        self.values = np.full(len(self.keys), NONE, np.int32)
        self.probes = 1
        waiting, slot = np.arange(len(key)), self._slot(key)
        while len(waiting):  # open addressing: whoever finds its slot taken moves on by one
            at = slot[waiting]
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at, return_index=True)
            won = np.zeros(len(waiting), bool)
            won[first] = True
            won &= free
            self.keys[at[won]] = key[waiting[won]]
            self.values[at[won]] = np.array(rank, np.int32)[waiting[won]]
            waiting = waiting[~won]
            slot[waiting] = (slot[waiting] + 1) % len(self.keys)
            if len(waiting):
                self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * U(0x9E3779B97F4A7C15) >> U(self.shift)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where it has none or an id is padding (-1)."""
        key = a.astype(np.int64).astype(U) << U(32) | b.astype(np.uint32).astype(U)
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        slot = self._slot(key[todo])
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != np.iinfo(np.uint64).max)
            if not on.any():
                break
            todo, slot = todo[on], (slot[on] + 1) % len(self.keys)
        return out

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of a matrix of single-byte ids padded with -1."""
        n, width = ids.shape
        done: list[np.ndarray | None] = [None] * n
        row = np.arange(n)
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.full((n, 0), NONE, np.int32)
        while True:
            least = rank.min(axis=1) if rank.shape[1] else np.full(len(row), NONE, np.int32)
            rest = least == NONE
            for r, x in zip(row[rest].tolist(), ids[rest], strict=True):
                done[r] = x[x >= 0]
            row, ids, rank = row[~rest], ids[~rest], rank[~rest]
            if not len(row):
                return done
            i = np.arange(len(row))
            j = rank.argmin(axis=1)
            ids[i, j] = rank[i, j]
            keep = np.ones(ids.shape, bool)
            keep[i, j + 1] = False
            ids = ids[keep].reshape(len(row), -1)
            keep = np.ones(rank.shape, bool)
            keep[i, j] = False
            rank = rank[keep].reshape(len(row), -1)
            before = np.flatnonzero(j > 0)
            rank[before, j[before] - 1] = self.pair_ranks(ids[before, j[before] - 1], ids[before, j[before]])
            after = np.flatnonzero(j < rank.shape[1])
            rank[after, j[after]] = self.pair_ranks(ids[after, j[after]], ids[after, j[after] + 1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        on, back = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i) for i, r in enumerate(pair) if r != NONE]
        heapq.heapify(heap)
        pair.append(int(NONE))

        def renew(i: int) -> None:
            j = on[i]
            pair[i] = self.whole.get(self.tokens[ids[i]] + self.tokens[ids[j]], int(NONE)) if j < n else int(NONE)
            if pair[i] != NONE:
                heapq.heappush(heap, (pair[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or pair[i] != r:
                continue
            j = on[i]
            ids[i], ids[j] = r, -1
            on[i] = on[j]
            if on[i] < n:
                back[on[i]] = i
            renew(i)
            if back[i] >= 0:
                renew(back[i])
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        out: list[bytes | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            r = self.whole.get(p)
            if r is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) > WIDTHS[-1]:
                out[i] = self.merge_long(p).astype("<u4").tobytes()
            else:
                by_width.setdefault(next(w for w in WIDTHS if w >= len(p)), []).append(i)
        for width, members in by_width.items():
            for at in range(0, len(members), 8192):
                some = members[at : at + 8192]
                size = np.array([len(pieces[i]) for i in some])
                flat = self.single[np.frombuffer(b"".join(pieces[i] for i in some), np.uint8)]
                ids = np.full((len(some), width), -1, np.int32)
                ids[np.arange(width) < size[:, None]] = flat
                for i, x in zip(some, self.merge_rows(ids), strict=True):
                    out[i] = x.astype("<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.offset[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at].tobytes()


class Encoder:
    """Encodes texts piece by piece, keeping the ids of pieces that it has met."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v = vocabulary
        self.find = regex.compile(own_pattern(pattern)).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.find(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = set().union(*pieces)
        order = list(new)
        self.known.update(zip(order, self.v.encode_pieces([p.encode() for p in order]), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256, lossless`` (and ``ids``).

    Each match of ``pattern`` is encoded separately and without special tokens; the ids are decoded
    again, and ``lossless`` says whether that gave the text's bytes. ids_sha256 is of the ids as
    little-endian unsigned 32-bit integers. Null text counts as empty (no ids); any length is taken
    whole; repeated rows each get theirs; an empty table gives an empty result; other columns are
    ignored. The vocabulary is read on the driver and broadcast: its size is that of the rank file.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(load_ranks(ranks_path)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        encoder = Encoder(v, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < SLICE_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                some = [t or "" for t in texts[at:end]]
                coded = encoder.encode(some)
                n, ids_hash, text_hash, same = [], [], [], []
                for t, b in zip(some, coded, strict=True):
                    decoded = v.decode(np.frombuffer(b, "<u4"))
                    n.append(len(b) // 4)
                    ids_hash.append(hashlib.sha256(b).hexdigest())
                    text_hash.append(hashlib.sha256(decoded).hexdigest())
                    same.append(decoded == t.encode())
                columns = [batch.column(0).slice(at, end - at), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash), pa.array(same)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = end

    out = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, out)
