"""Language identification by prediction by partial matching.

For each language the counts of byte contexts of orders 0 to 4 are frozen after training. A byte
costs -log2 of its probability in the longest context where it was seen, plus the escapes from the
longer ones (method C: with T symbols and U distinct ones seen in a context, a symbol seen n times
has n / (T + U) and the escape U / (T + U); below order 0 every byte has 1/256; symbols of a longer
context aren't excluded from a shorter one). A text's code length in a language is the exact sum
over all its bytes. The language of least code length is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import Scratch

U = np.uint64
ORDER = 4
#: At most so many labelled documents of each language are learned from (those of least id hash; whole texts).
SAMPLE_PER_LANGUAGE = 1_000
#: A text that every language codes in this many bits a byte or more, no better than raw bytes, is in none of them.
MOST_BITS = 8.0
SLICE_BYTES = 1 << 19
_EMPTY = np.iinfo(np.uint64).max


class Lookup:
    """Distinct 64-bit keys to their positions, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (len(keys) * 3).bit_length())
        self.shift = U(64 - bits)
        self.keys = np.full(1 << bits, _EMPTY, U)
        self.at = np.full(1 << bits, -1, np.int32)
        self.probes = 1
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            s = slot[waiting]
            _, first = np.unique(s, return_index=True)
            won = np.zeros(len(waiting), bool)
            won[first] = True
            won &= self.keys[s] == _EMPTY
            self.keys[s[won]] = keys[waiting[won]]
            self.at[s[won]] = waiting[won]
            waiting = waiting[~won]
            slot[waiting] = (slot[waiting] + 1) % len(self.keys)
            self.probes += bool(len(waiting))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for unknown keys."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        todo = np.flatnonzero((there != keys) & (there != _EMPTY))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) % len(self.keys)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.at[slot[todo[hit]]]
            todo = todo[~hit & (there != _EMPTY)]
        return out


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ORDER + 1)-grams ending at each byte, as integers, each text led by ORDER zero bytes; and where each text's grams start."""
    lead = bytes(ORDER)
    data = np.frombuffer(b"".join(lead + t for t in texts), np.uint8).astype(U)
    size = np.array([len(t) for t in texts], np.int64)
    g = np.zeros(max(len(data) - ORDER, 0), U)
    for j in range(ORDER + 1):
        g = g << U(8) | data[j : j + len(g)]
    start = np.concatenate(([0], np.cumsum(size)))
    keep = np.repeat(np.arange(len(texts)) * ORDER, size) + np.arange(start[-1])
    return g[keep], start


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode()


@dataclass
class Model:
    """Frozen statistics; its size is bounded by the training sample, not by the corpus."""

    languages: list[str]
    grams: list[Lookup]  # per order
    costs: list[np.ndarray]  # per order: bits of each known gram in every language
    contexts: list[Lookup]
    escapes: list[np.ndarray]

    @classmethod
    def from_counts(cls, languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
        model = cls(languages, [], [], [], [])
        for order in range(ORDER + 1):
            mask = U((1 << 8 * (order + 1)) - 1)
            key, at = np.unique(gram & mask, return_inverse=True)
            n = np.zeros((len(key), len(languages)))
            np.add.at(n, (at, lang), count)
            ctx, of = np.unique(key >> U(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), len(languages))), np.zeros((len(ctx), len(languages)))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            seen = total > 0
            both = np.where(seen, total + kinds, 1)
            escape = np.where(seen, -np.log2(np.where(seen, kinds, 1) / both), 0)
            shorter = model._bits(key & (mask >> U(8)), order - 1) if len(key) else np.zeros_like(n)
            cost = np.where(n > 0, -np.log2(np.where(n > 0, n, 1) / both[of]), escape[of] + shorter)
            model.grams.append(Lookup(key))
            model.costs.append(cost)
            model.contexts.append(Lookup(ctx))
            model.escapes.append(escape)
        return model

    def _bits(self, gram: np.ndarray, order: int) -> np.ndarray:
        """Bits of each gram's last byte after the ones before it, in every language."""
        if order < 0:
            return np.full((len(gram), len(self.languages)), 8.0)
        at = self.grams[order].find(gram)
        out = self.costs[order][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            g = gram[miss]
            ctx = self.contexts[order].find(g >> U(8))
            escape = np.where((ctx >= 0)[:, None], self.escapes[order][ctx], 0)
            out[miss] = escape + self._bits(g & U((1 << 8 * order) - 1), order - 1)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in every language."""
        out = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < SLICE_BYTES):
                size += len(texts[end])
                end += 1
            gram, start = _grams(texts[at:end])
            for lo in range(0, len(gram), SLICE_BYTES):  # a very long text goes in pieces, with all its contexts
                hi = min(lo + SLICE_BYTES, len(gram))
                bits = np.vstack([self._bits(gram[lo:hi], ORDER), np.zeros((1, len(self.languages)))])
                a, b = np.clip(start[:-1], lo, hi) - lo, np.clip(start[1:], lo, hi) - lo
                some = np.flatnonzero(b > a)
                out[at + some] += np.add.reduceat(bits, np.stack([a[some], b[some]], axis=1).ravel(), axis=0)[::2]
            at = end
        return out


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, held: int = 0, sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from rows with text and language whose id isn't in the held-out fold (null ids never are used)."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, folds) != held))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    named = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"))
    # of n documents, a little more than the sample lies below this hash: so few are ranked, however large a language is
    share = F.least(F.lit(1.0), (sample + 10 * sample**0.5 + 50) / F.col("n"))
    # the counts are a row a language, less than the model itself, which is broadcast whole; a join by shuffle would have a hot language
    few = named.join(F.broadcast(named.groupBy("lang").agg(F.count("*").alias("n"))), "lang").where(F.xxhash64("id").cast("double") <= share * 2.0**64 - 2.0**63)
    picked = few.withColumn("rank", rank).where(F.col("rank") <= sample)
    scratch = Scratch(docs.sparkSession)
    picked = scratch.table(picked.select("id").distinct(), "language-sample")
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).join(picked, "id", "left_semi")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_pylist()
            texts = [_bytes(t) for t in batch.column(1).to_pylist()]
            for name in sorted(set(lang)):
                gram, n = np.unique(_grams([t for t, x in zip(texts, lang, strict=True) if x == name])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    scratch.drop()
    names = counted.column("lang").combine_chunks().dictionary_encode() if len(counted) else pa.array([], pa.string()).dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    n = counted.column("n").to_numpy().astype(np.int64)
    gram = counted.column("gram").to_numpy().astype(np.int64).view(U)
    codes = names.indices.to_numpy().astype(np.int64)
    words = names.dictionary.to_pylist()
    kept = sorted(range(len(words)), key=lambda i: words[i])
    place = np.full(len(words), -1)
    place[kept] = np.arange(len(kept))
    return Model.from_counts([words[i] for i in kept], place[codes], gram, n)


def _judge(column: pa.Array, m: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, bits per byte) of each text."""
    texts = column.to_pylist()
    letter = regex.compile(r"\p{L}").search
    named = np.array([bool(t and m.languages and letter(t)) for t in texts], bool)
    if not m.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    raw = [_bytes(t) if ok else b"" for t, ok in zip(texts, named, strict=True)]
    bits = m.code_lengths(raw)
    best, least = bits.argmin(axis=1), bits.min(axis=1)
    score = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
    rate = least / np.maximum(1, [len(t) for t in raw])
    return [m.languages[b] if ok else "und" for b, ok in zip(best, named, strict=True)], np.where(named, score, 0.0), np.where(named, rate, 0.0)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, bits_per_byte``.

    Texts are lower-cased and read whole as UTF-8. score is the posterior of the predicted language
    under equal priors (ties go to the language that sorts first). Null text, text without a letter,
    and every text where nothing was learned: ``und`` with score 0. Repeated rows each get a row; an
    empty table gives none; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lang, score, rate = _judge(part.column(1), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang", most_bits: float = MOST_BITS) -> DataFrame:
    """The rows whose language can be told, with all their columns, ``lang`` replaced by the predicted language.

    Null and letterless texts go, and texts that no language's model codes in fewer than ``most_bits``
    bits a byte (letters at random, encoded data). Where nothing was learned, texts with a letter stay
    with the label they have. Repeated rows are judged each; an empty table gives none.
    """
    if not model.languages:
        return docs.where(F.col(text_col).cast("string").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, label = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lang, _, rate = _judge(part.column(place), shared.value)
                columns = part.columns
                columns[label] = pa.array(lang, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array((rate < most_bits) & np.array([x != "und" for x in lang], bool)))

    kinds = ", ".join(f"`{f.name}` {'string' if f.name == lang_col else f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, kinds)
