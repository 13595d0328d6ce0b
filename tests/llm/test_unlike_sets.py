"""Unlike words and unlike sets stay apart, also where hashes are made to meet."""

import numpy as np
import pyarrow as pa
import pytest

from tracelake.llm import ngram_join
from tracelake.llm import textkernel as tk

from . import cases


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_of_regular_build_do_not_meet(spark):
    """The pair that sums of powers modulo 2^64 take for equal."""
    pairs = [thue_morse(n) for n in (8, 64, 1024, 4096)]
    rows = [(i, t) for i, t in enumerate(x for p in pairs for x in p)]
    w = next(iter(tk.slices(pa.array([t for _, t in rows]), tk.SPACED_LOWER, strong=True)))
    assert len(set(w.hash.tolist())) == len(rows)
    rows += [(100, rows[5][1].upper()), (101, f"one two three four {rows[4][1]}"), (102, f"one two three four {rows[5][1]}")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.jaccard_components(rows)


def test_equal_words_are_equal_wherever_they_stand():
    words = ["a", "abcdefgh", "abcdefghi", "x" * 64, "x" * 65, "é" * 33, "Z" * 200]
    hashes = []
    for lead in ("", "q ", "some other words "):
        for tail in ("", " t"):
            w = next(iter(tk.slices(pa.array([lead + " ".join(words) + tail]), tk.SPACED_LOWER, strong=True)))
            n = len(lead.split())
            hashes.append(w.hash[n : n + len(words)].tolist())
    assert all(h == hashes[0] for h in hashes) and len(set(hashes[0])) == len(words)


@pytest.mark.parametrize("bits", [1, 5, 64])
def test_classes_that_share_a_hash(spark, bits):
    rng = np.random.default_rng(bits)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, "one three")]
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(int(rng.integers(3, 60)))]
        for copy in range(4):
            text = list(base)
            if copy:
                text[int(rng.integers(0, len(text)))] = f"n{copy}"
            rows.append((len(rows), " ".join(text)))
        rows.append((len(rows), " ".join(base).upper()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_components(df, key_bits=bits).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == cases.jaccard_components(rows)
