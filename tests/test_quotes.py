"""Frames, source spans and near misses: literal cases, and the plain way over all pairs."""

import difflib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import quotes as Q

FRAMES = [
    ("plain words", None, "plain words"),
    ("[step 3] [evt_ab][agent][kind] Observation: it said so", "evt_ab", "it said so"),
    ("step 12: output= {'a': 1}", None, "{'a': 1}"),
    ("step 3 of the plan", None, "step 3 of the plan"),
    ("step 3 evt_9: gone", "evt_9", "gone"),
    ("event_id=x-1 type=tool agent=me Thought: \"well\"", "x-1", "well"),
    ("(evt_z) ACTION (tool error: gone): `go`", "evt_z", "go"),
    ("evt_q", "evt_q", ""),
    ("evt_q-1 : rest of it", "evt_q", "1 : rest of it"),
    ("evt_q : rest: of it", "evt_q", "rest: of it"),
    ('"answer": 5', None, '"answer": 5'),
    ("“curly”", None, "curly"),
    ("verifier signal: 'x' and 'y'", None, "x' and 'y"),
    ("  ", None, ""),
]


def test_frames(spark):
    got = spark.createDataFrame([(q,) for q, _, _ in FRAMES], "q string").select("q", Q.framed(F.col("q")).alias("f")).collect()
    assert {r.q: (r.f.declared, r.f.content) for r in got} == {q: (d, c) for q, d, c in FRAMES}


text = st.text(st.sampled_from("ab\\nt\"' \t\n`“…"), max_size=25)


@settings(max_examples=400, deadline=None)
@given(text, st.booleans(), st.data())
def test_spans_lead_back_to_the_source(s, drop, data):
    """The mapped text is the plain normalisation, and each hit's span normalises to the hit."""
    plain = s
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'")):
        plain = plain.replace(a, b)
    norm = lambda x: re.sub(r"\s+", " ", x).strip()
    want = norm(re.sub(f"[{Q.MARKS}]", "", norm(plain))) if drop else norm(plain)
    pieces = Q.with_map(s, drop)
    assert pieces[0] == want
    if want:
        a = data.draw(st.integers(0, len(want) - 1))
        b = data.draw(st.integers(a + 1, len(want)))
        i, j = Q.source_span(pieces, a, b)
        assert 0 <= i < j <= len(s)
        if want[a] != " " and want[b - 1] != " ":
            assert Q.with_map(s[i:j], drop)[0] == want[a:b]


def test_spans_match_the_columns(spark):
    """The Column functions and the mapped text agree, so that what one finds the other places."""
    rows = ["a\\n b", "x ' y", "  lead", "tail\\t ", "say \\\"hi\\\" now", "'q'", "”", "a   b", "c\x85d"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", T.squeeze(T.unescape(F.col("s"))).alias("n"), T.canonical(F.col("s")).alias("c")).collect()
    assert [(Q.with_map(r.s)[0], Q.with_map(r.s, True)[0]) for r in got] == [(r.n, r.c) for r in got]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abc d"), max_size=30), st.text(st.sampled_from("abc d"), max_size=60))
def test_similarity_is_that_of_matching_blocks(needle, hay):
    m = difflib.SequenceMatcher(None, hay, needle, autojunk=False).find_longest_match(0, len(hay), 0, len(needle))
    at = max(0, m.a - m.b)
    want = difflib.SequenceMatcher(None, hay[at : at + len(needle)], needle, autojunk=False).ratio() if needle and hay and m.size else 0.0
    assert Q.similarity(needle, hay)[0] == want


@pytest.mark.parametrize("threshold", [0.6, 0.85, 0.95])
def test_near_misses_lose_nothing(spark, threshold):
    rng = random.Random(int(threshold * 100))
    words = ["alpha", "beta", "gamma", "delta", "tool", "error", "plan", "日本", "x1"]
    runs = [(f"t{t}", f"e{t}_{i}", i, " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for t in range(4) for i in range(12)] + [("t0", "e0_x", 50, None)]

    def spoilt(s):
        at = rng.randrange(0, max(1, len(s) - 5))
        s = list(s[at : at + rng.randrange(3, 60)])
        for _ in range(rng.randrange(0, 6)):
            if s:
                i = rng.randrange(len(s))
                s[i : i + rng.randrange(0, 2)] = rng.choice(["#", "", "zz"])
        return "".join(s)

    quotes = [(t, f"q{k}", " ".join(spoilt(s).split()), e if k % 3 else None) for k, (t, e, _, s) in enumerate(rng.choices(runs[:-1], k=80))]
    want = {}
    for t, q, s, anchor in quotes:
        scored = [(-Q.similarity(s, " ".join(said.split()))[0], e != anchor, pos, e) for tt, e, pos, said in runs if tt == t and said]
        if s and scored and -min(scored)[0] >= threshold:
            want[q] = (min(scored)[3], -min(scored)[0])
    df = spark.createDataFrame(quotes, "trace_id string, quote_id string, sought string, anchor string")
    got = Q.near_misses(df, spark.createDataFrame(runs, "trace_id string, event_id string, pos int, text string"), threshold).collect()
    assert {r.quote_id: (r.found_id, r.similarity) for r in got} == want and len(want) > 10


def test_places(spark):
    runs = spark.createDataFrame(
        [("t", "evt_1", 0, "He said \\\"stop\\\"\\n at  once"), ("t", "evt_2", 1, "stop at once, he said"), ("t", "evt_3", 2, None), ("u", "evt_4", 0, "elsewhere only")], "trace_id string, event_id string, pos int, text string"
    )
    rows = [
        ("a", None, "stop at once", "exact", "evt_2", "stop at once", "not_declared"),
        ("b", "evt_1", "said \"stop\" at once", "normalized", "evt_1", "said \\\"stop\\\"\\n at  once", "resolved"),
        ("c", None, "said 'stop' at once [truncated]", "canonical", "evt_1", "said \\\"stop\\\"\\n at  once", "not_declared"),
        ("d", None, "[step 2] evt_3: Observation: stop at once, he", "exact", "evt_2", "stop at once, he", "elsewhere"),
        ("e", None, "stop at onse, he said", "similar", "evt_2", "stop at once, he said", "not_declared"),
        ("f", "evt_3", "nothing of the kind was there", "anchored", "evt_3", None, "resolved"),
        ("g", "evt_9", "elsewhere only", "unresolvable", None, None, "unknown_event"),
        ("h", None, " ", "unresolvable", None, None, "not_declared"),
        ("i", None, None, "unresolvable", None, None, "not_declared"),
        ("j", None, "said", "exact", "evt_1", "said", "not_declared"),
    ]
    quotes = spark.createDataFrame([("t", *r[:3], "extra") for r in rows], "trace_id string, quote_id string, anchor string, quote string, found string")
    got = {r.quote_id: (r.rung, r.event_id, r.found, r.anchor_state) for r in Q.place(quotes, runs, 0.85).collect()}
    assert got == {r[0]: r[3:] for r in rows}
    assert Q.place(quotes.limit(0), runs, 0.85).count() == 0 and Q.place(quotes, runs.limit(0), 0.85).where("rung = 'unresolvable'").count() == len(rows)
