"""Where a quote stands in its run: frames, source spans of normalised hits, and near misses.

A quote is searched as it is and without the frame that a renderer or a model puts around it. Events are
candidates if they hold the quote's longest inner word, so that a quote isn't read against every event of
its run; near misses are candidates by shared character triples, of which a similar window must share a
number that follows from the threshold.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import canonical, quote_norm, squeeze, unescape
from ..sources.staging import cut

# The labels, field names and marks of frames.
ROLES = "thought|action|observation|feedback|env|error|solver|signal|user|executor|verifier[ _]signal|verification|verifier"
FIELDS = "input|output|error|metadata"
WRAPPING = (('"', '"'), ("'", "'"), ("`", "`"), ("“", "”"), ("‘", "’"))
MARKS = "\"'`‘’“”"
RUNGS = ("exact", "normalized", "canonical", "similar", "anchored", "unresolvable")

_ROLE = rf"(?:{ROLES})(?:\s*\([^)]*\))?\s*:"
_STEP = rf"(?:\[step\s+\d+\]|step\s+\d+\s*[:\-]|step\s+\d+(?=\s+(?:[\[(]?evt_|event_id\s*=|{_ROLE})))?\s*"
#: Groups 1 to 4: the event that a frame names.
_EVENT = r"(?:\[(evt_\w+)\](?:\[[^\]]*\]){0,2}|\((evt_\w+)\)|event_id\s*=\s*([^\s,;:]+)|(evt_\w+)\s*[:\-])?\s*"
FRAME = rf"(?i)^\s*{_STEP}{_EVENT}(?:(?:type|agent)=\S+\s*)*(?:{_ROLE})?\s*(?:(?:{FIELDS})\s*[:=])?\s*"
_BARE = r"(?s)^(evt_[A-Za-z0-9_-]+)(?:\s*:\s*(.*))?$"
#: White space as Java's Unicode classes have it.
_BLANK = "\t-\r \x85\xa0  -     　"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def framed(quote: Column) -> Column:
    """``(declared, content)`` of a quote: the event id that its frame, or the quote itself, names (null without one), and what is left without the frame and without one matching pair of marks."""
    groups = [F.nullif(F.regexp_extract(quote, FRAME, i), F.lit("")) for i in (1, 2, 3, 4)]
    parts = F.struct(F.coalesce(*groups).alias("named"), strip(F.regexp_replace(quote, FRAME, "")).alias("rest"))
    bare = lambda p: F.when(p["named"].isNull(), F.nullif(F.regexp_extract(p["rest"], _BARE, 1), F.lit("")))
    told = lambda p: bind(bare(p), lambda b: F.struct(F.coalesce(p["named"], b).alias("declared"), F.when(b.isNotNull(), strip(F.regexp_extract(p["rest"], _BARE, 2))).otherwise(p["rest"]).alias("inner")))

    def unwrapped(t: Column) -> Column:
        pairs = [F.startswith(t["inner"], F.lit(a)) & F.endswith(t["inner"], F.lit(b)) for a, b in WRAPPING]
        either = pairs[0]
        for p in pairs[1:]:
            either = either | p
        whole = F.when((F.char_length(t["inner"]) >= 2) & either, strip(F.substring(t["inner"], F.lit(2), F.char_length(t["inner"]) - 2))).otherwise(t["inner"])
        return F.struct(t["declared"].alias("declared"), whole.alias("content"))

    return bind(bind(parts, told), unwrapped)


# --- source spans


def with_map(text: str, drop_marks: bool = False) -> tuple[str, list[int], list[int], list[int]]:
    """The normalised text, and its pieces: where each starts in it, and its start and end in ``text``.

    Escapes become their characters, runs of white space one space, and the ends are trimmed;
    ``drop_marks`` drops quotation marks besides. A piece is a run of white space, an escape, or a stretch
    that stands as it is, so the map is as short as the text is plain.
    """
    gap = rf"(?:\\[nt]|[{_BLANK}]{rf'|\\[{chr(34)}{chr(39)}]|[{MARKS}]' if drop_marks else ''})+"
    blank = re.compile(rf"\\[nt]|[{_BLANK}]")
    out, at, start, stop, n, last = [], [], [], [], 0, 0

    def put(s: str, a: int, b: int) -> None:
        nonlocal n
        if s:
            out.append(s)
            at.append(n)
            start.append(a)
            stop.append(b)
            n += len(s)

    for m in re.finditer(rf"{gap}|\\[\"']", text):
        put(text[last : m.start()], last, m.start())
        last = m.end()
        if not drop_marks and m[0] in ('\\"', "\\'"):
            put(m[0][1], m.start(), last)
        elif blank.search(m[0]) and n and last < len(text):
            put(" ", m.start(), last)
    put(text[last:], last, len(text))
    at.append(n)
    norm = "".join(out)
    # marks at the end may leave a space there
    return norm.rstrip(" ") if drop_marks else norm, at, start, stop


def source_span(pieces: tuple[str, list[int], list[int], list[int]], a: int, b: int) -> tuple[int, int]:
    """The part of the source that characters a to b (b excluded) of the normalised text come from."""
    _, at, start, stop = pieces
    i, j = bisect_right(at, a) - 1, bisect_right(at, b - 1) - 1
    plain = lambda k: at[k + 1] - at[k] == stop[k] - start[k]
    return start[i] + (a - at[i] if plain(i) else 0), start[j] + (b - at[j]) if plain(j) else stop[j]


def find_span(text: str, needle: str, rung: int) -> tuple[int, int] | None:
    """Where ``needle`` (normalised for its rung: 0 exact, 1 normalised, 2 canonical) stands in ``text``."""
    if rung == 0:
        a = text.find(needle)
        return (a, a + len(needle)) if a >= 0 else None
    pieces = with_map(text, rung == 2)
    a = pieces[0].find(needle)
    return source_span(pieces, a, a + len(needle)) if a >= 0 and needle else None


# --- near misses


def longest_common(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run; of equals the first in a, then in b."""
    best, run = (0, 0, 0), np.zeros(len(a) + 1, np.int32)
    for j, x in enumerate(b):
        run[1:] = np.where(a == x, run[:-1] + 1, 0)
        end = int(run.argmax())
        m = int(run[end])
        if m and (m, -(end - m), -(j + 1 - m)) > (best[2], -best[0], -best[1]):
            best = (end - m, j + 1 - m, m)
    return best


def similarity(needle: str, text: str) -> tuple[float, int, int]:
    """How like ``needle`` the window around their longest common run is, by matching blocks; and the window."""
    if not needle or not text:
        return 0.0, 0, 0
    codes = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b, n = longest_common(codes(text), codes(needle))
    if not n:
        return 0.0, 0, 0
    at = max(0, a - b)
    window = text[at : at + len(needle)]
    return difflib.SequenceMatcher(None, window, needle, autojunk=False).ratio(), at, at + len(window)


def least_shared(n: Column, distinct: Column, threshold: float) -> Column:
    """Distinct triples of a text of ``n`` characters (``distinct`` of them) that any window as similar as ``threshold`` shares.

    A ratio 2m / (n + w) of the threshold leaves n - m and w - m characters, hence at most n + w - 2m + 1
    blocks, each of which loses two triples; w is at least m.
    """
    w = F.ceil(n * (threshold / (2 - threshold)) - 1e-9)
    m = F.ceil((n + w) * (threshold / 2) - 1e-9)
    within = F.greatest(F.lit(0), m - (n + w - m * 2 + 1) * 2)
    return distinct - F.greatest(F.lit(0), n - 2 - within)


@F.pandas_udf(ArrayType(LongType()))
def triples(text: pd.Series) -> pd.Series:
    """The distinct character triples, 21 bits a character."""

    def of(s: str | None) -> np.ndarray:
        c = np.frombuffer((s or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.empty(0, np.int64)

    return text.map(of)


# the optimizer would repeat the function in filters that it infers, where no Python runs
triples = triples.asNondeterministic()


def _spans(rows: DataFrame) -> DataFrame:
    """Adds ``span(start, stop)`` from ``said``, ``sought`` and ``rung``."""

    @F.pandas_udf("start int, stop int")
    def run(said: pd.Series, sought: pd.Series, rung: pd.Series) -> pd.DataFrame:
        found = [find_span(s, n, r) if s is not None and n is not None and r < 3 else None for s, n, r in zip(said, sought, rung, strict=True)]
        return pd.DataFrame([f or (None, None) for f in found], columns=["start", "stop"], dtype="Int32")

    return rows.withColumn("span", run("said", "sought", "rung"))


def _alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose quote is as similar as the threshold, with ``near(score, start, stop)``, the span in the source."""

    @F.pandas_udf("score double, start int, stop int")
    def run(said: pd.Series, sought: pd.Series) -> pd.DataFrame:
        out = []
        for s, n in zip(said, sought, strict=True):
            pieces = with_map(s or "")
            score, a, b = similarity(n or "", pieces[0])
            out.append((score, *(source_span(pieces, a, b) if b > a else (0, 0))))
        return pd.DataFrame(out, columns=["score", "start", "stop"])

    return pairs.withColumn("near", run("said", "sought")).where(F.col("near.score") >= threshold)


def _events(runs: DataFrame) -> DataFrame:
    return runs.select("trace_id", F.col("event_id").alias("found_id"), "pos", F.col("text").alias("said"))


def hits(needles: DataFrame, runs: DataFrame) -> DataFrame:
    """``needles`` with each event of their run that holds them: ``found_id, pos, said, rung`` (0 exact, 1 normalised, 2 canonical).

    ``needles(trace_id, needle, ..)``. A needle of three words or more meets only the events that have its
    longest inner word, one of fewer all of its run.
    """
    forms = needles.withColumns({"needle_n": quote_norm(F.col("needle")), "needle_c": canonical(F.col("needle"))})
    words = F.filter(F.split("needle_c", " "), lambda w: w != "")
    inner = F.when(F.size(words) > 2, F.array_max(F.transform(F.slice(words, F.lit(2), F.size(words) - 2), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"])
    keyed = forms.withColumn("key", inner)
    events = _events(runs)
    by_run = keyed.where("key is not null").groupBy("trace_id").agg(F.collect_set("key").alias("keys"))
    with_key = events.join(by_run, "trace_id").withColumn("key", F.explode(F.array_intersect("keys", F.split(canonical(F.col("said")), " "))))
    met = keyed.join(with_key.drop("keys"), ["trace_id", "key"]).drop("key").unionByName(keyed.where("key is null").drop("key").join(events, "trace_id"))
    norm = squeeze(unescape(F.col("said")))
    rung = F.when((F.col("needle") != "") & F.contains("said", F.col("needle")), 0).when((F.col("needle_n") != "") & F.contains(norm, F.col("needle_n")), 1).when((F.col("needle_c") != "") & F.contains(canonical(F.col("said")), F.col("needle_c")), 2)
    return met.withColumn("rung", rung).where("rung is not null")


def near_misses(quotes: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """Each quote's most similar event, if it reaches the threshold: ``trace_id, quote_id, found_id, pos, similarity, start, stop``.

    ``quotes(trace_id, quote_id, sought, anchor)`` with normalised ``sought``; of equals the anchor's event,
    then the first. Candidates share as many triples as the threshold demands, so none is lost; quotes too
    short for that meet all events of their run.
    """
    q = quotes.where("sought <> ''").withColumn("triples", triples("sought")).withColumn("need", least_shared(F.char_length("sought"), F.size("triples"), threshold))
    events = _events(runs).where("said is not null").join(q.select("trace_id").distinct(), "trace_id", "left_semi")
    said = events.select("trace_id", "found_id", triples(squeeze(unescape(F.col("said")))).alias("triples")).select("trace_id", "found_id", F.explode("triples").alias("triple"))
    asked = q.where("need > 0").select("trace_id", "quote_id", "need", F.explode("triples").alias("triple"))
    shared = asked.join(said, ["trace_id", "triple"]).groupBy("trace_id", "quote_id", "found_id", "need").agg(F.count("*").alias("n")).where("n >= need")
    pairs = shared.select("trace_id", "quote_id", "found_id").unionByName(q.where("need <= 0").select("trace_id", "quote_id").join(events.select("trace_id", "found_id"), "trace_id"))
    full = pairs.join(q.select("trace_id", "quote_id", "sought", "anchor"), ["trace_id", "quote_id"]).join(events, ["trace_id", "found_id"])
    scored = _alike(full, threshold)
    order = F.struct(-F.col("near.score"), (~F.col("found_id").eqNullSafe(F.col("anchor"))).alias("other"), "pos", "found_id")
    best = scored.groupBy("trace_id", "quote_id").agg(F.min_by(F.struct("found_id", "pos", "near"), order).alias("b"))
    return best.select("trace_id", "quote_id", "b.found_id", "b.pos", F.col("b.near.score").alias("similarity"), "b.near.start", "b.near.stop")


def place(quotes: DataFrame, runs: DataFrame, threshold: float | None = None) -> DataFrame:
    """Where each quote is: ``trace_id, quote_id, rung, event_id, start, stop, found, similarity, anchor, anchor_state``.

    ``quotes(trace_id, quote_id, anchor, quote)``, ``runs(trace_id, event_id, pos, text)``. Rungs are tried
    strictest first, each with the quote as it is and without its frame, the anchor's event first, then the
    events in order. ``start`` and ``stop`` are the span in the event's text as it is stored, and ``found``
    that slice. With a threshold, a quote found nowhere is ``similar`` to the event whose best window reaches
    it. Failing all, a quote whose anchor (given, else named by its frame) exists is ``anchored`` there, and
    others are ``unresolvable``. A null or blank quote is unresolvable; events without text hold nothing.
    """
    q = quotes.withColumn("frame", framed(F.coalesce("quote", F.lit("")))).withColumns({"inner": F.col("frame.content"), "anchor": F.coalesce("anchor", "frame.declared")})
    blank = F.coalesce(strip(F.col("quote")), F.lit("")) == ""
    needles = q.where(~blank).select("trace_id", "quote_id", "anchor", F.posexplode(F.array_distinct(F.array("quote", "inner"))).alias("form", "needle"))
    found = hits(needles, runs)
    sought = F.when(F.col("rung") == 0, F.col("needle")).when(F.col("rung") == 1, F.col("needle_n")).otherwise(F.col("needle_c"))
    order = F.struct("rung", "form", (~F.col("found_id").eqNullSafe(F.col("anchor"))).alias("other"), "pos", "found_id")
    best = found.groupBy("trace_id", "quote_id").agg(F.min_by(F.struct("rung", "found_id", "said", sought.alias("sought")), order).alias("b")).select("trace_id", "quote_id", "b.*")
    best = _spans(best).select("trace_id", "quote_id", "rung", "found_id", F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), F.lit(1.0).alias("similarity"))
    if threshold is not None:
        best = cut(best)  # read by what is left to search and by the result
        left = q.where(~blank).join(best.select("trace_id", "quote_id"), ["trace_id", "quote_id"], "left_anti").select("trace_id", "quote_id", "anchor", quote_norm(F.col("inner")).alias("sought"))
        near = near_misses(left, runs, threshold).select("trace_id", "quote_id", F.lit(3).alias("rung"), "found_id", "start", "stop", "similarity")
        best = best.unionByName(near)
    known = runs.select("trace_id", F.col("event_id").alias("anchor"), F.lit(True).alias("known")).distinct()
    out = q.select("trace_id", "quote_id", "anchor").join(best, ["trace_id", "quote_id"], "left").join(known, ["trace_id", "anchor"], "left")
    rung = F.coalesce("rung", F.when(F.col("known"), 4).otherwise(5))
    event = F.when(F.col("rung").isNotNull(), F.col("found_id")).when(F.col("known"), F.col("anchor"))
    state = F.when(F.col("anchor").isNull(), "not_declared").when(F.col("known").isNull(), "unknown_event").when(F.col("at_event").eqNullSafe(F.col("anchor")), "resolved").otherwise("elsewhere")
    out = out.select("trace_id", "quote_id", F.get(F.array(*map(F.lit, RUNGS)), rung).alias("rung"), event.alias("at_event"), "start", "stop", "similarity", "anchor", "known")
    said = _events(runs).select("trace_id", F.col("found_id").alias("at_event"), "said")
    slice_ = F.when(F.col("start").isNotNull(), F.substring(F.col("said"), F.col("start") + 1, F.col("stop") - F.col("start")))
    return out.join(said, ["trace_id", "at_event"], "left").select("trace_id", "quote_id", "rung", F.col("at_event").alias("event_id"), "start", "stop", slice_.alias("found"), "similarity", "anchor", state.alias("anchor_state"))
