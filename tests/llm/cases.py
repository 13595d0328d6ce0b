"""Awkward documents, and brute-force versions of the contracts."""

from __future__ import annotations

import hashlib
import re

LONG = " ".join(f"long{i % 997}x{i % 7}" for i in range(30_000))
BASE = " ".join(f"w{i}" for i in range(60))
NEAR = BASE.replace("w30", "other").replace("w31 ", "")
PASSAGE = " ".join(f"Passage{i}" for i in range(35))
#: Columns named like ones that the operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, c int, h string, x int, size string, spans int, copy string, key int, row string, part int, i int"


def documents(spark):
    texts = [
        (0, BASE, "en"), (1, BASE, "en"), (2, NEAR, "en"), (3, None, "en"), (4, "", None), (5, " \t\r\n\x0b ", "en"), (6, "one", "fr"), (7, "ONE", "fr"), (8, LONG, "en"),
        (9, f"intro words here {PASSAGE} and an end", "en"), (10, f"{PASSAGE} another tail {PASSAGE}", "de"), (11, "a b c d", "de"), (12, "A b C d", "de"), (13, "12 34 !! ??", "en"),
        (14, "été 日本語 \U0001f600 don't  stop now", "fr"), (15, " ".join(["same"] * 50), "en"), (16, "x" * 3000, "en"), (17, "tab\there\x00nul\x1funit", "en"), (11, "a b c d", "de"), (None, "no id at all", "en"), (None, None, None),
        (18, LONG, "en"),
    ]
    rows = [(d, t, lang, None if d == 6 else f"s{(d or 0) % 3}", len(t or ""), 1, "h", 2, "z", 3, None, 4, "r", 5, 6) for d, t, lang in texts]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


def spaced(text, lower=False):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(rows, n=5):
    sets = {}
    for d, t in rows:
        w = spaced(t, True)
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}


def without_earlier(rows, window=20):
    """{id: (n_words, kept words)} for rows of distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = spaced(t)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                keep[i : i + window] = [False] * window
            seen.add(key)
        out[d] = (len(w), [x for x, k in zip(w, keep, strict=True) if k])
    return out


def contamination(rows, items, span=10):
    windows = {}
    for i, t in items:
        w = alnum(t)
        m = min(span, len(w))
        for a in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + m]), set()).add(i)
    out = {}
    for d, t in rows:
        w, hit, found = alnum(t), set(), set()
        for m in {len(k) for k in windows}:
            for a in range(len(w) - m + 1):
                if ids := windows.get(tuple(w[a : a + m])):
                    found |= ids
                    hit |= set(range(a, a + m))
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out
