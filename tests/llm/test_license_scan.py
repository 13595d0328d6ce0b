"""The license scan against every window of every text, and against literal places."""

import random
from fractions import Fraction

from tracelake.llm import license_scan as ls

from . import cases


def plain(text, phrases=ls.PHRASES, templates=ls.TEMPLATES, threshold=ls.THRESHOLD):
    w = cases.alnum(text)
    places = [(i, label) for phrase, label in phrases for m in [ls.words_of(phrase)] for i in range(len(w) - len(m) + 1) if w[i : i + len(m)] == m]
    found, best = {label for _, label in places}, 1.0 if places else 0.0
    for label, text in templates:
        need = set(ls.words_of(text))
        for at in range(0, max(len(w) - ls.BLOCK, 0) + ls.STEP, ls.STEP):
            share = Fraction(len(need & set(w[at : at + ls.BLOCK])), len(need))
            if share >= threshold:
                found.add(label)
                best = max(best, float(share))
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(found)), best


def scanned(df, **more):
    return sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in ls.scan(df, **more).collect()), key=repr)


def test_awkward_documents(spark):
    df = cases.documents(spark)
    assert scanned(df) == sorted(((r.doc_id, plain(r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
    assert ls.scan(df.limit(0)).collect() == []


def test_phrases_and_templates(spark):
    filler = lambda n, seed: " ".join(random.Random(seed).choices(["the", "of", "software", "and", "file", "word", "license"], k=n))
    texts = [
        "Released under the MIT License.", "UNDER-THE/mit*license under the mit license", "under the MIT Licenseé", "under the mit\x00license", "cc by ncx, CC BY NC", "This work is licensed under the GNU General Public License, version 3.",
        f"{filler(500, 1)} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files {filler(300, 2)}",
        "Permission is hereby granted free of charge to any individual obtaining copies of this software and associated documentation files", "apache license version 2 " * 40, filler(4000, 3),
        f"{filler(63, 4)} {ls.TEMPLATES[3][1]}", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    ]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, template int")
    got = dict(scanned(df))
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert got[0][:6] == (5, 1, 1, 1, "mit", "mit") and got[1][1] == 2 and got[2][1] == 0 and got[5][5:] == ("gpl-3", 1.0) and "mit" in got[6][5] and got[8][1] == 40


def test_random_sets_against_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    templates = tuple((f"t{i}", " ".join(rng.sample(words, rng.randrange(1, 20)))) for i in range(12))
    phrases = (("w1 w1", "twice"), ("w2 w3 w2", "around"))
    texts = [" ".join(rng.choices(words[: rng.randrange(1, 41)], k=rng.randrange(0, 200))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for t in (Fraction(1, 2), Fraction(9, 10), Fraction(1)):
        got = dict(scanned(df, phrases=phrases, templates=templates, threshold=t))
        assert got == {i: plain(x, phrases, templates, t) for i, x in enumerate(texts)}


def test_no_python_on_the_way(spark):
    plan = ls.scan(cases.documents(spark).select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
