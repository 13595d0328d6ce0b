"""An unlabelled corpus keeps its documents, and no labelled language is left out of the model."""

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import language_id


def test_nothing_learned_drops_letterless_texts_only(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(["some text", "12 !", None, "", "\u0436"])], "doc_id long, text string, lang string")
    kept = language_id.keep_identified(docs, language_id.fit(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4]


def test_every_labelled_language_is_learned(spark):
    docs = spark.createDataFrame([(i, chr(0x4E00 + i // 4) * 3 + "ab" * (i // 4), f"l{i // 4:03}") for i in range(840)], "doc_id long, text string, lang string")
    assert language_id.fit(docs).languages == sorted({r.lang for r in docs.where(language_id.fold("doc_id", 5) != 0).select("lang").distinct().collect()})


def test_model_decides_what_stays_and_its_label(spark):
    """Text that no model codes well goes although it has letters, and a wrong label is replaced."""
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    rows = [(i, " ".join(word("abcde" if i % 2 else "uvwxy") for _ in range(40)), "ab" if i % 2 else "uv") for i in range(200)]
    noise = "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 300)))
    wrong = " ".join(word("abcde") for _ in range(40))
    docs = spark.createDataFrame([*rows, (1000, noise, "ab"), (1001, wrong, "uv"), (1002, wrong, None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 1000"))
    kept = {r.doc_id: r.lang for r in language_id.keep_identified(docs, model).collect()}
    assert 1000 not in kept and kept[1001] == kept[1002] == "ab" and len(kept) == 202


def test_few_rows_of_a_large_language_are_ranked(spark):
    """The hash bound leaves the same sample as ranking all rows."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('word', id) as text", "case when id % 20 = 0 then 'rare' else 'often' end as lang")
    known = docs.where(language_id.fold("doc_id", 5) != 0)
    model = language_id.fit(docs, sample=300)
    ids = [r.doc_id for lang in ("often", "rare") for r in known.where(f"lang = '{lang}'").orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()]
    want = language_id.fit(docs.where(F.col("doc_id").isin(ids)))
    text = [b"word17 word4411"]
    assert np.allclose(model.code_lengths(text), want.code_lengths(text))
