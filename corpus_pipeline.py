"""A corpus from raw documents to tokens, in stages that are written and read again.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontamination, language_id, ngram_join, substring_dedup
from tracelake.llm.common import Scratch, read, release, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, ``lang`` being the predicted one.

    Null and letterless texts go, and those that no learned language codes well; where no row has a
    language, texts with a letter stay as they are. Repeated rows and null ids are judged each; an
    empty table gives none.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id.

    Documents without words and rows of null id stay. Of rows that repeat both id and text one stays;
    rows that share an id are one document in the search, so all its texts go where one of them is a
    later near copy. An empty table gives none.
    """
    keep, own = Scratch(spark), Scratch(spark)
    found = ngram_join.jaccard_components(docs, scratch=own)
    known = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") != F.col("component_id")).alias("later"), (F.count("*") > 1).alias("repeated"))
    known = keep.table(known.where("later or repeated"), "pipeline-near")
    del found
    own.drop()
    release(spark)
    left = docs.join(known.where("later"), "doc_id", "left_anti")
    again = known.where("repeated and not later").select("doc_id")
    if again.isEmpty():
        return left.select(docs.columns)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 20 words or more that start earlier; n_chars follows the text.

    Null and short texts and rows of null id stay as they are; rows that repeat an id are one document,
    none of which is earlier than the other. An empty table gives none.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = substring_dedup.remove_earlier_passages(docs, with_text=True, carry=others)
    back = {c: F.col(f"c{i}") for i, c in enumerate(others)}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return out.select(*[(back[c] if c in back else F.col(c)).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window; of an id that repeats, all rows go if one holds one.

    Null texts and rows of null id stay; without benchmark items all do. An empty table gives none.
    """
    found = decontamination.contamination(docs, read(spark, sf_dir, "benchmark"))
    hit = table(found.where("contaminated and doc_id is not null").select("doc_id").distinct(), "pipeline-contaminated")
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row that is left, repeated or not; a null text has no tokens. An empty table gives none."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: Byte-level BPE can't be put in SQL; tests/llm holds run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; a stage's table goes once the next is written."""
    docs, held = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        fresh = Scratch(spark)
        docs = fresh.table(stage(spark, docs, sf_dir), f"stage-{name}")
        if held:
            held.drop()
        held = fresh
    return STAGES[-1][1](spark, docs, sf_dir)
