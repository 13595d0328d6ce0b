"""Lessons: scores, choice with fallback, retrieval, merging of buckets, soft tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import neighbours

# Categories, and what an action or an application adds to their weights (1 each).
CATEGORIES = ("Perception", "Grounding & Interaction", "Task Reasoning & Control", "External / System")
ACTION_WEIGHTS = (("click", 1, 2.5), ("click", 0, 1.5), ("double_click", 1, 2.5), ("double_click", 0, 1.0), ("right_click", 1, 2.0), ("right_click", 0, 0.8), ("drag", 1, 3.0), ("drag", 0, 0.5), ("type", 2, 2.5), ("key", 2, 2.0))
APP_WEIGHTS = (("firefox", 1, 1.0), ("firefox", 0, 0.5), ("libreoffice", 2, 1.5), ("terminal", 2, 1.5), ("bash", 2, 1.5), ("gimp", 0, 1.5), ("gimp", 1, 1.0), ("vscode", 2, 1.0), ("nautilus", 1, 1.0), ("gedit", 2, 0.5))


def composite_score(age_days: Column, refs: Column, confusions: Column, half: float = 30.0) -> Column:
    """Recency, coverage and informativeness; a null age counts as no recency."""
    recency = F.coalesce(F.exp(-F.greatest(F.lit(0.0), age_days) / half), F.lit(0.0))
    return 0.4 * recency + 0.4 * F.log1p(refs) + 0.2 * (1 + 0.25 * confusions)


def pick(lessons: DataFrame, asks: DataFrame) -> DataFrame:
    """For each ``(tag, app)`` asked for, the best lesson of the application, else the best of the tag, else none."""
    best = lambda *keys: lessons.groupBy(*keys).agg(F.max(F.struct("score", "created", "id"))["id"].alias("id"))
    own = best("tag", "app").withColumnRenamed("id", "own")
    every = best("tag").withColumnRenamed("id", "every")
    return asks.join(own, ["tag", "app"], "left").join(every, "tag", "left").select("tag", "app", F.coalesce("own", "every").alias("id"))


def ranked(lessons: DataFrame, excluded: DataFrame, key: str, k: int) -> DataFrame:
    """The k best lessons of each key without excluded ids, with how many of how many are shown."""
    left = lessons.join(excluded, "id", "left_anti")
    w = Window.partitionBy(key)
    rows = left.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), F.desc("created"), "id")), "of": F.count("*").over(w)})
    return rows.where(F.col("rank") <= k).select(key, "id", "rank", F.concat(F.least(F.lit(k), F.col("of").cast("int")).cast("string"), F.lit(" of "), F.col("of").cast("string")).alias("coverage"))


def retrieve(queries: DataFrame, lessons: DataFrame, k: int, least: float) -> DataFrame:
    """The k nearest lessons of each query at ``least`` or more; queries meet all lessons of their bucket, in blocks."""
    return neighbours(queries, lessons, "bucket", k, least).select(F.col("a").alias("query"), F.col("b").alias("id"), F.col("cosine").alias("score"), "rank")


def strong_matches(pairs: DataFrame, cosine_gate: float = 0.85, jaccard_gate: float = 0.45) -> DataFrame:
    """Neighbours that pass both gates."""
    return pairs.where((F.col("cosine") >= cosine_gate) & (F.col("jaccard") >= jaccard_gate))


def merged(lessons: DataFrame, *keys: str) -> DataFrame:
    """One lesson per bucket: sorted unions of references and confusions (never its own tag), the failed action of most support (the shortest, then the first by name), the newest correction."""
    counted = lessons.where("coalesce(failed_action, '') <> ''").groupBy(*keys, "failed_action").agg(F.count("*").alias("n"))
    failed = counted.groupBy(*keys).agg(F.min_by("failed_action", F.struct(-F.col("n"), F.char_length("failed_action"), F.col("failed_action"))).alias("failed_action"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    fields = lessons.groupBy(*keys).agg(F.count("*").alias("n"), union("refs").alias("refs"), union("confusions").alias("confusions"), F.max_by("corrected_action", F.struct("created", "id")).alias("corrected_action"))
    out = fields.join(failed, list(keys), "left")
    return out.withColumn("confusions", F.array_remove("confusions", F.col(keys[0])))


def soft_tags(steps: DataFrame) -> DataFrame:
    """Probabilities of the categories from action, application and visual change: ``step_id, category, p, rank``."""
    w = [F.lit(1.0)] * len(CATEGORIES)
    action, app = F.lower(F.trim("action")), F.lower(F.trim("app"))
    for value, place, weight in ACTION_WEIGHTS:
        w[place] = w[place] + F.when(action == value, weight).otherwise(0.0)
    for value, place, weight in APP_WEIGHTS:
        w[place] = w[place] + F.when(app == value, weight).otherwise(0.0)
    d = F.col("delta")
    w[2] = w[2] + F.when(d <= 0.02, 2.5).otherwise(0.0)
    w[3] = w[3] + F.when(d >= 0.4, 2.0).otherwise(0.0)
    w[1] = w[1] + F.when(d >= 0.4, 0.5).when(d > 0.02, 0.3).otherwise(0.0)
    total = w[0] + w[1] + w[2] + w[3]
    rows = steps.select("step_id", F.posexplode(F.array(*[F.struct(F.lit(c).alias("category"), (x / total).alias("p")) for c, x in zip(CATEGORIES, w, strict=True)])).alias("place", "t"))
    return rows.select("step_id", "t.category", F.round("t.p", 9).alias("p"), F.row_number().over(Window.partitionBy("step_id").orderBy(F.desc("t.p"), "place")).alias("rank"))


def episode_lookup(lessons: DataFrame, episodes: DataFrame) -> DataFrame:
    """A lesson's references to episodes, also those that lead nowhere."""
    return lessons.select("id", F.explode("refs").alias("ref")).join(episodes.select(F.col("episode_id").alias("ref"), "title"), "ref", "left")


def search_memory(queries: DataFrame, memory: DataFrame, k: int, newest: int = 200) -> DataFrame:
    """The k best of the newest memories for each query by word overlap; no overlap is no match. The newest are a bounded list, so they are what is broadcast."""
    recent = memory.orderBy(F.desc("created"), F.desc("id")).limit(newest)
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect("q", "words")), F.size(F.array_union("q", "words"))), F.lit(0.0))
    rows = queries.select(F.col("id").alias("query"), F.col("words").alias("q")).crossJoin(F.broadcast(recent.select("id", "words"))).where("query <> id").select("query", "id", overlap.alias("score")).where("score > 0")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def matching(records: DataFrame, **equal: object) -> DataFrame:
    """The records whose named columns have the given values (None: that have none); all without any."""
    for name, value in equal.items():
        records = records.where(F.col(name).eqNullSafe(F.lit(value)))
    return records
