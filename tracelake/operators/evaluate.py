"""Predictions against reference labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def headline(pairs: DataFrame) -> DataFrame:
    """Of (h_tag, l_tag, h_step, l_step): exact tag, exact step, steps within 1, 2 and 3, both; rounded to 4 places."""
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    d = F.abs(F.col("h_step") - F.col("l_step"))
    same = F.col("h_tag") == F.col("l_tag")
    return pairs.agg(F.count("*").alias("n"), share(same).alias("tag_exact"), share(d == 0).alias("step_exact"), *[share(d <= k).alias(f"step_within_{k}") for k in (1, 2, 3)], share(same & (d == 0)).alias("both"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Dense label x label counts."""
    tags = pairs.select(F.col("h_tag").alias("t")).union(pairs.select("l_tag")).where("t is not null").distinct()
    grid = tags.select(F.col("t").alias("h_tag")).crossJoin(tags.select(F.col("t").alias("l_tag")))  # label values only
    return grid.join(pairs.groupBy("h_tag", "l_tag").agg(F.count("*").alias("n")), ["h_tag", "l_tag"], "left").select("h_tag", "l_tag", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """Per tag; a division by nothing is 0."""
    rows = pairs.select(F.col("h_tag").alias("tag"), F.lit(1).alias("h"), F.lit(0).alias("l"), F.when(F.col("h_tag") == F.col("l_tag"), 1).otherwise(0).alias("ok"))
    rows = rows.unionByName(pairs.select(F.col("l_tag").alias("tag"), F.lit(0).alias("h"), F.lit(1).alias("l"), F.lit(0).alias("ok")))
    by = rows.groupBy("tag").agg(F.sum("h").alias("support"), F.sum("l").alias("predicted"), F.sum("ok").alias("correct"))
    p = F.coalesce(F.try_divide("correct", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("correct", "support"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return by.select("tag", "support", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def step_errors(pairs: DataFrame) -> DataFrame:
    d = F.col("l_step") - F.col("h_step")
    return pairs.agg(F.round(F.avg(F.abs(d)), 4).alias("mae"), F.round(F.avg(d), 4).alias("mean_error"), F.count_if(d < 0).alias("early"), F.count_if(d == 0).alias("exact"), F.count_if(d > 0).alias("late"))


def per_annotator(pairs: DataFrame, annotator: str) -> DataFrame:
    return pairs.groupBy(annotator).agg(F.count("*").alias("n"), F.round(F.avg((F.col("h_tag") == F.col("l_tag")).cast("double")), 4).alias("tag_exact"))


def _joint(pairs: DataFrame) -> DataFrame:
    """Joint and marginal counts of two label columns, null pairs dropped."""
    joint = pairs.where("h_tag is not null and l_tag is not null").groupBy("h_tag", "l_tag").agg(F.count("*").alias("n"))
    return joint.select("h_tag", "l_tag", "n", F.sum("n").over(Window.partitionBy("h_tag")).alias("h"), F.sum("n").over(Window.partitionBy("l_tag")).alias("l"), F.sum("n").over(Window.partitionBy()).alias("all"))  # label values only


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa; null without pairs or where chance agreement is whole."""
    j = _joint(pairs)
    agree = j.agg(F.sum(F.when(F.col("h_tag") == F.col("l_tag"), F.col("n") / F.col("all")).otherwise(0.0)).alias("po"))
    h = j.select("h_tag", (F.col("h") / F.col("all")).alias("ph")).distinct()
    l_ = j.select("l_tag", (F.col("l") / F.col("all")).alias("pl")).distinct()
    chance = h.join(l_, h["h_tag"] == l_["l_tag"]).agg(F.coalesce(F.sum(F.col("ph") * F.col("pl")), F.lit(0.0)).alias("pe"))
    return agree.crossJoin(chance).select(F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def nmi(pairs: DataFrame) -> DataFrame:
    """Mutual information over the geometric mean of the entropies; 0 where one is 0."""
    j = _joint(pairs)
    p = lambda c: F.col(c) / F.col("all")
    mi = j.agg(F.sum(p("n") * F.ln(p("n") / (p("h") * p("l")))).alias("mi"))
    entropy = lambda tag, c: j.select(tag, p(c).alias("q")).distinct().agg((-F.sum(F.col("q") * F.ln("q"))).alias(f"e_{c}"))
    out = mi.crossJoin(entropy("h_tag", "h")).crossJoin(entropy("l_tag", "l"))
    return out.select(F.round(F.coalesce(F.try_divide("mi", F.sqrt(F.col("e_h") * F.col("e_l"))), F.lit(0.0)), 6).alias("nmi"))
