"""Labels of people and models: selection, pairing, projection through a mapping, taxonomy observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trace as X
from . import evaluate

FAMILIES = ("memory", "reflection", "planning", "action", "system", "verification", "multiagent", "multimodal")
POLICIES = ("final_decision", "final_or_single", "first_human")


def valid(label: Column) -> Column:
    """A label with a step and a tag."""
    return F.coalesce(label["step"].isNotNull() & (X.tag_of(label["tag"]) != ""), F.lit(False))


def select_human(rows: DataFrame, policy: str) -> DataFrame:
    """``(task_id, final, humans)`` to the label that the policy takes; tasks without one go."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    good = F.filter("humans", valid)
    final = F.when(valid(F.col("final")), F.col("final"))
    chosen = {"final_decision": final, "final_or_single": F.coalesce(final, F.when(F.size(good) == 1, good[0])), "first_human": F.get(good, F.lit(0))}[policy]
    return rows.withColumn("chosen", chosen).where("chosen is not null").select("task_id", X.tag_of(F.col("chosen.tag")).alias("h_tag"), F.col("chosen.step").alias("h_step"), F.col("chosen.annotator").alias("annotator"))


def load_pairs(found: DataFrame, human: DataFrame) -> DataFrame:
    """Tasks that both sides have."""
    return found.join(human, "task_id")


def pair_counts(found: DataFrame, human: DataFrame) -> DataFrame:
    """How many tasks are paired and how many of the model's are skipped."""
    both = found.select("task_id").distinct().join(human.select("task_id", F.lit(True).alias("known")).distinct(), "task_id", "left")
    return both.agg(F.count("known").alias("common"), F.count_if(F.col("known").isNull()).alias("skipped"))


def project(found: DataFrame, mapping: DataFrame, human: DataFrame) -> DataFrame:
    """Predictions under the human taxonomy; tags that map to nothing and tasks without a human label go."""
    return found.join(mapping.where("target <> 'NONE'"), "tag").join(human, "task_id").select("task_id", F.col("target").alias("l_tag"), F.col("step").alias("l_step"), "h_tag", "h_step")


def coverage_purity(found: DataFrame, mapping: DataFrame, human: DataFrame) -> DataFrame:
    """Share of used human tags that some code maps to, and share of codes that map to anything."""
    used = found.where("coalesce(tag, '') <> ''").join(human, "task_id").select(F.col("h_tag").alias("target")).distinct()
    hit = used.join(mapping.where("target <> 'NONE'").select("target", F.lit(True).alias("hit")).distinct(), "target", "left")
    cover = hit.agg(F.round(F.coalesce(F.try_divide(F.count("hit"), F.count("*")), F.lit(0.0)), 4).alias("coverage"))
    pure = mapping.agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("target") != "NONE"), F.count("*")), F.lit(0.0)), 4).alias("purity"))
    return cover.crossJoin(pure)  # a row each


def by_category(pairs: DataFrame) -> DataFrame:
    """The same pairs with tags replaced by their categories."""
    return pairs.withColumns({"h_tag": X.category_of(F.col("h_tag")), "l_tag": X.category_of(F.col("l_tag"))})


def step_bias(pairs: DataFrame) -> DataFrame:
    """Step errors with the side they lean to."""
    return evaluate.step_errors(pairs).withColumn("bias", F.when(F.col("mean_error") < 0, "early").when(F.col("mean_error") > 0, "late").otherwise("neutral"))


def examples(found: DataFrame, k: int = 3) -> DataFrame:
    """The most confident findings of each tag."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("confidence"), "task_id"))).where(F.col("rank") <= k).select("tag", "task_id", "rank")


def observations(findings: DataFrame, seeds: list[str], least: float = 0.4) -> DataFrame:
    """Findings worth a new look: of a mode that isn't known, or of low confidence."""
    unknown = ~F.col("mode_id").isin(*seeds)
    low = F.coalesce(F.col("confidence") < least, F.lit(False))
    family = F.substring_index("mode_id", ".", 1)
    return findings.where(unknown | low).select("trace_id", "finding_id", "mode_id", F.when(family.isin(*FAMILIES), family).alias("family"), F.when(unknown, "unknown_mode").otherwise("low_confidence").alias("source"), "ordinal", "text")


def label_clusters(observed: DataFrame) -> DataFrame:
    """Observations by the slug of their suggested name: ``cluster, support, family`` (the most frequent one, the first seen on ties)."""
    named = observed.withColumn("cluster", X.slug(F.col("mode_id"), 4))
    size = named.groupBy("cluster").agg(F.count("*").alias("support"))
    votes = named.where("family is not null").groupBy("cluster", "family").agg(F.count("*").alias("n"), F.min(F.struct("trace_id", "ordinal")).alias("seen"))
    top = votes.groupBy("cluster").agg(F.min_by("family", F.struct(-F.col("n"), F.col("seen"))).alias("family"))
    return size.join(top, "cluster", "left").select("cluster", "support", F.coalesce("family", F.lit("planning")).alias("family"))


def cluster_terms(observed: DataFrame, k: int = 5) -> DataFrame:
    """The terms of most observations in each cluster, ties by name."""
    named = observed.select(X.slug(F.col("mode_id"), 4).alias("cluster"), F.explode(X.tokens(F.col("text"))).alias("term"))
    counts = named.groupBy("cluster", "term").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)


def cluster_order(clusters: DataFrame, support: int = 2, most: int = 12) -> DataFrame:
    """The largest clusters first; the report has twelve at most."""
    return clusters.where(F.col("support") >= support).orderBy(F.desc("support"), "cluster").limit(most)


def nearest_seed(proposals: DataFrame, seeds: DataFrame, least: float = 0.6) -> DataFrame:
    """Each proposal's most similar seed by word overlap (a little more in its own family), and whether that makes it a duplicate. The seeds are the taxonomy's fixed list."""
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect("words", "seed_words")), F.size(F.array_union("words", "seed_words"))), F.lit(0.0))
    rows = proposals.crossJoin(F.broadcast(seeds)).select("proposal", "seed", (overlap + F.when(F.col("family") == F.col("seed_family"), 0.05).otherwise(0.0)).alias("s"))
    best = rows.groupBy("proposal").agg(F.max_by(F.struct("seed", "s"), F.struct(F.col("s"), F.col("seed"))).alias("b"))
    return best.select("proposal", "b.seed", F.round("b.s", 6).alias("similarity"), (F.col("b.s") >= least).alias("duplicate"))


def seeded_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed order for a seed, by hash."""
    return rows.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))


def fold_taxonomy(ops: DataFrame) -> DataFrame:
    """``(run, ord, op, code, args)`` folded in order to each run's codes that remain.

    append adds ``code``; split replaces it by ``args``; merge replaces ``args`` by ``code``; reuse and rename need it.
    An operation on a code that isn't there (or an append of one that is) makes the run's result ``null``.
    One run's operations are a short ordered list, folded inside one expression.
    """
    op = F.struct("ord", "op", "code", "args")
    by = ops.groupBy("run").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    known = lambda s, o: F.array_contains(s, o["code"])

    def step(s: Column, o: Column) -> Column:
        one = F.array(o["code"])
        added = F.when(~known(s, o), F.concat(s, one))
        split = F.when(known(s, o), F.concat(F.array_except(s, one), o["args"]))
        merged = F.when(F.size(F.array_except(o["args"], s)) == 0, F.concat(F.array_except(s, o["args"]), one))
        return F.when(o["op"] == "append", added).when(o["op"] == "split", split).when(o["op"] == "merge", merged).when(known(s, o), s)

    return by.select("run", F.array_sort(F.reduce("ops", F.array().cast("array<string>"), step)).alias("codes"))
