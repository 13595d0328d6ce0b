"""Recovery and reruns: call pairing, compensation order, verifiers, branch comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Verifier, families it serves, mode prefixes it serves.
VERIFIERS = (
    ("json_schema_guard", ("action",), ("action.format_error", "action.parameter_error")),
    ("tool_retry_guard", ("system",), ("system.tool_execution_error",)),
    ("plan_progress_guard", ("planning",), ("planning.inefficient_plan",)),
)


def tool_pairs(runs: DataFrame) -> DataFrame:
    """A result pairs with the pending call of its agent: the latest call, not yet answered.

    Among an agent's calls and results in order, that is the row just before, if it is a call.
    """
    w = Window.partitionBy("trace_id", "agent_name").orderBy("pos")
    rows = runs.where(F.col("event_type").isin("tool.call", "tool.result"))
    rows = rows.select("trace_id", "agent_name", "event_type", "event_id", "pos", "error", F.lag("event_type").over(w).alias("before"), F.lag("event_id").over(w).alias("call_id"), F.lag("pos").over(w).alias("call_pos"), F.lag("payload").over(w).alias("call"))
    return rows.where("event_type = 'tool.result' and before = 'tool.call'").select("trace_id", "agent_name", "call_id", "call_pos", "call", F.col("event_id").alias("result_id"), F.col("pos").alias("result_pos"), "error")


def saga_order(pairs: DataFrame, compensable: tuple[str, ...]) -> DataFrame:
    """Calls of compensable tools whose result has no error, in the order they are to be undone: last result first."""
    w = Window.partitionBy("trace_id").orderBy(F.desc("result_pos"))
    undone = pairs.where(F.col("agent_name").isin(*compensable) & (F.coalesce("error", F.lit("")) == ""))
    return undone.select("trace_id", "call_id", "call", F.row_number().over(w).alias("undo"))


def served(found: DataFrame, specs=VERIFIERS) -> DataFrame:
    """Each finding with each verifier that serves its family or mode; the findings are read once."""
    names = []
    for name, families, prefixes in specs:
        fits = F.substring_index("mode_id", ".", 1).isin(*families)
        for p in prefixes:
            fits = fits | F.col("mode_id").startswith(p)
        names.append(F.when(fits, F.lit(name)))
    return found.withColumn("verifier", F.explode(F.array_compact(F.array(*names))))


def verifiers(found: DataFrame, specs=VERIFIERS) -> DataFrame:
    """Verifiers that serve a finding's family or mode, each once an event."""
    return served(found, specs).select("trace_id", "event_id", "verifier").distinct()


def compare_branches(before: DataFrame, after: DataFrame) -> DataFrame:
    """Errors per run in two branches, and whether the second is better."""
    count = lambda df, c: df.groupBy("trace_id").agg(F.count_if(F.coalesce("error", F.lit("")) != "").alias(c))
    both = count(before, "errors_before").join(count(after, "errors_after"), "trace_id")
    verdict = F.when(F.col("errors_after") < F.col("errors_before"), "improved").when(F.col("errors_after") > F.col("errors_before"), "worse").otherwise("unchanged")
    return both.withColumn("verdict", verdict)


def evaluate_suffix(runs: DataFrame, generated: DataFrame, checkpoint: int) -> DataFrame:
    """Problems from the checkpoint on in the original and in the generated continuation."""
    count = lambda df, c: df.where(F.col("pos") >= checkpoint).groupBy("trace_id").agg(F.count_if(F.coalesce("error", F.lit("")) != "").alias(c))
    both = count(runs, "original").join(count(generated, "rerun"), "trace_id", "left").withColumn("rerun", F.coalesce("rerun", F.lit(0)))
    result = F.when((F.col("original") > 0) & (F.col("rerun") == 0), "resolved").when(F.col("rerun") < F.col("original"), "improved").when(F.col("rerun") > F.col("original"), "worse").otherwise("unchanged")
    return both.withColumn("result", result)
