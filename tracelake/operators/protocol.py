"""Checks of native tool calling: the wire's own rules, and the wire against what was executed.

A wire row is ``(trace_id, idx, role, is_list, ids, names, args, tool_call_id)``: ``ids``, ``names`` and
``args`` (canonical JSON) of an assistant's calls, null where it makes none; ``is_list`` is false where
``tool_calls`` is there but no list, or an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FALLBACK = "text_protocol_fallback"


def _reasons(rows: DataFrame, *named: tuple[str, Column]) -> DataFrame:
    """A row per reason that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named]))
    return rows.select("trace_id", "idx", F.explode(found).alias("reason"))


def _turns(wire: DataFrame) -> DataFrame:
    """Non-tool messages with the ids of the tool messages right after them."""
    block = F.sum((F.col("role") != "tool").cast("int")).over(Window.partitionBy("trace_id").orderBy("idx"))
    rows = wire.withColumn("block", block)
    tools = rows.where("role = 'tool'").groupBy("trace_id", "block").agg(F.array_sort(F.collect_list(F.coalesce("tool_call_id", F.lit("")))).alias("answers"))
    heads = rows.where("role <> 'tool' and role = 'assistant' and is_list is not null")
    return heads.join(tools, ["trace_id", "block"], "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))


def message_violations(wire: DataFrame) -> DataFrame:
    """``(trace_id, idx, reason)``: ids missing or repeated, calls not answered exactly once, tool messages that answer nothing."""
    turns = _turns(wire)
    missing = F.exists("ids", lambda x: x.isNull() | (x == ""))
    checked = F.col("is_list") & ~missing
    own = _reasons(turns, ("tool_calls_not_list", ~F.col("is_list")), ("call_id_missing", F.col("is_list") & missing), ("call_ids_not_unique", checked & (F.size(F.array_distinct("ids")) < F.size("ids"))), ("calls_not_answered_once", checked & (F.array_sort("ids") != F.col("answers"))))
    block = F.sum((F.col("role") != "tool").cast("int")).over(Window.partitionBy("trace_id").orderBy("idx"))
    tools = wire.withColumn("block", block).where("role = 'tool'").select("trace_id", "idx", "block")
    orphans = tools.join(turns.where("is_list").select("trace_id", "block"), ["trace_id", "block"], "left_anti")
    return own.unionByName(orphans.select("trace_id", "idx", F.lit("orphan_tool_message").alias("reason")))


def execution_violations(wire: DataFrame, events: DataFrame) -> DataFrame:
    """The same for each checkable turn against ``events(trace_id, event_type, pointer, step_index, call_id, tool, args, error)``.

    A turn has exactly one agent step or error pointing at it; a turn of several calls is refused and runs nothing;
    a single call runs once, with one result, under the same id, name and arguments.
    """
    missing = F.exists("ids", lambda x: x.isNull() | (x == ""))
    turns = _turns(wire).where("is_list").where(~missing).select("trace_id", "idx", "ids", "names", "args")
    pointing = events.where(F.col("event_type").isin("agent.step", "error") & F.col("pointer").isNotNull()).groupBy("trace_id", F.col("pointer").alias("idx")).agg(F.count("*").alias("n_turn"), F.first("event_type").alias("turn_type"), F.first("step_index").alias("turn_step"), F.first("error").alias("turn_error"))
    call, result = F.col("event_type") == "tool.call", F.col("event_type") == "tool.result"
    ran = events.where((call | result) & F.col("step_index").isNotNull()).groupBy("trace_id", F.col("step_index").alias("turn_step")).agg(F.count_if(call).alias("n_call"), F.count_if(result).alias("n_result"), *[F.first(F.when(call, F.col(c)), ignorenulls=True).alias(f"ran_{c}") for c in ("call_id", "tool", "args")], F.first(F.when(result, F.col("tool")), ignorenulls=True).alias("result_tool"))
    rows = turns.join(pointing, ["trace_id", "idx"], "left").join(ran, ["trace_id", "turn_step"], "left")
    n_call, n_result = F.coalesce("n_call", F.lit(0)), F.coalesce("n_result", F.lit(0))
    one = F.coalesce(F.col("n_turn") == 1, F.lit(False))
    many = one & (F.size("ids") > 1)
    refused = (F.col("turn_type") == "error") & F.startswith("turn_error", F.lit("multiple_tool_calls:"))
    single = one & (F.size("ids") == 1)
    run = single & (F.col("turn_type") != "error")
    pair = run & (n_call == 1) & (n_result == 1)
    name = F.col("names")[0]
    return _reasons(
        rows, ("no_unique_turn_pointer", ~one), ("multi_call_not_rejected", many & ~F.coalesce(refused, F.lit(False))), ("rejected_call_executed", ((many & refused) | (single & (F.col("turn_type") == "error"))) & (n_call + n_result > 0)), ("no_unique_execution_pair", run & ((n_call != 1) | (n_result != 1))),
        ("call_id_disagrees", pair & ~F.col("ran_call_id").eqNullSafe(F.col("ids")[0])), ("function_name_missing", pair & (F.coalesce(name, F.lit("")) == "")), ("call_name_disagrees", pair & (F.coalesce(name, F.lit("")) != "") & ~F.col("ran_tool").eqNullSafe(name)), ("args_not_object", pair & ~F.coalesce(F.startswith(F.col("args")[0], F.lit("{")), F.lit(False))),
        ("call_args_disagree", pair & F.startswith(F.col("args")[0], F.lit("{")) & ~F.col("ran_args").eqNullSafe(F.col("args")[0])), ("result_name_disagrees", pair & ~F.col("result_tool").eqNullSafe(F.col("ran_tool"))),
    )


def event_violations(wire: DataFrame, events: DataFrame) -> DataFrame:
    """Executed calls whose id no turn issued, and calls without an id in a step that declares no fallback."""
    calls = events.where("event_type = 'tool.call'").withColumn("idx", F.col("step_index"))
    issued = wire.where("is_list").select("trace_id", F.explode("ids").alias("call_id")).distinct()
    named = calls.where("coalesce(call_id, '') <> ''").join(issued, ["trace_id", "call_id"], "left_anti").select("trace_id", "idx", F.lit("call_id_without_envelope").alias("reason"))
    declared = events.where((F.col("event_type") == "agent.step") & (F.col("envelope") == FALLBACK)).select("trace_id", "step_index").distinct()
    bare = calls.where("coalesce(call_id, '') = ''").join(declared, ["trace_id", "step_index"], "left_anti").select("trace_id", "idx", F.lit("call_without_id_or_fallback").alias("reason"))
    return named.unionByName(bare)
