"""Folders of runs on a screen: a log of steps, screenshots beside it, a result and a task description.

A run is a folder with ``traj.jsonl`` (actions are objects) or ``trajectory.jsonl`` (actions are text); with both, the
first counts. All runs below a folder are read in one scan, and a run's lines stay lines.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import screens
from . import folders

#: The two layouts and their logs, sections of a text step in order, keys and phrases that tell a task.
LOGS = {"traj.jsonl": "claude", "trajectory.jsonl": "legacy"}
SECTIONS = (("Full plan", "full_plan"), ("Executor plan", "executor_plan"), ("Plan thoughts", "plan_thoughts"), ("Planned action", "plan_code"), ("Reflection", "reflection"), ("Reflection thoughts", "reflection_thoughts"))
TASK_KEYS = ("instruction", "task_instruction", "goal", "objective")
TASK_PHRASES = (r"\bThe user wants me to\s+", r"\b(?:The )?user (?:asked|wants) (?:me )?to\s+", r"\bI(?:'ll| will) help you\s+")


class Tables(NamedTuple):
    """``lines(run, name, line, value)``, ``configs(run, value)``, ``results(run, value)``, ``images(path)``."""

    lines: DataFrame
    configs: DataFrame
    results: DataFrame
    images: DataFrame


def _folder(path: str | Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _name(path: str | Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read(spark: SparkSession, folder: str) -> Tables:
    """The tables of all runs below a folder. Only screenshots' paths are listed, no image is read."""
    lines = folders.numbered_lines(spark, folder, "{traj,trajectory}.jsonl").select(_folder("file").alias("run"), _name("file").alias("name"), "line", "value")
    described = folders.whole_files(spark, folder, "*.json").where(_name("file") == F.concat(_name(_folder("file")), F.lit(".json")))
    results = folders.whole_files(spark, folder, "result.txt")
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,webp}").load(folder).select(F.col("_metadata.file_path").alias("path"))
    return Tables(lines, *(t.select(_folder("file").alias("run"), "value") for t in (described, results)), images)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("record", f"$.{path}", kind)


def _json(path: str) -> Column:
    value = _get(path, "variant")
    return F.when(F.schema_of_variant(value) != "VOID", F.to_json(value))


def _text(path: str) -> Column:
    """A value as text: strings without the blanks around them, other values as JSON, nothing and JSON's null as empty text."""
    return F.coalesce(_strip(_get(path)), _json(path), F.lit(""))


def _records(t: Tables) -> DataFrame:
    """``(run, format, line, record)`` of the log that counts; lines that aren't objects are left out."""
    first = F.min("name").over(Window.partitionBy("run"))  # traj.jsonl is before trajectory.jsonl
    record = F.try_parse_json("value")
    rows = t.lines.where(F.col("name").isin(*LOGS)).withColumn("first", first).where("name = first").withColumn("record", record)
    form = F.coalesce(*[F.when(F.col("name") == n, F.lit(f)) for n, f in LOGS.items()])
    return rows.where(F.schema_of_variant("record").startswith("OBJECT")).select("run", form.alias("format"), "line", "record")


def _is_error() -> Column:
    return _get("Error", "variant").isNotNull() & _get("step_num", "variant").isNull()


def _from_phrases(text: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(text, r"\[[A-Z_]+\]\s*", " "), r"(?U)\s+", " ")
    return F.coalesce(*[F.nullif(F.regexp_extract(F.trim(squeezed), rf"(?i){p}(.+?)(?:[.!?](?:\s|$)|$)", 1), F.lit("")) for p in TASK_PHRASES])


def _inferred() -> Column:
    """What a record says of its task: by a key, by a key of its info, by a phrase of its model's texts."""
    keys = [F.nullif(_text(p + k), F.lit("")) for p in ("", "info.") for k in TASK_KEYS]
    phrases = [_from_phrases(_text(k)) for k in ("action.raw_response", "response", "full_plan", "reflection")]
    return F.nullif(screens.instruction(F.coalesce(*keys, *phrases)), F.lit(""))


def runs(t: Tables) -> DataFrame:
    """A row per run: its task, instruction, layout, result, whether it can't be done, and status as :func:`screens.run_status` gives it.

    The instruction is the description's, else the first one inferred from a record. A description counts for
    text logs, or where it names the task; a result that is no number, and missing files, give nulls.
    """
    rows = _records(t)
    known = t.lines.where(F.col("name").isin(*LOGS)).groupBy("run").agg(F.min("name").alias("name"))
    form = F.coalesce(*[F.when(F.col("name") == n, F.lit(f)) for n, f in LOGS.items()])
    said = rows.withColumn("task", _inferred()).where("task is not null").groupBy("run").agg(F.min_by("task", "line").alias("inferred"))
    c = F.try_parse_json("value")
    of = lambda k: F.try_variant_get(c, f"$.{k}", "string")
    described = t.configs.groupBy("run").agg(F.min("value").alias("value")).select("run", F.nullif(of("instruction"), F.lit("")).alias("described"), of("id").alias("id"), of("evaluator.func").alias("evaluator"))
    scored = t.results.groupBy("run").agg(F.min(_strip(F.col("value")).try_cast("double")).alias("score"))
    status = screens.run_status(rows.select("run", "line", "record"))
    task = F.coalesce("id", _name("run"))
    return known.join(said, "run", "left").join(described, "run", "left").join(scored, "run", "left").join(status, "run", "left").select(
        "run", F.concat(F.lit("osworld_"), task).alias("trace_id"), task.alias("task_id"), F.coalesce("described", "inferred").alias("goal"), form.alias("format"), "score", F.coalesce("evaluator", F.lit("")).alias("evaluator"),
        F.coalesce(F.col("evaluator") == "infeasible", F.lit(False)).alias("is_infeasible"), F.coalesce("status", F.lit("failure")).alias("status"), F.coalesce("terminal_step", F.lit(-1)).alias("terminal_step"), F.coalesce("error", F.lit("empty trajectory")).alias("error"),
    )


def _reasoning() -> Column:
    """A text step's reasoning: sections under their labels, each text once."""
    response = F.struct(F.lit("Model response").alias("label"), _strip(F.regexp_replace(_text("response"), "(?s)<tool_call>.*?</tool_call>", "")).alias("text"))
    sections = F.array(response, *[F.struct(F.lit(label).alias("label"), _text(key).alias("text")) for label, key in SECTIONS])
    texts = F.transform(sections, lambda s: s["text"])
    kept = F.filter(sections, lambda s, i: (s["text"] != "") & (F.array_position(texts, s["text"]) == i + 1))
    return F.array_join(F.transform(kept, lambda s: F.concat(s["label"], F.lit(":\n"), s["text"])), "\n\n")


def events(t: Tables) -> DataFrame:
    """An event per step, in order of its number (then of its line): ``run, trace_id, pos, event_id, event_type, step_index, reasoning, tool_use, output, error, reward, done, action_type, screenshot``.

    The action is the output and what was thought the reasoning; a record without a number is step 0, one that
    is a system error is no step. A screenshot is null unless its file is there.
    """
    rows = _records(t).where(~_is_error())
    acts = F.coalesce((F.col("format") == "claude") & F.schema_of_variant(_get("action", "variant")).startswith("OBJECT"), F.lit(False))
    kind = F.when(acts, F.coalesce(_get("action.action_type"), F.lit("tool_use"))).otherwise("code")
    code = F.when(acts, F.coalesce(F.nullif(_get("action.command"), F.lit("")), kind)).otherwise(F.coalesce(_get("action"), _json("action"), F.lit("")))
    raw = F.coalesce(F.nullif(_text("action.raw_response"), F.lit("")), _text("response"))
    tool = r"(?s)\[TOOL_USE\]\s*(.*?)(?=\[THINKING\]|\[TEXT\]|\[OTHER\]|\z)"
    tagged = F.array_join(F.filter(F.transform(F.regexp_extract_all(raw, F.lit(tool), F.lit(1)), lambda x: _strip(x)), lambda x: x != ""), "\n\n")
    object_ = F.coalesce(F.schema_of_variant(_get("action", "variant")).startswith("OBJECT"), F.lit(False))
    step = F.coalesce(_get("step_num", "int"), F.lit(0))
    shot = F.when(F.col("format") == "claude", F.nullif(_get("screenshot_file"), F.lit(""))).otherwise(F.concat(F.lit("screenshots/step_"), step.cast("string"), F.lit("_"), F.coalesce(_get("action_timestamp"), F.lit("")), F.lit(".png")))
    blank = F.lit("")
    rows = rows.select(
        "run", "line", step.alias("step_index"), F.nullif(F.when(object_, _strip(F.regexp_replace(raw, tool, ""))).otherwise(_reasoning()), blank).alias("reasoning"), F.nullif(F.when(object_, tagged).otherwise(screens.xml_calls(_text("response"))), blank).alias("tool_use"),
        F.nullif(code, blank).alias("output"), F.nullif(_strip(_get("info.error")), blank).alias("error"), F.coalesce(_get("reward", "double"), F.lit(0.0)).alias("reward"), F.coalesce(_get("done", "boolean"), F.lit(False)).alias("done"), kind.alias("action_type"), F.concat("run", F.lit("/"), shot).alias("path"),
    )
    at = F.row_number().over(Window.partitionBy("run").orderBy("step_index", "line")) - 1
    there = t.images.distinct().withColumn("screenshot", F.col("path"))
    task = t.configs.groupBy("run").agg(F.min(F.try_variant_get(F.try_parse_json("value"), "$.id", "string")).alias("id"))
    rows = rows.withColumn("pos", at).join(there, "path", "left").join(task, "run", "left").withColumn("trace_id", F.concat(F.lit("osworld_"), F.coalesce("id", _name("run"))))
    return rows.select("run", "trace_id", "pos", F.concat("trace_id", F.lit(":"), F.col("pos").cast("string")).alias("event_id"), F.lit("agent.step").alias("event_type"), "step_index", "reasoning", "tool_use", "output", "error", "reward", "done", "action_type", "screenshot")
