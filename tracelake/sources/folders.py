"""Trace exports of unknown format: files are told apart by their shape and routed to their projection.

Lines stay lines: what a file is follows from flags over its lines, so a long log is no row of its own. Only
formats that are one list (a conversation, a run's spans) are put together per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scrub import redact_hosts
from . import agent_logs, exports, ingest
from .exports import EVENT, _list, get, has

#: Record kinds of a rollout log.
ROLLOUT = ("session_meta", "response_item", "event_msg", "turn_context", "compacted")
#: Formats whose projection reads a list under a key.
LISTS = {"message_list": "messages", "event_list": "events", "crew_events": "events", "graph_callbacks": "events", "spans": "spans"}
LOGS = ("session_records", "rollout", "agent_session", "agent_runtime")


def _messages(payloads: DataFrame) -> DataFrame:
    rows = ingest.messages(payloads).withColumn("event_id", F.concat("trace_id", F.lit(":"), F.col("pos").cast("string")))
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in EVENT])


PROJECTIONS = {
    "messages": _messages, "message_list": _messages, "conversations": exports.conversations, "event_list": exports.event_list, "trajectory": exports.event_list, "spans": exports.spans, "crew_events": exports.crew_events,
    "graph_callbacks": exports.graph_callbacks, "shop_pages": exports.shop_pages, "unified": exports.unified, "hermes": exports.hermes, "session_records": exports.session_log, "rollout": exports.rollout,
    "agent_session": lambda r: agent_logs.session_events(agent_logs.named(r)), "agent_runtime": lambda r: agent_logs.runtime_events(agent_logs.named(r, runtime=True)),
}


def formats(lines: DataFrame) -> DataFrame:
    """``(file, format, error)`` of each file in ``lines(file, line, value)``.

    A file of one JSON value is told by that value, one of several by its lines together; a line that isn't
    JSON, a shape that no format has, and a file without values make an error. Blank lines don't count.
    """
    rows = lines.where(F.col("value").rlike(r"\S")).select("file", "line", F.try_parse_json("value").alias("record"))
    r = F.col("record")
    name = F.lower(F.coalesce(get(r, "event", "type", "name"), F.lit("")))
    object_ = F.coalesce(F.schema_of_variant(r).startswith("OBJECT"), F.lit(False))
    flags = {
        "shop": has(r, "url", "page") & has(r, "content", "observation"), "crew": name.rlike("crew|task_|agent_execution|tool_usage"), "graph": name.rlike("^on_|chain|graph") | has(r, "run_id"), "rollout": get(r, "type").isin(*ROLLOUT) & has(r, "payload"),
        "session": has(r, "sessionId") & has(r, "message"), "message": has(r, "role", "content"), "event": has(r, "event_type", "type"), "span": has(r, "span_id", "trace_id", "name"), "object": object_,
        "runtime": exports.is_runtime(r), "transcript": exports.is_transcript(r),
    }
    every = [F.bool_and(F.coalesce(f, F.lit(False))).alias(f"all_{n}") for n, f in flags.items()]
    some = [F.bool_or(F.coalesce(flags[n], F.lit(False))).alias(f"any_{n}") for n in ("rollout", "session", "runtime", "transcript")]
    bad = F.min(F.when(r.isNull(), F.col("line"))).alias("bad")
    of = rows.groupBy("file").agg(F.count("*").alias("n"), bad, F.first(exports.detect_format("record")).alias("whole"), *every, *some)
    listed = (
        F.when(F.col("n") == 1, F.col("whole")).when(~F.col("all_object"), None).when(F.col("all_shop"), "shop_pages").when(F.col("any_rollout"), "rollout").when(F.col("all_crew"), "crew_events").when(F.col("any_session"), "session_records")
        .when(F.col("all_runtime"), "agent_runtime").when(F.col("any_transcript"), "agent_session").when(F.col("all_graph"), "graph_callbacks").when(F.col("all_message"), "message_list").when(F.col("all_event"), "event_list").when(F.col("all_span"), "spans")
    )
    one = F.when((F.col("n") == 1) & F.col("all_object") & F.col("whole").isNull(), F.when(F.col("any_rollout"), "rollout").when(F.col("any_session"), "session_records").when(F.col("any_runtime"), "agent_runtime").when(F.col("any_transcript"), "agent_session"))
    known = lines.select("file").distinct().join(of, "file", "left")
    form = F.when(F.col("bad").isNull(), F.coalesce(one, listed))
    error = F.when(F.col("n").isNull(), "no values").when(F.col("bad").isNotNull(), F.concat(F.lit("line "), F.col("bad").cast("string"), F.lit(" is not JSON"))).when(form.isNull(), "no known format")
    return known.select("file", form.alias("format"), error.alias("error"))


def _stem(file: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")


def convert(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of all files, with their ``format``, and a row per file as :func:`formats` gives it.

    ``lines(file, line, value)``: a file's lines, or its whole text as one. A trace is named by its payload
    (trace_id, trajectory_id, task_id, id; logs by their session), else by the file; files of one name that lie in different
    folders have to name their traces themselves. A file with an error has no events and stops no other.
    Hosts' own logs are redacted.
    """
    files = formats(lines)
    rows = lines.where(F.col("value").rlike(r"\S")).join(files.where("error is null").select("file", "format"), "file")
    own_name = lambda p: F.coalesce(get(p, "trace_id", "trajectory_id", "task_id", "id"), _stem(F.col("file")))
    payload = F.try_parse_json("value")
    logs = rows.where(F.col("format").isin(*LOGS)).select("file", "format", _stem(F.col("file")).alias("trace_id"), "line", payload.alias("record"))
    # a log may be one list instead of lines; its items are numbered in their place
    logs = logs.select("*", F.posexplode(F.coalesce(_list("record"), F.array("record"))).alias("at", "item")).select("file", "format", "trace_id", (F.col("line") + F.col("at")).alias("line"), F.col("item").alias("record"))
    # what is listed in one value or over several lines becomes a list under the key that its projection reads
    held = rows.where(~F.col("format").isin(*LOGS)).groupBy("file", "format").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("values"))
    text = F.array_join(F.transform("values", lambda v: v["value"]), ",")
    is_list = (F.size("values") > 1) | (F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"))
    listed = F.when(F.size("values") > 1, F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    key = F.coalesce(*[F.when(F.col("format") == f, F.lit(k)) for f, k in LISTS.items()])
    whole = F.when(is_list & key.isNotNull(), F.concat(F.lit('{"'), key, F.lit('":'), listed, F.lit("}"))).otherwise(listed)
    payloads = held.select("file", "format", F.parse_json(whole).alias("payload")).withColumn("trace_id", own_name(F.col("payload")))
    out = None
    for name, projection in PROJECTIONS.items():
        mine = (logs if name in LOGS else payloads).where(F.col("format") == name)
        events = redact_hosts(projection(mine).select(*EVENT).withColumn("format", F.lit(name)))
        out = events if out is None else out.unionByName(events)
    return out, files


def numbered_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """``(file, line, value)`` of a folder's text files of such names, at any depth, lines numbered from 1."""
    # numbers rise within a split, and splits by their start: together a file's order
    start, number = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder).select(F.col("_metadata.file_path").alias("file"), start.alias("start"), number.alias("number"), "value")
    at = F.row_number().over(Window.partitionBy("file").orderBy("start", "number"))
    return lines.select("file", at.cast("long").alias("line"), "value")


def whole_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``(file, value)`` of a folder's text files of such names, at any depth."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, line, value)`` of a folder's ``.json`` files (each whole) and ``.jsonl`` files (by lines), at any depth; files of no bytes have no lines."""
    whole = whole_files(spark, folder, "*.json").select("file", F.lit(0).cast("long").alias("line"), "value")
    return whole.unionByName(numbered_lines(spark, folder))


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """:func:`convert` of all exports in a folder."""
    return convert(read_lines(spark, folder))
