"""Runs on a screen: steps and status, results, taxonomy tags, answers of a judge, cascades of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import trace as X
from ..sources.staging import cut

ABSTAIN = ("malformed_response", "unparsed", "unknown_mode", "insufficient_evidence")


def steps(lines: DataFrame) -> DataFrame:
    """``(run, line, record)`` to steps in order of their number; lines that don't parse and system errors (an ``Error`` without a step) are left out."""
    num = F.try_variant_get("record", "$.step_num", "int")
    rows = lines.where("record is not null").where(num.isNotNull())
    get = lambda k, kind="string": F.try_variant_get("record", f"$.{k}", kind)
    return rows.select("run", num.alias("step_num"), get("action").alias("action"), F.coalesce(get("done", "boolean"), F.lit(False)).alias("done"), F.coalesce(get("reward", "double"), F.lit(0.0)).alias("reward"), F.nullif(F.trim(get("error")), F.lit("")).alias("error"), F.row_number().over(Window.partitionBy("run").orderBy(num, "line")).alias("ord"))


def system_errors(lines: DataFrame) -> DataFrame:
    """The first system error of each run."""
    bad = lines.where(F.try_variant_get("record", "$.Error", "string").isNotNull() & F.try_variant_get("record", "$.step_num", "int").isNull())
    return bad.groupBy("run").agg(F.min_by(F.try_variant_get("record", "$.Error", "string"), "line").alias("system_error"))


def run_status(lines: DataFrame) -> DataFrame:
    """A run succeeds if its last step is done with a reward; else why not: the step's error, the system's, or what is missing."""
    last = steps(lines).groupBy("run").agg(F.max_by(F.struct("step_num", "done", "reward", "error"), "ord").alias("s"))
    rows = lines.select("run").distinct().join(last, "run", "left").join(system_errors(lines), "run", "left")
    ok = F.coalesce(F.col("s.done") & (F.col("s.reward") > 0), F.lit(False))
    step = F.col("s.step_num").cast("string")
    why = F.when(F.col("s").isNull(), F.coalesce("system_error", F.lit("empty trajectory"))).otherwise(F.coalesce("s.error", "system_error", F.when(~F.col("s.done"), F.concat(F.lit("trajectory terminated without done=True at step "), step)).otherwise(F.concat(F.lit("task scored reward="), F.col("s.reward").cast("string"), F.lit(" at step "), step))))
    return rows.select("run", F.when(ok, "success").otherwise("failure").alias("status"), F.coalesce("s.step_num", F.lit(-1)).alias("terminal_step"), F.when(ok, "").otherwise(why).alias("error"))


def classify(results: DataFrame) -> DataFrame:
    """Result texts: a number that is 1 is a success, another a failure, anything else is skipped."""
    score = F.trim("result").try_cast("double")
    return results.select("run", F.when(score.isNull(), "skipped").when(score == 1.0, "success").otherwise("failure").alias("result_class"))


def first_per_task(rows: DataFrame) -> DataFrame:
    """One result a task across trials, the first trial's."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("task_id").orderBy("trial"))).where("r = 1").drop("r")


def root_of_analysis(analyses: DataFrame, runs: DataFrame, modes: DataFrame) -> DataFrame:
    """``(trace_id, step, tag)`` to the first event of that step and the tag's mode, ``gui.unknown`` for a tag that isn't known."""
    first = runs.where("step_index is not null").groupBy("trace_id", F.col("step_index").alias("step")).agg(F.min_by("event_id", "pos").alias("event_id"))
    rows = analyses.join(first, ["trace_id", "step"], "left").join(modes, "tag", "left")
    return rows.select("trace_id", "step", "event_id", F.coalesce("mode_id", F.lit("gui.unknown")).alias("mode_id"))


def tiered_labels(rows: DataFrame) -> DataFrame:
    """A final decision stands alone, else every person's label that is whole, else the model's."""
    whole = lambda x: F.coalesce(x["tag"].isNotNull() & x["step"].isNotNull(), F.lit(False))
    people = F.filter("humans", whole)
    tiers = F.when(whole(F.col("final")), F.array(F.struct(F.lit("human").alias("source"), F.col("final.tag").alias("tag"), F.col("final.step").alias("step"))))
    tiers = tiers.when(F.size(people) > 0, F.transform(people, lambda h: F.struct(F.lit("human").alias("source"), h["tag"].alias("tag"), h["step"].alias("step"))))
    tiers = tiers.when(whole(F.col("model")), F.array(F.struct(F.lit("llm").alias("source"), F.col("model.tag").alias("tag"), F.col("model.step").alias("step"))))
    return rows.select("task_id", F.explode(tiers).alias("x")).select("task_id", "x.*")


def instruction(raw: Column) -> Column:
    """Squeezed, without quotation marks at its ends, beginning with a capital and ending as a sentence."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " "), "^[ \"']+|[ \"']+$", "")
    x = F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))
    return F.when(x == "", x).when(F.right(x, F.lit(1)).isin(".", "!", "?"), x).otherwise(F.concat(x, F.lit(".")))


def tagged_sections(raw: Column) -> Column:
    """The texts of ``[TEXT]`` and ``[THINKING]`` sections, one a line; tool and other sections go."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), raw), F.lit(r"(?s)\n\[(?:TEXT|THINKING)\](.*?)(?=\n\[(?:TEXT|THINKING|TOOL_USE|OTHER)\]|$)"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s*\n", " "))), lambda x: x != ""), "\n")


def xml_calls(raw: Column) -> Column:
    """Function names and parameters of XML tool calls, a line each."""
    lines = F.regexp_extract_all(raw, F.lit(r"(?s)<function=([^>]+)>|<parameter=[^>]+>.*?</parameter>"), F.lit(0))
    name = lambda x: F.concat(F.lit("function: "), F.trim(F.regexp_extract(x, "<function=([^>]+)>", 1)))
    param = lambda x: F.concat(F.trim(F.regexp_extract(x, "<parameter=([^>]+)>", 1)), F.lit(": "), F.trim(F.regexp_extract(x, "(?s)<parameter=[^>]+>(.*?)</parameter>", 1)))
    return F.array_join(F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("<function=")), name(x)).otherwise(param(x))), "\n")


def moved_click(code: Column, x: Column, y: Column) -> Column:
    """A click's coordinates replaced by the model's; a scroll keeps its amount; without coordinates nothing changes."""
    at = F.concat(x.cast("string"), F.lit(", "), y.cast("string"))
    std = F.regexp_replace(code, F.lit(r"pyautogui\.(click|rightClick|doubleClick|tripleClick|middleClick|moveTo|mouseDown|mouseUp)\(\s*\d+\s*,\s*\d+"), F.concat(F.lit("pyautogui.$1("), at))
    scr = F.regexp_replace(std, F.lit(r"pyautogui\.(scroll|hscroll)\(\s*(-?\d+)\s*,\s*\d+\s*,\s*\d+"), F.concat(F.lit("pyautogui.$1($2, "), at))
    return F.when(x.isNull() | y.isNull(), code).otherwise(scr)


def classification(answer: Column, families: dict[str, str]) -> Column:
    """A judge's answer: a known mode with its family and a confidence in 0 to 1, or why it is none."""
    v = X.json_block(answer)
    mode = F.try_variant_get(v, "$.mode_id", "string")
    family = F.lit(None).cast("string")
    for m, f in families.items():
        family = F.when(mode == m, f).otherwise(family)
    said = F.try_variant_get(v, "$.abstain_reason", "string")
    reason = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "malformed_response").when(F.coalesce(F.try_variant_get(v, "$.abstain", "boolean"), F.lit(False)), F.when(said.isin(*ABSTAIN), said).otherwise("unparsed")).when(F.coalesce(mode, F.lit("")) == "", "unparsed").when(family.isNull(), "unknown_mode")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))))
    return F.struct(reason.alias("abstain_reason"), F.when(reason.isNull(), mode).alias("mode_id"), F.when(reason.isNull(), family).alias("family"), confidence.alias("confidence"))


def cascade(findings: DataFrame, depth: int = 4096) -> DataFrame:
    """``(trace_id, event_id, parent_id, step)`` in depth-first order from the roots, children by step: ``place`` and ``depth``.

    A pass doubles the hops to an ancestor and joins the paths, so a chain of 2^p takes p passes, and there are
    no more passes than the longest chain needs; what reaches no root within ``depth`` hops (a circle, or a parent
    that isn't there) comes last, by step.
    """
    own = F.concat(F.lpad(F.coalesce(F.col("step").cast("string"), F.lit("999999999")), 9, "0"), F.lit(":"), "event_id")
    known = findings.select("trace_id", F.col("event_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    rows = findings.join(known, ["trace_id", "parent_id"], "left")
    rows = rows.select("trace_id", "event_id", "step", F.when(F.col("there"), F.col("parent_id")).alias("up"), (F.col("parent_id").isNotNull() & F.col("there").isNull()).alias("lost"), own.alias("path"), F.lit(0).alias("depth"))
    rows, hops = cut(rows), 1
    while hops < depth and not rows.where("up is not null").isEmpty():
        above = rows.select("trace_id", F.col("event_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"), F.col("depth").alias("more"))
        rows = cut(rows.join(above, ["trace_id", "up"], "left").select("trace_id", "event_id", "step", F.col("next").alias("up"), "lost", F.concat_ws("/", "above", "path").alias("path"), F.when(F.col("above").isNotNull(), F.col("depth") + F.col("more") + 1).otherwise(F.col("depth")).alias("depth")))
        hops *= 2
    loose = F.col("lost") | F.col("up").isNotNull()
    order = F.row_number().over(Window.partitionBy("trace_id").orderBy(loose, F.when(~loose, F.col("path")), F.col("step").isNull(), "step", "event_id")) - 1
    return rows.select("trace_id", "event_id", order.alias("place"), F.when(~loose, F.col("depth")).alias("depth"))


def debugger_refs(files: DataFrame) -> DataFrame:
    """``(trial, task_id, model, root_error_step, taxonomy_tag, evidence, correction)`` of analyses ``files(trial, task_id, value)``; what isn't a JSON object is left out."""
    p = F.try_parse_json("value")
    rows = files.withColumn("p", p).where(F.schema_of_variant("p").startswith("OBJECT"))
    of = lambda k, kind="string": F.try_variant_get("p", f"$.{k}", kind)
    blank = F.lit("")
    return rows.select("trial", "task_id", F.coalesce(F.nullif(of("model"), blank), "trial").alias("model"), of("root_error_step", "int").alias("root_error_step"), of("taxonomy_tag").alias("taxonomy_tag"), F.coalesce(of("evidence"), blank).alias("evidence"), F.coalesce(of("correction"), blank).alias("correction"))
