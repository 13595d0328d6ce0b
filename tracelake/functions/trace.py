"""Column -> Column functions of trace events: types, headers, keys, clips, classes of text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .text import squeeze

# Type names and word lists that decide an event's class.
ENVIRONMENT_TYPES = ("tool.result", "observation", "error", "memory.read")
EVENT_TYPES = ("run.start", "run.end", "agent.step", "llm.call", "llm.response", "tool.call", "tool.result", "memory.read", "memory.write", "reflection", "plan", "handoff", "guardrail", "observation", "error", "human.feedback")
TYPE_ALIASES = (("message", "agent.step"), ("assistant", "agent.step"), ("user", "observation"), ("tool", "tool.call"))
MODULES = (("action", ("tool.call", "tool.result")), ("llm", ("llm.call", "llm.response")), ("planning", ("plan", "agent.step")), ("environment", ("observation",)), ("multiagent", ("handoff",)))
ACTION_WORDS = ("search", "click", "open", "look", "go to", "goto", "use", "take", "put", "cool", "heat", "clean")
ERROR_PREFIXES = ("error", "traceback (most recent call last)", "exception", "fatal:", "command failed", "command exited with code", "bash: ", "sh: ", "zsh: ")
ERROR_FIRST_LINE = ("command not found", "no such file or directory", "permission denied", "non-zero exit")
STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "for", "is", "was", "were", "be", "by", "with", "that", "this", "it", "its", "as", "but", "agent", "step", "error", "failed", "failure", "task", "when", "then")
GOAL_KEYS = ("goal", "instruction", "task", "objective", "prompt")


def compress_role(kind: Column) -> Column:
    """``compress`` for what the environment said, ``preserve`` for what an agent did."""
    return F.when(kind.isin(*ENVIRONMENT_TYPES), "compress").otherwise("preserve")


def tier(distance: Column, role: Column, near: int = 2, middle: int = 5) -> Column:
    """How tersely an event so far from the focus is shown; the environment always tersely."""
    return F.when(role == "compress", "th3").when(distance <= near, "th1").when(distance <= middle, "th2").otherwise("th3")


def labelled_text(**parts: Column) -> Column:
    """``name: value`` lines; empty values go."""
    return F.concat_ws("\n", *[F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in parts.items()])


def header(step: Column, pos: Column, kind: Column, agent: Column, event_id: Column, judgeable: Column | None = None) -> Column:
    bits = [F.concat(F.lit("step="), F.coalesce(step, pos).cast("string")), F.concat(F.lit("type="), kind), F.when(F.coalesce(agent, F.lit("")) != "", F.concat(F.lit("agent="), agent)), F.concat(F.lit("event_id="), event_id)]
    if judgeable is not None:
        bits.append(F.when(~judgeable, F.lit("CONTEXT-ONLY")))
    return F.concat(F.lit("--- "), F.concat_ws(" ", *bits), F.lit(" ---"))


def machine_generated(text: Column) -> Column:
    """Diffs, tracebacks, and texts of three lines or more of which 60 % look structured."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    structured = F.filter(lines, lambda x: x.rlike(r"^(    |\t|[+\-|>])|^\s*(\$|#|at |File \")|^\s*[0-9][^:]{0,6}:") & (F.char_length(F.trim(x)) > 0))
    marked = F.contains(body, F.lit("diff --git")) | F.contains(body, F.lit("Traceback (most recent call last)")) | (F.startswith(body, F.lit("---")) & F.contains(F.substring(body, 1, 500), F.lit("+++ ")))
    return (body != "") & (marked | ((F.size(F.split(body, "\n")) >= 3) & (F.size(structured) >= 0.6 * F.size(lines))))


def signature(kind: Column, agent: Column, module: Column, text: Column, n: int = 120) -> Column:
    """What a spectrum counts; null for lifecycle events and the system's errors."""
    out = F.concat_ws("|", kind, agent, module, F.substring(squeeze(text), 1, n))
    return F.when(~(kind.isin("run.start", "run.end") | ((kind == "error") & (agent == "system"))), out)


def action(payload: Column) -> Column:
    """``struct<tool, args>`` of a VARIANT under its aliases; null without a tool, args only if an object."""
    get = lambda *keys: F.coalesce(*[F.try_variant_get(payload, f"$.{k}", "string") for k in keys])
    args = F.coalesce(*[F.try_variant_get(payload, f"$.{k}", "variant") for k in ("args", "arguments", "parameters")])
    tool = F.nullif(get("tool", "name", "action"), F.lit(""))
    return F.when(tool.isNotNull(), F.struct(tool.alias("tool"), F.when(F.schema_of_variant(args).startswith("OBJECT"), F.to_json(args)).alias("args")))


def action_key(act: Column) -> Column:
    """``tool:arguments``, keys sorted as VARIANT keeps them."""
    return F.concat(act["tool"], F.lit(":"), F.coalesce(act["args"], F.lit("{}")))


def tokens(text: Column, kind: str = "terms") -> Column:
    """Distinct words: ``terms`` (3 letters or digits and more, no stop words), ``words`` (also underscore), ``merge`` (2 and more)."""
    low = F.lower(text)
    if kind == "terms":
        return F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.char_length(x) > 2) & ~x.isin(*STOPWORDS)))
    found = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(found if kind == "words" else F.filter(found, lambda x: F.char_length(x) >= 2))


def slug(text: Column, k: int = 3) -> Column:
    """The first k terms, repeated ones too, joined by underscores."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.char_length(x) > 2) & ~x.isin(*STOPWORDS))
    return F.when(F.size(found) == 0, "pattern").otherwise(F.array_join(F.slice(found, 1, k), "_"))


def bound(text: Column, n: int = 65_536) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("<truncated>"))).otherwise(text)


def compact(text: Column, n: int = 1200) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def coerce_type(raw: Column) -> Column:
    """A known event type, an alias of one, else ``agent.step``; underscores count as dots."""
    low = F.replace(F.lower(F.coalesce(raw, F.lit(""))), F.lit("_"), F.lit("."))
    out = F.when(low.isin(*EVENT_TYPES), low)
    for alias, kind in TYPE_ALIASES:
        out = out.when(low == alias, kind)
    return out.otherwise("agent.step")


def module_of(kind: Column) -> Column:
    out = F.when(kind.isNull(), "runtime")
    for module, kinds in MODULES:
        out = out.when(kind.isin(*kinds), module)
    return out.otherwise("runtime")


def _any(low: Column, *words: str) -> Column:
    return low.rlike("|".join(words))


def span_type(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(_any(low, "tool", "function"), F.when(_any(low, "start", "call"), "tool.call").otherwise("tool.result")).when(_any(low, "generation", "llm", "chat"), "llm.call").when(_any(low, "handoff"), "handoff").otherwise("agent.step")


def crew_type(raw: Column) -> Column:
    low = F.lower(raw)
    ended = _any(low, "finished", "completed")
    return F.when(_any(low, "tool"), F.when(ended, "tool.result").otherwise("tool.call")).when(_any(low, "llm"), F.when(ended, "llm.response").otherwise("llm.call")).when(_any(low, "task") & _any(low, "started"), "plan").otherwise("agent.step")


def graph_type(raw: Column) -> Column:
    low = F.lower(raw)
    return F.when(_any(low, "tool"), F.when(_any(low, "end", "error"), "tool.result").otherwise("tool.call")).when(_any(low, "llm", "chat"), F.when(_any(low, "end"), "llm.response").otherwise("llm.call")).otherwise("agent.step")


def action_type(text: Column) -> Column:
    return F.when(F.lower(text).rlike("^(" + "|".join(ACTION_WORDS) + ")"), "tool.call").otherwise("agent.step")


def observation_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(_any(low, "previous reflections:", "current observation:"), "observation").when(_any(low, "error", "exception"), "error").otherwise("observation")


def looks_like_error(text: Column) -> Column:
    """An error prefix in the first 80 characters, or a shell's complaint in the first line."""
    body = F.ltrim(F.coalesce(text, F.lit("")))
    head = F.lower(F.substring(body, 1, 80))
    starts = F.lit(False)
    for p in ERROR_PREFIXES:
        starts = starts | F.startswith(head, F.lit(p))
    return starts | _any(F.lower(F.split(body, "\n", 2)[0]), *ERROR_FIRST_LINE)


def content_text(v: Column) -> Column:
    """A message's content (VARIANT): a string as it is, blocks by their text or content a line each, else its JSON."""
    blocks = F.try_variant_get(v, "$", "array<variant>")
    one = lambda b: F.coalesce(F.nullif(F.try_variant_get(b, "$.text", "string"), F.lit("")), F.nullif(F.try_variant_get(b, "$.content", "string"), F.lit("")), F.try_variant_get(b, "$", "string"), F.to_json(b))
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).when(blocks.isNotNull(), F.array_join(F.transform(blocks, one), "\n")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit("")))


def goal_of(v: Column) -> Column:
    """The first non-blank goal-like string of a payload."""
    return F.coalesce(*[F.nullif(F.trim(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))), F.lit("")) for k in GOAL_KEYS])


def timestamp_of(text: Column) -> Column:
    """ISO text (with Z), or an epoch in seconds, or in milliseconds above 1e12; else null."""
    n = text.try_cast("double")
    return F.when(n.isNotNull(), F.timestamp_micros(F.when(n > 1e12, n * 1000).otherwise(n * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(text))


def json_block(text: Column) -> Column:
    """The JSON object in a model's answer, as VARIANT: fenced, or from the first brace to the last; null if it doesn't parse."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    greedy = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(fenced), F.try_parse_json(F.trim(text)), F.try_parse_json(greedy))


def fingerprint(v: Column) -> Column:
    """SHA-256 of the canonical JSON (VARIANT keeps keys sorted)."""
    return F.sha2(F.to_json(v), 256)


def record_id(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "__"), "^_+|_+$", "")


def stable_trace_id(key: Column, line: Column, index: Column, prefix: str = "aeb") -> Column:
    """The key with runs of other characters as one underscore, else the 1-based row number and a digest of the line."""
    slugged = F.regexp_replace(F.regexp_replace(key, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(key, F.lit("")) != "", F.concat(F.lit(f"{prefix}_"), slugged)).otherwise(F.concat(F.lit(f"{prefix}_row_"), F.lpad((index + 1).cast("string"), 4, "0"), F.lit("_"), F.substring(F.sha1(line), 1, 16)))


def tag_of(raw: Column) -> Column:
    x = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(F.lower(x) == "infeasible task", "IF").otherwise(x)


def category_of(raw: Column) -> Column:
    """A tag's leading capitals, or the tag where it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(tag_of(raw), "^[A-Z]+", 0), F.lit("")), tag_of(raw))


def token_cost(prompt: Column, completion: Column, in_price: float, out_price: float) -> Column:
    """Price of a call, prices per million tokens, 8 places."""
    return F.round((prompt * in_price + completion * out_price) / 1e6, 8)


def retry_delay(attempt: Column, retry_after: Column, base: float = 1.0, jitter: Column | float = 0.0, cap: float = 60.0) -> Column:
    """What the server asks for, if it is a number; else exponential plus a share of it, capped."""
    step = F.lit(base) * F.pow(F.lit(2.0), attempt)
    asked = retry_after.try_cast("double")
    return F.coalesce(F.when(asked.isNotNull(), F.greatest(F.lit(0.0), asked)), F.least(F.lit(cap), step * (1 + (jitter if isinstance(jitter, Column) else F.lit(jitter)))))


def clamp(confidence: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(confidence, F.lit(0.0))))
