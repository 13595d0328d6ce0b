"""Redaction of secrets and personal data, rule after rule on the text already rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name, pattern, replacement, in this order (an earlier rule can swallow a later one's match).
REDACTIONS = (
    ("openai_key", r"sk-[A-Za-z0-9_\-]{20,}", "<redacted:openai_key>"),
    ("anthropic_key", r"sk-ant-[A-Za-z0-9_\-]{20,}", "<redacted:anthropic_key>"),
    ("aws_key", r"AKIA[0-9A-Z]{16}", "<redacted:aws_access_key>"),
    ("aws_secret", r"(?<![A-Za-z0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9])", "<redacted:aws_secret_or_b64_40>"),
    ("google_api_key", r"AIza[0-9A-Za-z_\-]{35}", "<redacted:google_api_key>"),
    ("gh_token", r"gh[pousr]_[A-Za-z0-9]{36,}", "<redacted:github_token>"),
    ("pypi_token", r"pypi-[A-Za-z0-9_\-]{20,}", "<redacted:pypi_token>"),
    ("bearer_token", r"(?i)Bearer\s+[A-Za-z0-9_\-\.=]{20,}", "Bearer <redacted:bearer>"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "<redacted:email>"),
    ("phone_e164", r"(?<![\w])\+\d{8,15}(?![\w])", "<redacted:phone>"),
    ("ssn_us", r"\b\d{3}-\d{2}-\d{4}\b", "<redacted:ssn>"),
    ("credit_card", r"\b(?:\d[ -]?){13,19}\b", "<redacted:cc>"),
    ("url_credentials", r"(https?://)[^\s/@]+:[^\s/@]+@", "$1<redacted:url_credentials>@"),
)
#: What a text must hold for a rule to have a match; the pattern runs on no other text.
LITERALS = {"openai_key": "sk-", "anthropic_key": "sk-ant-", "aws_key": "AKIA", "google_api_key": "AIza", "gh_token": "_", "pypi_token": "pypi-", "email": "@", "phone_e164": "+", "ssn_us": "-", "url_credentials": "://"}


def scrub(rows: DataFrame, key: str, text: str, rules=REDACTIONS) -> DataFrame:
    """Scrubbed text and replacements per rule. ``\\d``, ``\\w``, ``\\s`` and ``\\b`` mean all of Unicode's.

    A rule counts only where its literal occurs, and rewrites only where it counted.
    """
    out = rows.select(F.col(key), F.col(text).alias("text"))
    for name, pattern, replacement in rules:
        pattern = "(?U)" + pattern
        count = F.regexp_count("text", F.lit(pattern))
        if name in LITERALS:
            count = F.when(F.contains("text", F.lit(LITERALS[name])) | F.col("text").isNull(), count).otherwise(0)
        out = out.withColumn(name, count).withColumn("text", F.when(F.col(name) > 0, F.regexp_replace("text", pattern, replacement)).otherwise(F.col("text")))
    return out


def scrub_text(text: Column, rules=REDACTIONS) -> Column:
    for _, pattern, replacement in rules:
        text = F.regexp_replace(text, "(?U)" + pattern, replacement)
    return text


def scrub_fields(fields: Column, rules=REDACTIONS) -> Column:
    """The same for the values of a map, nested JSON text included as it stands; keys stay."""
    return F.transform_values(fields, lambda _, v: scrub_text(v, rules))


def totals(scrubbed: DataFrame, rules=REDACTIONS) -> DataFrame:
    """Replacements per rule over all rows, and rows that had any."""
    counts = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n, _, _ in rules]
    some = F.lit(False)
    for n, _, _ in rules:
        some = some | (F.coalesce(n, F.lit(0)) > 0)
    return scrubbed.agg(*counts, F.count_if(some).alias("rows_touched"))


#: Formats that are read from a host's own log, which holds whatever was pasted or printed.
HOST_FORMATS = ("rollout", "session_records")


def redact_hosts(events: DataFrame, rules=REDACTIONS) -> DataFrame:
    """Events with ``output`` and ``error`` scrubbed where ``format`` is a host's log; exports that users give stay as they are."""
    host = F.coalesce(F.col("format").isin(*HOST_FORMATS), F.lit(False))
    scrubbed = lambda c: F.when(host, scrub_text(F.col(c), rules)).otherwise(F.col(c))
    return events.withColumns({"output": scrubbed("output"), "error": scrubbed("error")})
