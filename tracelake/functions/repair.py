"""JSON that a model wrote with slips, or that breaks off."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PAIRS = {"{": "}", "[": "]"}


def closed(text: str) -> str | None:
    """A JSON text that breaks off, cut after its last whole value and closed; null where nothing is open or no safe place is left.

    Brackets and commas outside strings are followed in one pass; at each closing bracket and comma the
    place and the brackets still open there are noted.
    """
    open_, safe, quoted, skip = [], None, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, skip = (c != '"' or skip), (c == "\\" and not skip)
        elif c == '"':
            quoted = True
        elif c in PAIRS:
            open_.append(c)
        elif c in "]},":
            if c != "," and open_:
                open_.pop()
            safe = i + 1, tuple(open_)
    if not open_:
        return None
    if safe is None:
        return None if quoted else text + "".join(PAIRS[c] for c in reversed(open_))
    at, still = safe
    return text[:at].rstrip().rstrip(",") + "".join(PAIRS[c] for c in reversed(still))


def lenient(text: str | None) -> str | None:
    """The object in a model's answer as JSON text: without fences, with raw control characters in strings, or broken off."""
    body = (text or "").strip()
    if body.startswith("```"):
        body = body.partition("\n")[2] if "\n" in body else body[3:]
        body = body.removesuffix("```").strip()
    start = body.find("{")
    if start < 0:
        return None
    body = body[start:]
    end = body.rfind("}")
    for candidate in (body[: end + 1] if end >= 0 else None, closed(body)):
        if candidate:
            try:
                found = json.loads(candidate, strict=False)
            except (ValueError, RecursionError):
                continue
            if isinstance(found, dict):
                return json.dumps(found, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def _lenient(text: pd.Series) -> pd.Series:
    return text.map(lenient)


def lenient_object(text: Column) -> Column:
    """A VARIANT object of a model's answer: as it parses, else mended; null if neither. Only what doesn't parse is sent to Python's parser."""
    plain = F.try_parse_json(text)
    plain = F.when(F.schema_of_variant(plain).startswith("OBJECT"), plain)
    return F.coalesce(plain, F.try_parse_json(_lenient(F.when(plain.isNull(), text))))
