"""Column -> Column text functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def squeeze(x: Column) -> Column:
    """Runs of white space to one space, ends trimmed, null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)\s+", " "))


def truncate(x: Column, n: int) -> Column:
    return F.when(F.char_length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def clip_middle(x: Column, limit: int, marker: str = "\n...\n") -> Column:
    """At most ``limit`` characters: 60 % of the room from the head, the marker, the rest from the tail."""
    room = max(0, limit - len(marker))
    head = int(room * 0.6)
    tail = room - head
    return F.when(F.char_length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, head), F.lit(marker), F.expr("''") if not tail else F.right(x, F.lit(tail))))


def unescape(x: Column) -> Column:
    """The two-character sequences for line feed, tab and quotation marks become those characters."""
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def quote_norm(x: Column) -> Column:
    """Unescaped and squeezed, without trailing truncation marks."""
    return F.trim(F.regexp_replace(squeeze(unescape(x)), r"(\s*(…|\.\.\.|\[truncated\]|\[\.\.\.\]))+$", ""))


def canonical(x: Column) -> Column:
    """Normalised and without quotation marks (and the spaces that these leave)."""
    return squeeze(F.translate(quote_norm(x), "\"'`‘’“”", ""))


def word_set(x: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscore."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9_]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def stable_id(*parts: Column) -> Column:
    """SHA-256 over NUL-joined parts."""
    return F.sha2(F.concat_ws("\0", *parts), 256)
