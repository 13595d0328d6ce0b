"""URL filtering: fixed host/path rules first, mined association rules for the rest. DataFrame operations only.

FP-growth mines the token combinations that come with a block label, from the whole token sets of all
labelled URLs; tokens that are in exactly the same URLs are one item. Rules above a support and a confidence
are indexed under their rarest item, so that a URL meets only rules that share it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import Scratch

#: The label's item; no token starts with an equals sign.
BLOCK = "=block"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: A rule must hold for so many blocked URLs, however few there are in all: what fewer show may be chance.
LEAST_ROWS = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules as they are given: verdict, host, path.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or URL."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From there up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct marked tokens: host labels, path segments' words, query keys and values; runs of digits are one token."""
    words = lambda text, split, mark: F.transform(
        F.filter(F.split(F.translate(text, _UPPER, _LOWER), split), lambda x: x != ""),
        lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")),
    )
    query = F.coalesce(F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1), F.lit(""))
    return F.array_distinct(F.concat(words(host_of(url), "[.:@]", "h:"), words(path_of(url), "[/._\\-~+%,;]", "p:"), words(query, "[&;=]", "q:")))


def _items(known: DataFrame, need: int, n: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Token sets with their items ``(tokens, items, n, blocked)``, and the items ``(item, tokens)``.

    A token in fewer than ``need`` blocked URLs is in no rule, and one in all URLs changes none. Tokens that
    are in exactly the same URLs are one item, named by the least of them: two hashes of the sets' numbers,
    combined by exclusive or, and the URLs' number tell whether they are.
    """
    sets = scratch.table(known.groupBy(tokens_of(F.col("url")).alias("tokens")).agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")), "url-sets")
    name = F.concat_ws("\n", F.array_sort("tokens"))
    alike = [F.expr(f"bit_xor({h})") for h in ("conv(substr(at, 1, 15), 16, 10)::bigint", "conv(substr(at, 16, 15), 16, 10)::bigint")]
    of_token = sets.select("n", "blocked", F.md5(name).alias("at"), F.explode("tokens").alias("token")).groupBy("token")
    of_token = of_token.agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), alike[0].alias("x"), alike[1].alias("y")).where((F.col("b") >= need) & (F.col("n") < n))
    items = scratch.table(of_token.groupBy("x", "y", "n", "b").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.col("tokens")[0].alias("item"), "tokens"), "url-items")
    held = sets.select(F.md5(name).alias("at"), "n", "blocked", F.explode("tokens").alias("item")).join(items.select("item"), "item")
    return held.groupBy("at", "n", "blocked").agg(F.array_sort(F.collect_list("item")).alias("items")), items


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Rules ``(tokens, key, confidence, support, lift, alike)`` that imply a block, from ``(url, blocked boolean)``.

    All tokens of all URLs take part, and sets of any length. ``tokens`` are a rule's items and ``alike`` the
    tokens that each stands for: one of each makes the rule fit. Of the sets that are in the same URLs only
    the least ones (no item can go without the set being in more URLs) become rules, and none that contains
    an always blocked one: every other frequent set has such a subset with no less confidence, so
    :func:`judge` gives what all rules would give.

    A rule holds for at least ``max(min_support * n, least_rows)`` blocked URLs of n labelled ones. Rows of
    null url or label teach nothing; no labels give no rules. Only rules better than the base rate (lift
    above 1) stay.
    """
    known = labelled.where("url is not null and blocked is not null")
    spark = labelled.sparkSession
    n, blocked = known.agg(F.count("*"), F.count_if("blocked")).first()
    need = max(math.ceil(min_support * n), least_rows, 1)
    nothing = spark.createDataFrame([], "tokens array<string>, key string, confidence double, support double, lift double, alike array<array<string>>")
    if blocked < need:
        return nothing
    keep, passing = Scratch(spark), Scratch(spark)
    held, items = _items(known, need, n, passing)
    # a row a URL: the label is an item of the blocked ones
    urls = held.select("items", F.explode(F.array(F.struct(F.col("blocked").alias("k"), F.lit(True).alias("bad")), F.struct((F.col("n") - F.col("blocked")).alias("k"), F.lit(False).alias("bad")))).alias("of")).where("of.k > 0")
    urls = urls.select(F.when(F.col("of.bad"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"), F.explode(F.expr("sequence(1L, of.k)"))).select("items")
    urls = passing.table(urls, "url-baskets")
    if (rows := urls.count()) < need:
        passing.drop()
        return nothing
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / rows, minConfidence=min_confidence).fit(urls)
    found = passing.table(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")), "url-itemsets")
    with_label = found.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("n").alias("b"))
    sets = passing.table(with_label.join(found, "items"), "url-frequent")
    # a subset of one item less is frequent too, and its URLs are at least the set's
    part = sets.where(F.size("items") > 1).select("items", "n", F.explode(F.transform("items", lambda x, i: F.filter("items", lambda y, j: j != i))).alias("part"))
    less = sets.select(F.col("items").alias("part"), F.col("n").alias("more"), F.col("b").alias("bad"))
    idle = part.join(less, "part").where((F.col("n") == F.col("more")) | (F.col("more") == F.col("bad"))).select("items").distinct()
    confidence = F.col("b") / F.col("n")
    better = F.col("b").cast("decimal(38,0)") * n > F.col("n").cast("decimal(38,0)") * blocked
    rules = sets.where((confidence >= min_confidence) & better).join(idle, "items", "left_anti")
    rules = rules.select(F.col("items").alias("tokens"), confidence.alias("confidence"), (F.col("b") / n).alias("support"), (confidence / (blocked / n)).alias("lift"))
    # a rule's items are frequent sets of one
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("n").alias("freq"))
    named = rules.select("tokens", F.explode("tokens").alias("item")).join(single, "item").join(items.withColumnRenamed("tokens", "like"), "item")
    named = named.groupBy("tokens").agg(F.min(F.struct("freq", "item"))["item"].alias("key"), F.array_sort(F.collect_list(F.struct("item", "like")))["like"].alias("alike"))
    rules = keep.table(rules.join(named, "tokens").select("tokens", "key", "confidence", "support", "lift", "alike"), "url-rules")
    passing.drop()
    return rules


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", fixed: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, confidence``.

    A fixed rule fits its host and the host's subdomains if the path starts with the rule's; the
    longest that fits decides, and ``rule`` names it. Otherwise the verdict is ``block`` where a mined
    rule's tokens are all in the URL (``confidence`` is the best such rule's), else ``allow``. Null
    URLs and URLs without ``://`` have empty host, path and no tokens, and so are allowed; repeated
    rows each get a row; an empty table gives none; other columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(fixed, key=lambda r: (len(r.text), r.text)):
        rule = F.when(fits(r), F.lit(r.text)).otherwise(rule)
        verdict = F.when(fits(r), F.lit(r.verdict)).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "fixed": verdict})
    # URLs that differ in numbers only share their tokens, so each token set is matched once
    sets = rows.where("fixed is null and size(tokens) > 0").select("tokens").distinct()
    keyed = sets.select("tokens", F.explode("tokens").alias("token"))
    index = rules.select("alike", "confidence", F.explode(F.col("alike")[F.array_position("tokens", F.col("key")).cast("int") - 1]).alias("token"))
    met = keyed.join(index, "token").where(F.forall("alike", lambda like: F.arrays_overlap(like, F.col("tokens"))))
    blocked = met.groupBy("tokens").agg(F.max("confidence").alias("confidence"))
    out = rows.join(blocked, "tokens", "left")
    by_method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("fixed", by_method).alias("verdict"), F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"))
