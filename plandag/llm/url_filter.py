"""URL filter: fixed rules first, then association rules mined from the URLs that the fixed rules judge. DataFrame and ML operations only.

Each judged URL is a basket of tokens (scheme, host labels, path segments, extension, query keys; digits become 0) and its verdict.
FP-growth finds the frequent baskets; rules whose consequent is a verdict stay from MIN_SUPPORT and MIN_CONFIDENCE on, unless a rule
with fewer tokens for the same verdict is as confident. Rules are looked up by their rarest token, and hold if the URL has all the others.
Of the rules that hold the most confident decides (then support, then block before allow); a URL without any is allowed.

Frequent baskets are exponentially many in the tokens that occur together, so what can't change the rules is taken out first, exactly:
- Tokens that the very same judged URLs have become one item. Of such tokens, a shorter rule needs one only, whichever it is: an item holds if the
  URL has any of its tokens.
- Tokens whose judged URLs all have one verdict are rules by themselves, of confidence 1. No longer rule with them can be more confident.
So long URLs that share their tokens make no more baskets than short ones.

Null URLs and such without :// have an empty host and path; no fixed rule fits them. Long URLs are taken whole. Rows that repeat a page_id are judged
one by one. No pages: no rows. Columns besides page_id and url are left aside, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plandag.llm.licenses import lower_ascii
from plandag.llm.shared import materialize

#: Rules of the contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
VERDICTS = ["verdict=allow", "verdict=block"]
NO_TOKENS = "array<string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule: str) -> Column:
    own, _, prefix = rule.partition("/")
    return ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{prefix}")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct and not null."""
    some = lambda a: F.coalesce(a, F.array().cast(NO_TOKENS))
    split = lambda text, by: F.filter(F.split(text, by), lambda x: x != "")
    parts = lambda text, by, tag: F.transform(split(text, by), lambda x: F.concat(F.lit(tag), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.transform(split(F.regexp_extract(url, "[?]([^#]*)", 1), "&"), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    scheme = F.concat(F.lit("scheme="), F.substring_index(url, "://", 1))
    extension = F.when(F.regexp_like(path, F.lit("[.][a-z0-9]+$")), F.concat(F.lit("ends="), F.substring_index(path, ".", -1)))
    ends = F.array_compact(F.array(scheme, F.when(url.contains("#"), F.lit("fragment")), extension))
    ends = F.when(host != "", some(ends)).otherwise(F.array().cast(NO_TOKENS))
    return F.array_distinct(F.concat(some(parts(host, "[.]", "host=")), some(parts(path, "/", "path=")), some(query), ends))


def items_of(judged: DataFrame, least: int) -> DataFrame:
    """judged: (row, tokens, verdict). (item, members, n, blocked): tokens of `least` or more judged URLs, one item for all that the same URLs have. A URL has few tokens, so there are at
    most 1 / MIN_SUPPORT times as many items."""
    spread = judged.select("row", "verdict", F.explode("tokens").alias("token"))
    which = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]  # stands for the set of URLs
    counts = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), *which).where(F.col("n") >= least)
    return counts.groupBy("n", "blocked", "s1", "s2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")).drop("s1", "s2")


def mine(judged: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """judged: (tokens, verdict). Rules as (antecedent: items, each the tokens of which one is needed; verdict, confidence, support, rarest: an item's tokens)."""
    judged = materialize(judged.select("tokens", "verdict", F.monotonically_increasing_id().alias("row")), "judged-urls")
    n = judged.count()
    least = max(1, math.ceil(min_support * n - 1e-9))
    items = materialize(items_of(judged, least), "url-items")
    pure = (F.col("blocked") == 0) | (F.col("blocked") == F.col("n"))
    alone = F.array("members").alias("antecedent"), F.when(F.col("blocked") == 0, "allow").otherwise("block").alias("verdict")
    single = items.where(pure).select(*alone, F.lit(1.0).alias("confidence"), (F.col("n") / F.lit(n)).alias("support"), F.col("members").alias("rarest"))

    # Only mixed items go into the baskets; a basket without any still counts.
    names = items.where(~pure).select("item", F.explode("members").alias("token"))
    held = judged.select("row", F.explode("tokens").alias("token")).join(names, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    named = F.array(F.concat(F.lit("verdict="), "verdict"))
    baskets = judged.select("row", "verdict").join(held, "row", "left").select(F.when(F.col("items").isNull(), named).otherwise(F.concat("items", named)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].isin(VERDICTS))
    verdict = F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict")
    rules = materialize(rules.select(F.array_sort("antecedent").alias("items"), verdict, "confidence", "support"), "url-rules")
    # A longer rule goes if dropping one of its items leaves a rule for the same verdict that is as confident.
    spread = rules.select("*", F.explode("items").alias("item"))
    shorter = rules.select(F.col("items").alias("less"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    cut = spread.withColumn("less", F.array_except("items", F.array("item")))
    as_good = (cut["less"] == shorter["less"]) & (cut["verdict"] == shorter["same"]) & (shorter["sure"] >= cut["confidence"])
    worse = cut.join(shorter, as_good).select("items", "verdict").distinct()
    kept = spread.join(worse, ["items", "verdict"], "left_anti").join(items.select("item", "members", "n"), "item")
    fewest = F.min(F.struct("n", "members"))["members"].alias("rarest")
    kept = kept.groupBy("items", "verdict", "confidence", "support").agg(F.collect_list("members").alias("antecedent"), fewest)
    return materialize(kept.select("antecedent", "verdict", "confidence", "support", "rarest").unionByName(single), "url-index")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, confidence (of the mined rule that decided, else null). rules: a short list."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    longest = sorted(rules, key=lambda r: -len(r[0]))
    rule = F.coalesce(*[F.when(fits(host, path, r), F.lit(r)) for r, _ in longest])
    verdict = F.coalesce(*[F.when(fits(host, path, r), F.lit(v)) for r, v in longest])
    df = materialize(df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), tokens(F.col("url"), host, path).alias("tokens"), F.monotonically_increasing_id().alias("row")), "urls")
    judged = df.where(F.col("verdict").isNotNull())
    if judged.isEmpty():
        return df.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("confidence"))
    index = mine(judged)
    open_rows = df.where(F.col("verdict").isNull()).select("row", "tokens")
    index = index.select("antecedent", F.col("verdict").alias("mined"), "confidence", "support", F.explode("rarest").alias("token"))
    met = open_rows.select("*", F.explode("tokens").alias("token")).join(index, "token")
    met = met.where(F.forall("antecedent", lambda any_of: F.arrays_overlap(any_of, F.col("tokens"))))
    decided = met.groupBy("row").agg(F.max(F.struct("confidence", "support", "mined")).alias("best"))
    out = df.join(decided, "row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "best.mined", F.lit("allow")).alias("verdict"), F.when(F.col("verdict").isNull(), F.col("best.confidence")).alias("confidence"))
