"""URL filter: fixed host and path rules, then association rules mined from labels.

Frequent combinations of URL tokens that go with blocked pages are mined by
Spark's FP-growth; single tokens below its support, of which there may be many,
are counted by an aggregate.  Rules that pass the support and confidence bounds
are found for each URL through an inverted index on their rarest token.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "@block"            # the label as an item; URL tokens never start with @


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: words of the host (h:), of the path (p:) and of
    the query or fragment (q:); digits become one ``#``, so tokens are shapes
    and words, not single page numbers.  A word of more than 64 characters is
    its SHA-256 behind ``~``, so that long words stay apart."""
    def words(text: Column, mark: str) -> Column:
        shaped = F.regexp_replace(F.lower(text), r"[0-9]+", "#")
        parts = F.filter(F.split(shaped, r"[^\p{L}#]+"), lambda w: w != "")
        return F.transform(parts, lambda w: F.concat(F.lit(mark), F.when(
            F.length(w) > 64, F.concat(F.lit("~"), F.sha2(w, 256))).otherwise(w)))
    rest = F.coalesce(F.regexp_extract(url, r"://[^?#]*([?#](?s:.*))", 1), F.lit(""))
    return F.array_sort(F.array_distinct(F.concat(
        words(url_host(url), "h:"), words(url_path(url), "p:"), words(rest, "q:"))))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (host, path, verdict) that
    fits: its host or a subdomain, and a path that starts with the rule's.
    ``rules`` is a list in the job's code; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):      # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.5,
               z: float = 3.0, min_pages: int = 20) -> DataFrame:
    """Token combinations that imply a blocked page: (tokens, confidence, support, anchor).

    ``labelled`` has url and block (boolean); rows with a null in either are
    left out.  All labelled rows are mined.  A rule must have the support and
    the confidence asked for, and its confidence must exceed the share of
    blocked pages also at its lower Wilson bound (``z`` deviations), which
    drops rules that few pages support by chance.  The number of these rules is
    bounded by the support threshold, not by the input.

    A token on fewer blocked pages than that support is a rule by itself from
    ``min_pages`` blocked pages on, however many rows there are, by the same
    confidence and with more deviations the more tokens are tried: sqrt(2 ln m)
    of them keep the rules that m tokens give by chance below one in all.
    These rules grow with the input and stay a distributed table.

    ``anchor`` is the rule's rarest token.  No labelled rows: no rules.
    """
    spark = labelled.sparkSession
    items = (labelled.where("url is not null and block is not null")
             .select(F.concat(url_tokens(F.col("url")),
                              F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>")))
                     .alias("items")))
    items = materialize(items, "url-items")
    empty = spark.createDataFrame([], "tokens array<string>, confidence double, support double, anchor string")
    n, blocked = items.agg(F.count(F.lit(1)), F.count_if(F.array_contains("items", BLOCK))).first()
    if n == 0:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence,
                     numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(items)

    def lower(z: float) -> Column:
        c, seen = F.col("confidence"), F.col("support") * n / F.col("confidence")     # pages with the rule's tokens
        return ((c + z * z / (2 * seen) - z * F.sqrt(c * (1 - c) / seen + z * z / (4 * seen * seen)))
                / (1 + z * z / seen))
    rules = materialize(
        model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).where(lower(z) > blocked / n)
        .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "url-rules")
    counts = materialize(
        items.select(F.explode("items").alias("token"), F.array_contains("items", BLOCK).alias("bad"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.count_if("bad").alias("bad")), "url-tokens")
    mined = (rules.select("*", F.explode("tokens").alias("token")).join(counts, "token")
             .groupBy("tokens", "confidence", "support")
             .agg(F.min(F.struct("count", "token")).alias("a"))
             .select("tokens", "confidence", "support", F.col("a.token").alias("anchor")))
    rare = counts.where((F.col("token") != BLOCK) & (F.col("bad") >= min_pages) & (F.col("bad") < math.ceil(min_support * n)))
    tried = rare.count()
    if tried == 0:
        return mined
    single = (rare.select(F.array("token").alias("tokens"), (F.col("bad") / F.col("count")).alias("confidence"),
                          (F.col("bad") / n).alias("support"), F.col("token").alias("anchor"))
              .where((F.col("confidence") >= min_confidence) & (lower(max(z, math.sqrt(2 * math.log(tried)))) > blocked / n)))
    return mined.unionByName(single)


def match_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule for each distinct token set: (tokens, matched, confidence).

    A token set is looked up under each of its tokens; a rule is listed under
    its rarest token only, so common tokens bring few candidates.  Best:
    highest confidence, then support, then the tokens in order.
    """
    index = rules.select("anchor", F.col("tokens").alias("rule_tokens"), "confidence", "support")
    found = (tokens.select("tokens", F.explode("tokens").alias("anchor")).join(index, "anchor")
             .where(F.size(F.array_except("rule_tokens", "tokens")) == 0))
    return (found.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "rule_tokens")).alias("r"))
            .select("tokens", F.col("r.rule_tokens").alias("matched"), F.col("r.confidence").alias("confidence")))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]],
               min_support: float = 0.005, min_confidence: float = 0.5, min_pages: int = 20,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every row: the longest listed rule, else block where a mined
    rule fits, else allow.

    Returns page_id, host, path, rule (null without a listed one), verdict,
    matched (tokens of the mined rule, null without one) and confidence.  A null
    url or one without ``://`` has empty host and path, no tokens and the
    verdict allow.  Repeated rows stay; other columns are ignored.  Mined rules
    are matched once for each distinct token set, not for each URL.
    """
    url = F.col("url")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    rows = rows.withColumn("tokens", F.coalesce(url_tokens(url), F.array().cast("array<string>")))
    hits = match_rules(rows.select("tokens").distinct(), mine_rules(
        labelled, min_support, min_confidence, min_pages=min_pages))
    rows = rows.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), "tokens")
    rule, listed = listed_rule(F.col("host"), F.col("path"), rules)
    return (rows.join(hits, "tokens", "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(listed, F.when(F.col("matched").isNotNull(), F.lit("block")),
                               F.lit("allow")).alias("verdict"), "matched", "confidence"))
