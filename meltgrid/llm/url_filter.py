"""URL filters: listed rules first, then association rules that FP-growth mines from labelled URLs.

A listed rule has a host and a path.  It fits its host and all subdomains if the URL's path starts with its path; of
several the longest wins.  What no rule fits is judged by mined rules: URLs are sets of tokens (scheme, host labels,
top-level domain, path segments, names of parameters; digits are one token), FP-growth finds token sets that
frequently come with the verdict ``block``, and sets below ``min_support`` or ``min_confidence`` are pruned.  A URL
that holds a mined set is blocked, any other is allowed.

URLs are labelled by the listed rules where one fits, else by ``labels`` under the same id: block if its quality is
0 or it is toxic.  Token sets are far fewer than URLs, so equal ones are matched once: each mined rule stands in an
inverted index under its rarest token, and only sets with that token are compared with it.

Everything is DataFrame operations.  Defined results: a null URL or one without ``://`` has an empty host and path and
is allowed; several labels of one id count as their worst; labels with nulls count for nothing where null; repeated
rows are judged each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltgrid.llm.common import table
from meltgrid.session import cut_lineage

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MIN_SUPPORT = 0.001
MIN_COUNT = 10
MIN_CONFIDENCE = 0.9
BLOCK = "verdict=block"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _SMALL), F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    number = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), number(x)))
    top = F.array(F.concat(F.lit("top="), F.element_at(F.split(host, r"\."), -1)))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), number(x)))
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    names = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("name="), F.split(x, "=")[0]))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))
    found = F.array_sort(F.array_distinct(F.concat(scheme, labels, top, parts, names)))
    return F.when(F.instr(url, "://") > 0, found).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT,
               min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, confidence, support) of token sets that come with ``block``; ``labelled`` has tokens and blocked."""
    bags = cut_lineage(labelled.where(F.size("tokens") > 0).select(
        F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items")))
    rows = bags.count()
    if not rows:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / rows)),
                     minConfidence=min_confidence).fit(bags)
    rules = model.associationRules.where(F.col("consequent")[0] == BLOCK)
    return rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined, confidence) of the best rule within each distinct token set that has any."""
    often = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    index = (rules.select(F.col("tokens").alias("rule"), "confidence", F.explode("tokens").alias("token"))
             .join(often, "token").groupBy("rule").agg(F.min(F.struct("c", "token")).alias("rarest"),
                                                       F.first("confidence").alias("confidence"))
             .select("rule", "confidence", F.col("rarest.token").alias("token")))
    hits = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
            .where(F.size(F.array_except("rule", "tokens")) == 0))
    best = F.max(F.struct("confidence", (-F.size("rule")).alias("short"), F.array_join("rule", " ").alias("mined")))
    return hits.groupBy("tokens").agg(best.alias("b")).select("tokens", "b.mined", "b.confidence")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
                label_id: str = "doc_id", **mining) -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence) for every row."""
    url = F.col("_url")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = url_parts(url)
    rows = rows.select("_id", "_url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = cut_lineage(rows.select("_id", "host", "path", rule.alias("rule"), verdict.alias("listed"),
                                   url_tokens(url, F.col("host"), F.col("path")).alias("tokens")))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = (labels.where(F.col(label_id).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
             .groupBy(F.col(label_id).alias("_id")).agg(F.max(bad).alias("_bad")))
    known = rows.join(marks, "_id", "left").select(
        "tokens", F.coalesce(F.col("listed") == "block", F.col("_bad")).alias("blocked")).where("blocked IS NOT NULL")
    mined = cut_lineage(mine_rules(known, **mining))
    sets = rows.where("listed IS NULL AND size(tokens) > 0").select("tokens").distinct()
    hits = match_rules(cut_lineage(sets), mined)
    return (rows.join(hits, "tokens", "left")
            .select(F.col("_id").alias(id_col), "host", "path", "rule",
                    F.coalesce("listed", F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
                    .alias("verdict"),
                    F.when(F.col("listed").isNull(), F.col("mined")).alias("mined"),
                    F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of the whole pages table judged."""
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
