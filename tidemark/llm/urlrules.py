"""URL filters: fixed host rules, and association rules mined from the urls that those label.

Spark's FP-growth finds token combinations of labelled urls together with their label. Rules are pruned
by support and confidence, and by any rule with one token less that is as sure of the same label. They
are matched by an inverted index from token to rule, over the distinct token sets of the urls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, save

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
DEFAULT = "allow"


@dataclass(frozen=True)
class HostRule:
    """Holds for the host and its subdomains where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        inside = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return inside & F.col("path").startswith(self.path)


# The curated rules of the production filter.
RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)


def split_url(pages: DataFrame) -> DataFrame:
    """page_id, url, host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rest = F.coalesce(F.when(F.instr("url", "://") > 0, F.substring(F.col("url"), F.instr("url", "://") + 3, F.length("url"))), F.lit(""))
    return rows.select("page_id", "url", lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def fixed_rule(rules: tuple[HostRule, ...]) -> Column:
    """The longest rule that fits as struct rule, verdict; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        out = F.when(r.fits(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    """The distinct tokens of a url in order: host labels by place, path segments (digits as #), extension,
    names of query fields, and whether there is a fragment."""
    labels = F.reverse(F.filter(F.split("host", r"\."), lambda x: x != ""))
    hosts = F.transform(labels, lambda x, i: F.concat(F.when(i == 0, "t:").when(i == 1, "d:").otherwise("s:"), x))
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(lower_ascii(x), "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    fragment = F.when(F.contains(F.coalesce("url", F.lit("")), F.lit("#")), F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(hosts, segments, fields, fragment)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, tokens, verdict, confidence, support: the pruned rules of rows with _tokens and verdict.

    Without labelled rows there are no rules.
    """
    mark = "label="
    baskets = labelled.select(F.array_append("_tokens", F.concat(F.lit(mark), "verdict")).alias("items"))
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0].startswith(mark) & ~F.exists("antecedent", lambda x: x.startswith(mark)))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.expr(f"substring(consequent[0], {len(mark) + 1})").alias("verdict"), "confidence", "support")
    found = save(found)
    # A rule falls when one with a token less is as sure.
    fewer = found.select("tokens", "verdict", "confidence", F.explode("tokens").alias("_x")).withColumn("_less", F.array_remove("tokens", F.col("_x")))
    known = found.select(F.col("tokens").alias("_less"), "verdict", F.col("confidence").alias("_sure"))
    beaten = fewer.join(known, ["_less", "verdict"]).filter("_sure >= confidence").select("tokens", "verdict").distinct()
    kept = found.join(beaten, ["tokens", "verdict"], "left_anti")
    return kept.select(F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "verdict", "confidence", "support")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """_sig and verdict of the surest rule (then support, then block before allow) whose tokens a set holds."""
    index = rules.select("rule_id", F.size("tokens").alias("_size"), "verdict", "confidence", "support", F.explode("tokens").alias("_token"))
    hits = sets.select("_sig", F.explode("_tokens").alias("_token")).join(index, "_token")
    full = hits.groupBy("_sig", "rule_id", "_size", "verdict", "confidence", "support").count().filter("count = _size")
    order = F.struct("confidence", "support", (F.col("verdict") == "block").alias("b"), "rule_id")
    return full.groupBy("_sig").agg(F.max_by("verdict", order).alias("_mined"))


def judge(pages: DataFrame, rules: tuple[HostRule, ...] = RULES) -> DataFrame:
    """Per row: page_id, host, path, rule (name of the fixed rule, else null) and verdict (the rule's, else
    the mined rules', else allow).

    Repeated urls and pages are judged each. Null urls and urls without `://` have no tokens and are
    allowed. An empty table gives an empty table; extra columns are left out.
    """
    rows = split_url(pages).withColumn("_fixed", fixed_rule(rules)).withColumn("_tokens", tokens())
    rows = rows.withColumn("_sig", F.array_join("_tokens", "\n"))
    mined = save(mine(rows.filter("_fixed is not null").select("_tokens", F.col("_fixed.verdict").alias("verdict"))))
    open_sets = rows.filter("_fixed is null").select("_sig", "_tokens").distinct()
    known = save(match(open_sets, mined)).withColumnRenamed("_sig", "_s")
    out = rows.join(known, F.col("_fixed").isNull() & (F.col("_sig") == F.col("_s")), "left")
    return out.select("page_id", "host", "path", F.col("_fixed.rule").alias("rule"), F.coalesce("_fixed.verdict", "_mined", F.lit(DEFAULT)).alias("verdict"))
