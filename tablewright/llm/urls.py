"""URL filter: explicit rules first, then a path-template tree per host.

The tree is built level by level on counts: a segment that enough urls of its node have stays, any other is generalised
to a wildcard of its shape ({n} digits, {x} hexadecimal, {s} other, with the file extension). The tree is as deep as the
longest path; a level carries only urls that still have a segment. Once no node has enough urls for a segment of its own,
no deeper one has, and what is left of the paths takes its shapes at once. Urls that a rule decides are the labelled samples. Sibling branches that differ in one segment are merged
unless their labelled share of blocked urls differs significantly from that of their family. A template is rejected if
its blocked share, smoothed towards the share of all labelled urls, is high enough; one without labelled urls is allowed and
has no share.

NULL urls and urls without ``://`` have an empty host and path, which no rule fits, so they are allowed. Repeated urls count as often as they occur. All steps are
groupings with map-side sums and joins on (host, prefix, segment) whose right side has one row per key, so a host with a
third of all urls is split like any other skewed join key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tables import ascii_lower, stored

Rule = tuple[str, str, str]  # (allow or block, host, path)


@dataclass(frozen=True)
class UrlOptions:
    min_support: int = 5
    min_share: float = 0.02
    similar_z: float = 1.96
    prior_weight: float = 4.0
    reject_share: float = 0.5


def with_host_path(pages: DataFrame, url_col="url") -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path."""
    url = F.coalesce(url_col, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return pages.withColumns({"host": ascii_lower(raw), "path": path})


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one text) and its verdict; NULL without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    stem = F.regexp_replace(segment, "\\.[A-Za-z0-9]{1,5}$", "")
    kind = F.when(stem.rlike("^[0-9]+$"), "{n}").when(stem.rlike("^[0-9a-fA-F-]{8,}$"), "{x}").when(stem == "", "").otherwise("{s}")
    return F.concat(kind, F.regexp_extract(segment, "\\.[A-Za-z0-9]{1,5}$", 0))


def with_templates(urls: DataFrame, options: UrlOptions) -> DataFrame:
    """``urls`` (host, path, ...) with ``template`` and ``family`` (the template with its first fixed segment open)."""
    rows = urls.withColumns({"_seg": F.split("path", "/"), "template": F.lit(""), "family": F.lit(""), "_open": F.lit(False)})
    done, level = [], 1
    while True:
        done.append(rows.where(F.size("_seg") <= level))
        rows = rows.where(F.size("_seg") > level).withColumn("_s", F.get("_seg", F.lit(level)))
        counts = rows.groupBy("host", "template", "_s").agg(F.count("*").alias("n"))
        nodes = counts.groupBy("host", "template").agg(F.sum("n").alias("total"))
        if (nodes.agg(F.max("total")).first()[0] or 0) < max(1, options.min_support):
            rest = F.array_join(F.transform(F.slice("_seg", level + 1, F.size("_seg")), lambda x: F.concat(F.lit("/"), _shape(x))), "")
            done.append(rows.drop("_s").withColumns({"template": F.concat("template", rest), "family": F.concat("family", rest)}))
            break
        fixed = counts.where(F.col("n") >= options.min_support).join(nodes, ["host", "template"]).where((F.col("n") >= F.col("total") * options.min_share) & (_shape(F.col("_s")).startswith("{s}")))
        rows = rows.join(fixed.select("host", "template", "_s", F.lit(True).alias("_fixed")), ["host", "template", "_s"], "left")
        stays = F.col("_fixed").isNotNull()
        name = F.when(stays, F.col("_s")).otherwise(_shape(F.col("_s")))
        rows = stored(rows.withColumns({
            "family": F.concat("family", F.lit("/"), F.when(stays & ~F.col("_open"), "*").otherwise(name)),
            "template": F.concat("template", F.lit("/"), name),
            "_open": F.col("_open") | stays,
        }).drop("_fixed", "_s"), "urls")
        level += 1
    return reduce(DataFrame.unionByName, done).drop("_seg", "_open")


def judge_urls(pages: DataFrame, rules: list[Rule], options: UrlOptions | None = None, id_col="page_id", url_col="url") -> DataFrame:
    """(id, host, path, rule, verdict, template, blocked_share) of every row of ``pages``."""
    o = options or UrlOptions()
    rule, verdict = rule_columns(rules)
    urls = with_host_path(pages.select(F.col(id_col), F.col(url_col).alias("_url")), "_url").drop("_url")
    urls = stored(with_templates(urls.withColumns({"rule": rule, "said": verdict}), o), "templates")
    blocked, labelled = F.sum((F.col("said") == "block").cast("long")), F.count("said")
    branches = urls.groupBy("host", "family", "template").agg(F.coalesce(blocked, F.lit(0)).alias("b"), labelled.alias("l"))
    everything = branches.agg(F.sum("b").alias("b"), F.sum("l").alias("l")).first()
    prior = (everything["b"] or 0) / everything["l"] if everything["l"] else 0.0
    families = branches.groupBy("host", "family").agg(F.sum("b").alias("fb"), F.sum("l").alias("fl"))
    p = F.when(F.col("fl") > 0, F.col("fb") / F.col("fl")).otherwise(0.0)
    spread = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) / F.greatest("l", F.lit(1)))
    apart = (F.col("l") > 0) & (F.abs(F.col("b") / F.greatest("l", F.lit(1)) - p) / spread > o.similar_z)
    named = stored(branches.join(families, ["host", "family"]).withColumn("merged", F.when(apart, F.col("template")).otherwise(F.col("family"))), "branches")
    share = (F.sum("b") + o.prior_weight * prior) / (F.sum("l") + o.prior_weight)
    # what no label has been seen of is not rejected
    purity = named.groupBy("host", "merged").agg(F.when(F.sum("l") > 0, share).alias("blocked_share"))
    known = named.select("host", "template", "family", "merged").join(purity, ["host", "merged"]).select("host", "template", "family", F.col("merged"), "blocked_share")
    judged = urls.join(known, ["host", "template", "family"], "left")
    method = F.when(F.col("blocked_share") >= o.reject_share, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), F.col("merged").alias("template"), "blocked_share")
