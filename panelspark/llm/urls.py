"""URL filters that hold for all aliases of a page: redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import Scratch
from panelspark.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name a way to a page, not a page.
TRACKING = r"(?:utm_[^=&#]*|ref|fbclid|gclid)"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def normal_form(url: Column) -> Column:
    """The spelling that the variants of a url share: no scheme, ``www.`` or ``m.``, fragment, tracking
    parameter, ``.html`` or final slash. Null without a host."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?(?:\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, rf"(^|&){TRACKING}(?:=[^&]*)?(?=&|$)", ""), "^&", "")
    full = F.concat(F.lit("//"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host_of(url) != "", full)


def link_targets(html: Column, url: Column) -> Column:
    """Absolute urls that the page's canonical links and refresh redirects name."""
    text = F.coalesce(html, F.lit(""))
    canonical = F.transform(F.regexp_extract_all(text, F.lit(_LINK), F.lit(0)),
                            lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.regexp_extract_all(text, F.lit(_REFRESH), F.lit(0)),
                          lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    scheme = F.regexp_extract(url, r"(?s)^(.*?):", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    absolute = F.transform(F.concat(canonical, refresh), lambda t: (
        F.when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.startswith("/"), F.concat(site, t)).otherwise(t)))
    return F.filter(absolute, lambda t: t.contains("://"))


def _rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(r).alias("rule"), F.lit(r.partition("/")[0]).alias("rule_host"),
                     F.lit(r[len(r.partition("/")[0]):]).alias("rule_path"), F.lit(v).alias("rule_verdict")) for r, v in rules]
    empty = "array<struct<rule:string,rule_host:string,rule_path:string,rule_verdict:string>>"
    listed = F.array(*rows) if rows else F.array().cast(empty)
    return spark.range(1).select(F.inline(listed))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, rule_verdict`` of the longest rule that fits each url of ``urls(url)``.

    A rule (``rule, rule_host, rule_path, rule_verdict``) fits its host and all subdomains, if the
    path starts with the rule's; of rules of one length allow goes first. Each url is looked up by
    the suffixes of its host."""
    labels = F.split(F.col("__host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    spread = (
        urls.select("url", host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"))
        .filter("__host <> ''").select("url", "__path", F.explode(suffixes).alias("rule_host"))
    )
    fits = spread.join(rules, "rule_host").filter(F.col("__path").startswith(F.col("rule_path")))
    order = F.struct(F.length("rule"), F.col("rule_verdict") == "allow", "rule", "rule_verdict")
    return fits.groupBy("url").agg(F.max(order).alias("__best")).select(
        "url", F.col("__best.rule").alias("rule"), F.col("__best.rule_verdict").alias("rule_verdict"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", html: str | None = "html",
    edges: DataFrame | None = None, spelling: bool = False,
) -> DataFrame:
    """One row per page: ``key, host, path, rule, verdict, alias_root, aliases``.

    ``rules`` are (host and path, ``allow`` or ``block``). A page with a fitting rule gets its verdict.
    The others get that of their aliases: urls are joined by canonical links and refresh redirects in
    the pages and by ``edges(a, b)`` (say, a crawler's redirects), with ``spelling`` also to their normal form
    (a guess: off unless asked for), and in each connected class an explicit allow anywhere allows, else a block anywhere blocks, else
    pages are allowed. Targets that are no pages count too. Null urls and urls without ``://`` have
    neither host nor aliases and are allowed. Repeated rows are judged alike. ``aliases`` is the
    number of urls in the class, 1 if there is none other.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    targets = link_targets(F.col(html), F.col(url)) if html else F.array().cast("array<string>")
    rows = scratch.write(pages.select(F.col(key).alias("__key"), F.col(url).alias("url"), targets.alias("__targets")), "pages")
    named = rows.filter(host_of(F.col("url")) != "")
    linked = named.select(F.col("url").alias("a"), F.explode("__targets").alias("b"))
    ends = named.select("url").union(linked.select("b"))
    if edges is not None:
        linked = linked.unionByName(edges.select(F.col("a").cast("string"), F.col("b").cast("string")).dropna())
        ends = ends.union(edges.select("a")).union(edges.select("b"))
    ends = ends.dropna().distinct()
    if spelling:
        linked = linked.unionByName(ends.select(F.col("url").alias("a"), normal_form(F.col("url")).alias("b")).dropna())
    classes = scratch.write(connected_components(linked, scratch), "classes")
    ruled = scratch.write(fitting_rules(ends, _rule_table(spark, rules)), "ruled")
    judged = classes.join(ruled.select(F.col("url").alias("node"), "rule_verdict"), "node", "left")
    verdicts = judged.groupBy("root").agg(
        F.max(F.when(F.col("rule_verdict") == "allow", 2).when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("__told"),
        F.sum(F.when(F.col("node").contains("://"), 1).otherwise(0)).alias("aliases"),
    )
    by_url = classes.select(F.col("node").alias("url"), "root").join(verdicts, "root")
    by_url = ends.join(ruled, "url", "left").join(by_url, "url", "left")
    told = rows.select("__key", "url").join(by_url, "url", "left")
    passed_on = F.when(F.col("__told") == 1, "block").otherwise("allow")
    return told.select(
        F.col("__key").alias(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("rule_verdict", passed_on).alias("verdict"), F.coalesce("root", "url").alias("alias_root"),
        F.greatest(F.coalesce("aliases", F.lit(1)), F.lit(1)).cast("long").alias("aliases"),
    )
