"""URL filters with redirect equivalence: DataFrame operations only.

Rules name a host and a path; the longest rule that fits decides. URLs that redirect to each other or name one canonical address are
aliases: connected components over redirect and canonical-link edges. A URL without a rule of its own takes its component's decision:
blocked if a member is blocked by a rule and none is allowed by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, spill

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules that are written into the plan; longer lists are joined by host suffix.
INLINE = 64
# Tags of links and refreshes, outside comments.
TAG = r"(?i)<(?:link|meta)\b[^>]*>"
COMMENT = r"(?s)<!--.*?-->"


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address as a node: without its fragment, A-Z of scheme and host lower-cased; null without ://."""
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds rule and action from columns host and path: of the rules that fit, the longest; of equally long ones, the first by text."""
    if not isinstance(rules, DataFrame) and len(rules) <= INLINE:
        fits = [
            F.when((F.col("host") == h) | F.col("host").endswith(f".{h}"), F.when(F.col("path").startswith(p), F.struct(F.lit(-len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"))))
            for h, p, a in rules
        ]
        best = F.array_min(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size: int, rule: string, action: string>")
        return df.withColumn("_best", best).select(*df.columns, F.col("_best.rule").alias("rule"), F.col("_best.action").alias("action"))
    if not isinstance(rules, DataFrame):
        rules = df.sparkSession.createDataFrame(rules, "host string, path string, action string")
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.col("action").alias("_action"))
    keys = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = keys.withColumn("suffix", F.explode(suffixes)).join(rules, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("suffix", "rule_path")
    best = fit.groupBy("host", "path").agg(F.min(F.struct((-F.length(name)).alias("size"), name.alias("rule"), F.col("_action").alias("action"))).alias("_best"))
    return df.join(best, ["host", "path"], "left").select(*df.columns, F.col("_best.rule").alias("rule"), F.col("_best.action").alias("action"))


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes of a page and of the address that its canonical link or its refresh names."""
    url, html = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    tags = F.regexp_extract_all(F.regexp_replace(html, COMMENT, ""), F.lit(TAG), F.lit(0))
    bare = lambda c: F.trim(F.regexp_replace(c, "^[\"']|[\"']$", ""))
    value = lambda tag, name: bare(F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s>"']+))""", 1))

    def named(tag: Column) -> Column:
        """The address that a tag names, or null."""
        canonical = F.when(tag.rlike(r"(?i)^<link\b") & F.lower(value(tag, "rel")).rlike(r"(^|\s)canonical(\s|\z)"), value(tag, "href"))
        refresh = F.when(tag.rlike(r"(?i)^<meta\b") & (F.lower(value(tag, "http-equiv")) == "refresh"), bare(F.regexp_extract(value(tag, "content"), r"(?i)^[^;,]*[;,]\s*url\s*=\s*(.*)", 1)))
        return F.coalesce(canonical, refresh)

    def absolute(to: Column) -> Column:
        base = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
        folder = F.regexp_replace(F.regexp_extract(url, r"^(.*?://[^/?#]*(?:/(?:[^?#]*/)?)?)", 1), r"/\z", "")
        return (
            F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when(to.startswith("//"), F.concat(F.substring_index(url, "://", 1), F.lit(":"), to))
            .when(to.startswith("/"), F.concat(base, to))
            .when((to != "") & ~to.rlike(r"^(#|\?|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(folder, F.lit("/"), to))
        )

    # Lambdas bind each step's value, so that no expression is written out twice in the plan.
    found = F.transform(F.transform(F.transform(tags, named), absolute), node_of)
    some = html.rlike(r"(?i)\bcanonical\b|http-equiv")
    return pages.where(some & (F.locate("://", url) > 0)).select(node_of(url).alias("a"), F.explode(found).alias("b")).where("b is not null")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of_blocked for every row of pages.

    redirects: further edges, columns from_url and to_url. A null URL, or one without ://, has empty host and path, no rule and the
    default verdict; repeated rows are judged alike; a null html has no links; an empty table gives an empty result; other columns
    are not read."""
    url = F.col(f"`{url_col}`").cast("string")
    edges = links_of(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    members = connected_components(edges)
    ruled = with_rule(members.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))), rules)
    is_ = lambda a: F.max(F.coalesce(F.col("action") == a, F.lit(False)))
    groups = ruled.groupBy("component").agg(is_("block").alias("blocked"), is_("allow").alias("allowed")).where("blocked and not allowed")
    tainted = spill(members.join(groups, "component").select("node").distinct(), "url-tainted")
    rows = with_rule(pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    rows = rows.join(tainted.withColumn("alias_of_blocked", F.lit(True)), "node", "left")
    inherited = F.when(F.coalesce("alias_of_blocked", F.lit(False)), F.lit("block")).otherwise(F.lit(default))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("action", inherited).alias("verdict"), F.coalesce("alias_of_blocked", F.lit(False)).alias("alias_of_blocked"))
