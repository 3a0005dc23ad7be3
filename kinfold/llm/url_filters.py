"""URL filters with redirect equivalence: a block reaches all aliases of a blocked URL.

Redirects (meta refresh) and canonical links of pages are edges between URLs. Pages without a rule of their own are
blocked if any URL in their connected component is; a rule of their own, an explicit allow above all, comes first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Fixed patterns: the tags that say where a page really is.
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?[^>\"']*?\burl\s*=\s*['\"]?()()([^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(verdict, host, f"/{path}")

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. rules is a configured list, part of the plan."""
    when = lambda r: ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
    value = lambda r: F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict, r.text))
    return reduce(lambda rest, r: F.when(when(r), value(r)).otherwise(rest), reversed(ordered), F.lit(None).cast("struct<rule:string,verdict:string>"))


def absolute(base: Column, link: Column) -> Column:
    """A link of the page at base as a URL; null where it names none."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    link = F.trim(link)
    return (
        F.when(link.isNull() | (link == "") | (root == ""), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#)"), None)
        .otherwise(F.concat(F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder), link))
    )


def identity(url: Column) -> Column:
    """A URL as a node: no fragment, host and scheme in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1))


def edges_of(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Distinct edges (from, to) between URLs: every canonical link and refresh of a page; `&amp;` in a link is `&`."""
    target = lambda tag, p: F.coalesce(*(F.nullif(F.regexp_extract(tag, p, k), F.lit("")) for k in (1, 2, 3)))
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<(?:link|meta)\b[^>]*"), F.lit(0))
    links = F.transform(tags, lambda tag: F.regexp_replace(F.coalesce(target(tag, CANONICAL), target(tag, REFRESH)), r"(?i)&(?:amp|#38|#x26);", "&"))
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    rows = rows.select("url", F.explode(links).alias("link")).where("link is not null")
    return rows.select(identity(F.col("url")).alias("from"), identity(absolute(F.col("url"), F.col("link"))).alias("to")).where("`from` is not null and `to` is not null").distinct()


def judge(pages: DataFrame, rules: list[Rule], row_id: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """row_id, host, path, rule, verdict of each page; redirects may give more edges (from, to).

    A null URL, or one without `://`, has empty host and path: no rule fits and the verdict is allow. Null html has no links.
    Repeated rows get equal verdicts. Other columns play no part. An empty table gives an empty table. Nodes are the URLs
    themselves, so no two are confused; only URLs of edges are nodes.
    """
    edges = edges_of(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(identity(F.col("from")), identity(F.col("to")))).where("`from` is not null and `to` is not null").distinct()
    edges = store(edges, "edges")
    out = pages.select(F.col(row_id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), identity(F.col(url)).alias("node"))
    out = out.withColumn("match", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():  # no page is an alias of another URL
        verdict = F.coalesce("match.verdict", F.lit("allow"))
        return out.select(row_id, "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"))
    parts = store(connected_components(edges.select(F.col("from").alias("u"), F.col("to").alias("v"))), "parts")
    urls = edges.select(F.col("from").alias("u")).union(edges.select("to")).distinct()
    blocked = urls.withColumn("match", rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)).where("match.verdict = 'block'").select(F.col("u").alias("node"))
    bad = parts.join(parts.join(blocked, "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node").distinct()
    out = out.join(bad.withColumn("alias_blocked", F.lit(True)), "node", "left")
    verdict = F.coalesce("match.verdict", F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return out.select(row_id, "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"))
