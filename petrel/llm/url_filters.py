"""URL filters with redirect equivalence, in DataFrame operations only.

Rules name a host (and so its subdomains) and a path prefix; the longest that fits
decides.  Pages that redirect to each other or name each other as canonical are aliases:
a block of one address blocks the aliases that no rule names.  An explicit allow always
stands for the page it fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z in lower case; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """Address of a page in the graph: host, path and query; scheme and fragment don't matter. Null for no address."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    name = verdict = None
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _no_dots(url: Column) -> Column:
    """A url whose path has its ``.`` and ``..`` segments resolved; ``..`` at the root is dropped, query and fragment stay."""
    origin, path = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0), F.regexp_extract(url, r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    keep = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    # a last dot segment names a folder, so the path ends with a slash
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(keep, F.array(F.lit("")))).otherwise(keep)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(origin, F.lit("/"), F.array_join(closed, "/"), rest)).otherwise(url)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst`` urls of canonical links and client redirects in the markup (comments left out).

    Relative targets are resolved against the page, with their dot segments; an empty or fragment-only target is no link.
    """
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    bare = lambda c: F.trim(F.regexp_replace(c, r"^[\"']|[\"']$", ""))
    markup = F.when(F.col(html).rlike(r"(?i)canonical|http-equiv"), F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", ""))
    tags = pages.select(F.col(url).alias("src"), F.explode(F.regexp_extract_all(markup, F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)).alias("tag"))
    canonical = F.lower("tag").startswith("<link") & F.array_contains(F.split(F.lower(bare(attr(F.col("tag"), "rel"))), r"\s+"), "canonical")
    refresh = F.lower("tag").startswith("<meta") & (F.lower(bare(attr(F.col("tag"), "http-equiv"))) == "refresh")
    to_url = bare(F.regexp_extract(bare(attr(F.col("tag"), "content")), r"(?is)url\s*=\s*(.*)$", 1))
    href = F.regexp_replace(F.when(canonical, bare(attr(F.col("tag"), "href"))).when(refresh, to_url), "&amp;", "&")
    # explode keeps the optimiser from repeating the extraction in each use of its result
    links = tags.select("src", F.explode(F.array(href)).alias("href")).where("href is not null and href <> '' and href not like '#%'")
    origin = F.regexp_extract("src", r"^[^/?#]*://[^/?#]*", 0)
    no_query = F.regexp_extract("src", r"^[^?#]*", 0)
    target = (
        F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href"))
        .when(F.col("href").startswith("/"), F.concat(origin, "href"))
        .when(F.col("href").startswith("?"), F.concat(no_query, "href"))
        .otherwise(F.concat(F.when(path_of(F.col("src")) == "", F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(no_query, r"[^/]*$", "")), "href"))
    )
    return links.select("src", target.alias("dst")).select("src", _no_dots(F.col("dst")).alias("dst"))


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, inherited`` of every page.

    Edges are the canonical links and client redirects in ``html`` and the rows of
    ``redirects`` (``src, dst`` urls, of HTTP redirects say).  Components of that graph may
    run through addresses that are no page.  A component with an address that a rule blocks
    blocks every page in it that has no rule; ``inherited`` tells those.  Others are allowed.

    Null urls and urls without ``://`` have an empty host and path, fit no rule and have no
    aliases.  Null html has no links.  Repeated rows and urls each get the same verdict.
    Empty table: no rows.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    edges = links.select(url_key(F.col("src")).alias("a"), url_key(F.col("dst")).alias("b")).where("a is not null and b is not null and a <> b")
    nodes = connected_components(edges, "a", "b")
    at = lambda c: (F.regexp_extract(c, r"^[^/?#]*", 0), F.regexp_extract(c, r"^[^/?#]*([^?#]*)", 1))
    verdict = rule_of(*at(F.col("node")), rules)[1]
    blocked = nodes.groupBy("component").agg(F.bool_or(F.coalesce(verdict == "block", F.lit(False))).alias("hit")).where("hit").select("component")
    keys = nodes.join(blocked, "component", "left_semi").select(F.col("node").alias("_key"), F.lit(True).alias("_hit"))
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url_key(url).alias("_key"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "_said": said}).join(keys, "_key", "left")
    inherited = F.col("_said").isNull() & F.coalesce("_hit", F.lit(False))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(inherited, "block").otherwise("allow")).alias("verdict"), inherited.alias("inherited"))
