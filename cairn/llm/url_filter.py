"""URL filter with redirect equivalence.

Allow and block rules judge an address by host and path.  Addresses are further linked by the redirects and
canonical links of their pages; distributed connected components over these links carry a block to all
aliases.  An address with a rule of its own keeps it, so that an explicit allow takes precedence over a
block that reaches it from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import connected_components, is_small, staged, unstage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 100_000
#: Rules of the contract: (verdict, rule), a rule being a host and the path from its first slash.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


#: What follows the first ://: authority, path, and query with its question mark.
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def address(url):
    """(host, path, query) columns of an url; all empty without ://."""
    host, path, query = (F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit("")) for i in (1, 2, 3))
    return F.translate(host, _UPPER, _LOWER), path, query


#: What holds no tags of the page itself, and the tags that matter; a tag ends at its first >.
_HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style|template|textarea)\b.*?(?:</\1\s*>|$)"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
#: The address of a refresh, behind its number of seconds.
_REFRESH = r"""(?is)^\s*\d+(?:\.\d*)?(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?["']?\s*([^"']*)"""


def _attribute(tag, name: str):
    """Value of a tag's first attribute of this name; null without one."""
    parts = F.arrays_zip(*(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3, 4)))
    own = F.get(F.filter(parts, lambda x: F.lower(x["g1"]) == name), 0)
    return F.replace(F.trim(F.concat(own["g2"], own["g3"], own["g4"])), F.lit("&amp;"), F.lit("&"))


def plain_path(path):
    """A path without its dot segments; an empty one is the root."""
    parts = F.split(path, "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    end = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path == "", "/").when(path.contains("/."), F.concat(F.array_join(kept, "/"), end)).otherwise(path)


def _resolved(href, scheme, host, path):
    """Address of href on a page; null for other schemes and mere fragments."""
    start = F.concat(scheme, F.lit("://"), host)
    full = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
    full = full.when(href.startswith("/"), F.concat(start, href)).when(href.startswith("?"), F.concat(start, path, href))
    folder = F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), r"^.*/", 0)
    return full.when((href != "") & ~href.rlike(r"^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.concat(start, folder, href))


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical links and refreshes in html, resolved against the page or its base."""
    own = F.regexp_replace("html", _HIDDEN, " ")
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|refresh")).select("url", own.alias("html"))
    scheme = F.regexp_extract("url", r"^[^:/?#]*", 0)
    host, path, _ = address(F.col("url"))
    base = _resolved(_attribute(F.regexp_extract("html", r"(?is)<base\b[^>]*>", 0), "href"), scheme, host, path)
    tags = F.filter(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0)), lambda t: t.rlike(r"(?i)canonical|refresh"))
    some = some.select("url", F.coalesce(base, "url").alias("base"), F.explode(tags).alias("tag"))
    link, tag = F.lower(F.substring("tag", 1, 5)) == "<link", F.col("tag")
    canonical = link & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = ~link & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    href = F.when(canonical, _attribute(tag, "href")).when(refresh, F.trim(F.regexp_extract(_attribute(tag, "content"), _REFRESH, 1)))
    found = some.select("url", "base", href.alias("href")).where("href <> ''")
    host, path, _ = address(F.col("base"))
    found = found.withColumns({"scheme": F.regexp_extract("base", r"^[^:/?#]*", 0), "host": host, "path": path})
    full = _resolved(F.col("href"), F.col("scheme"), F.col("host"), F.col("path"))
    host, path, query = address(F.col("full"))
    plain = F.concat(F.regexp_extract("full", r"^[^:/?#]*", 0), F.lit("://"), host, plain_path(path), query)
    return found.select("url", full.alias("full")).where("full is not null").select("url", plain.alias("target"))


def node(url):
    """What tells addresses apart: host, path without dot segments and query; neither scheme nor fragment."""
    host, path, query = address(url)
    return F.concat(host, plain_path(path), query)


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses (host, path) with the longest rule (rule, rule_verdict) that fits, for those that have one.

    Each host meets the rules of itself and of the domains above it by an equi-join.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = rules.select(F.col("host").alias("domain"), F.col("path").alias("start"), "rule", "verdict")
    own = F.broadcast(own) if is_small(own, BROADCAST_ROWS) else own
    met = addresses.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("domain")).join(own, "domain").where(F.col("path").startswith(F.col("start")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    return met.groupBy("host", "path").agg(best).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def rule_table(spark, rules: Iterable[tuple[str, str]]) -> DataFrame:
    rows = [(v, r, *(r.split("/", 1)[0], "/" + r.split("/", 1)[1])) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict, alias_blocked.

    The longest fitting rule decides, of equally long ones the last in order.  Without one a page is blocked if an
    address that a block rule fits can be reached from its own over canonical links and refreshes, in either
    direction, and allowed otherwise.  A null url, or one without ://, has an empty host and path, no rule and no
    links; a null html has no links, and one of any length is read whole.  Repeated rows are judged alike.  No row
    gives no row.  Other columns are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    usable = F.instr(F.col("url"), "://") > 0
    found = staged(links(pages), "url-found")
    (host, path, _), (own_host, own_path, _) = address(F.col("target")), address(F.col("url"))
    edges = found.select(node(F.col("url")).alias("u"), node(F.col("target")).alias("v"), host.alias("host"), path.alias("path"), own_host.alias("own_host"), own_path.alias("own_path"))
    edges = staged(edges.where("u <> '' and v <> '' and u <> v"), "url-links")
    host, path, _ = address(F.col("url"))
    rows = staged(pages.select("page_id", host.alias("host"), path.alias("path"), F.when(usable, node(F.col("url"))).alias("node")), "url-pages")
    known = rows.select("host", "path").union(edges.select("host", "path")).where("host <> ''").distinct()
    fitted = staged(ruled(known, rules), "url-ruled")
    if edges.isEmpty():
        blocked = rows.select("node", F.lit(True).alias("alias_blocked")).limit(0)
    else:
        named = staged(connected_components(edges, "u", "v", "url-cc"), "url-components")
        ends = edges.select(F.col("v").alias("node"), "host", "path").union(edges.select("u", "own_host", "own_path")).distinct()
        bad = ends.join(fitted.where("rule_verdict = 'block'"), ["host", "path"], "left_semi").join(named, "node").select("component").distinct()
        blocked = named.join(staged(bad, "url-blocked"), "component", "left_semi").select("node", F.lit(True).alias("alias_blocked"))
        blocked = staged(blocked, "url-aliases")
    out = rows.join(fitted, ["host", "path"], "left").join(blocked, "node", "left")
    alias = F.coalesce("alias_blocked", F.lit(False))
    unstage(found, edges)
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("alias_blocked"))
