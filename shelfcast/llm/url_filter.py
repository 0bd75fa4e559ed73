"""URL filters with redirect equivalence.

Rules (host, path prefix, allow or block) judge an address by the longest rule that fits: its host or a parent domain,
and the start of its path. An address without a rule of its own takes the decision of its aliases: addresses connected by
redirects (a refresh in the page's head), by canonical links, or by having the same canonical form (scheme, ``www.``,
fragment, tracking parameters and closing slash aside). Components of that graph are found by distributed connected
components. Explicit allow comes first: an alias that a rule allows keeps the others open; else one that a rule blocks
closes them; else they are allowed.

The rule set is part of the query, a handful of literals. NULL addresses and addresses without ``://`` have empty host
and path, fit no rule, have no aliases and are allowed. Repeated addresses are judged alike. An empty table gives an
empty result. Columns besides id, address and page are not read; all of them may be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.components import components

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Query parameters that do not change the page (fixed values).
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
#: The attribute ``rel`` with the word ``canonical`` in its list.
CANONICAL = r"""(?i)\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?=[\s/>]))"""


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict); NULL if none. Of equally long ones the first in order of rule."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for domain, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def canonical_form(url: Column) -> Column:
    """host and path without ``www.`` and closing slashes, and the query without tracking parameters; NULL if no ``://``."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")), "&")
    form = F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), form)


def _without_dots(path: Column) -> Column:
    """``path`` without ``.`` and ``..`` segments; a path that ends in one ends in ``/``."""
    steps = F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)

    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))

    walked = F.array_join(F.aggregate(F.split(steps, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(walked.startswith("/"), walked).otherwise(F.concat(F.lit("/"), walked))


def resolved(target: Column, page: Column) -> Column:
    """The absolute address that ``target``, as written in the page at address ``page``, stands for.

    Targets with ``scheme://`` are absolute; ``//host``, ``/path``, ``?query`` and plain paths are taken from the page's address.
    NULL for fragments and empty targets, which are the page itself, for other schemes (``mailto:``), and for relative targets
    of a page whose address has no ``://``. A ``base`` tag is not read.
    """
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    scheme = F.regexp_extract(page, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(page), r"(?s)^(.*/)", 1)
    path = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | target.startswith("#") | (target == "") | (site == ""), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(own == "", F.concat(site, path_of(page), rest))
        .otherwise(F.concat(site, _without_dots(path), rest))
    )


def linked_addresses(html: Column, page: Column) -> Column:
    """Absolute addresses of canonical links and refresh redirects in the page at address ``page``, as an array; empty for NULL.

    Only tags that hold both parts count, however long they are; a tag that never ends is none. Entities in addresses are not decoded except ``&amp;``.
    """
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:link|meta)\b[^>]*+(?:>|\z)"), F.lit(0))
    tags = F.filter(tags, lambda t: t.endswith(">"))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<link\b") & t.rlike(CANONICAL)),
                            lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""")),
                          lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    found = F.transform(F.concat(canonical, refresh), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.array_compact(F.transform(found, lambda u: resolved(u, F.coalesce(page, F.lit("")))))


def alias_edges(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """src, dst: each address, also those that pages point to, with its canonical form, and each page with its targets' forms."""
    here = F.col(url).alias("src")
    rows = pages.filter(F.col(url).contains("://"))
    ties = rows.select(here, F.col(url).alias("to"))
    if html is not None:
        links = rows.select(here, F.explode(linked_addresses(F.col(html), F.col(url))).alias("to"))
        ties = ties.union(links).union(links.select("to", "to"))
    return ties.select("src", F.concat(F.lit("form://"), canonical_form(F.col("to"))).alias("dst")).distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url: str = "url", html: str | None = "html",
          more_edges: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule and verdict of every row. ``more_edges``: src, dst of known redirects (a crawl's log), if any."""
    edges = alias_edges(pages, url, html)
    if more_edges is not None:
        ties = more_edges.select("src", "dst").union(more_edges.select("src", "src")).union(more_edges.select("dst", "dst"))
        edges = edges.union(ties.select("src", F.concat(F.lit("form://"), canonical_form(F.col("dst"))).alias("dst")))
    labels = components(edges)
    address = F.col("node")
    own_rule = fitting_rule(host_of(address), path_of(address), rules)["verdict"]
    decided = labels.select("component", own_rule.alias("verdict")).groupBy("component").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked")
    )
    spread = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    aliases = labels.join(decided, "component").select(F.col("node").alias("_url"), spread.alias("_spread"))
    rows = pages.select(F.col(id_col), F.col(url).alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    return rows.join(aliases, "_url", "left").select(
        id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_spread", F.lit("allow")).alias("verdict")
    )
