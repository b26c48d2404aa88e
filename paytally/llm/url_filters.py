"""Allow and block rules for URLs, carried over to their aliases.

Aliases are the connected components over redirect and canonical-link edges: a page and what its canonical
link or its refresh names, and URLs of the same settled form (secure scheme, no fragment, default port,
tracking parameters, index page, ``.html`` or closing slash), which stands in for redirects that the pages do
not show. Forms only connect: verdicts are taken from URLs that pages have or links name, never from a form, so
one that no other URL shares changes nothing. A URL with a rule of its own keeps that verdict. For the others an
allow rule of any alias comes first, then a block rule of any alias, and without either the URL is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.llm.components import connected_components
from paytally.storage import write_once

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judged(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, an allow first among equals; else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        named = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, named).otherwise(chosen)
    return chosen


def settled(url: Column) -> Column:
    """The form of a URL that its server redirects the others to."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(?:/index)?\.html?$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))
    return F.concat(
        F.lit("https://"),
        host,
        F.regexp_replace(path, "/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise(""),
    )


def _form(url: Column) -> Column:
    """The node that URLs of one settled form share. It begins with a space, so it is no URL; null for what is none."""
    return F.when(url.contains("://"), F.concat(F.lit(" "), settled(url)))


def _absolute(link: Column, url: Column) -> Column:
    """A link as seen from a page, dot segments resolved; null for links of schemes without a host."""
    scheme = F.regexp_extract(url, "(?s)^(.*?:)//", 1)
    root = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(url, "(?s)^([^?#]*)", 1), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(url, "(?s)^([^#]*)", 1), link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )
    return F.when(path_of(whole).rlike(r"/\.\.?(/|$)"), _without_dots(whole)).otherwise(whole)


def _without_dots(url: Column) -> Column:
    """The segments ``.`` and ``..`` of a path taken out."""
    start = F.regexp_extract(url, "(?s)^(.*?://[^/?#]*)", 1)
    segments = F.split(F.substr(path_of(url), F.lit(2)), "/")

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part == ".", kept)
            .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(part)))
        )

    last = F.element_at(segments, -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(start, F.lit("/"), F.array_join(kept, "/"), F.regexp_extract(url, "(?s)^[^?#]*(.*)$", 1))


def _linked(html: Column, url: Column) -> Column:
    """The URLs that a page names as its own: by a canonical link, and by a refresh."""
    canonical = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(
        html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)""", 1
    )
    named = F.filter(F.array(canonical, refresh), lambda link: link != "")
    whole = F.transform(named, lambda link: _absolute(F.replace(link, F.lit("&amp;"), F.lit("&")), url))
    return F.array_distinct(F.filter(whole, lambda link: link.isNotNull()))


def filter_pages(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A verdict for every row of ``pages(page_id, url, html)``.

    Returns page_id, host, path, rule (the fitting rule as host and path, else null), verdict
    and aliases (how many distinct URLs of pages and links the component has). ``rules`` is a short list that
    becomes part of the expression. A null url or one without ``://`` has empty host and path,
    no aliases, and is allowed. Null html has no links. Rows that repeat are judged each; other
    columns are not looked at; an empty table gives no rows.
    """
    real = F.col("url").contains("://")
    rows = pages.select(
        "page_id",
        "url",
        F.when(real & F.col("html").isNotNull(), _linked(F.col("html"), F.col("url"))).alias("linked"),
    )
    rows = write_once(rows, "urls")
    links = rows.select("url", F.explode("linked").alias("linked"))
    edges = (
        rows.select(F.col("url").alias("u"), _form(F.col("url")).alias("v"))
        .union(links)
        .union(links.select("linked", _form(F.col("linked"))))
    )
    components = write_once(connected_components(edges), "aliases").where(~F.col("node").startswith(" "))
    rule = judged(rules, host_of(F.col("node")), path_of(F.col("node")))
    verdicts = components.select("component", rule["verdict"].alias("verdict")).groupBy("component").agg(
        F.count("*").alias("aliases"),
        F.max(F.col("verdict") == "allow").alias("allowed"),
        F.max(F.col("verdict") == "block").alias("blocked"),
    )
    inherited = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    known = components.join(verdicts, "component").select(F.col("node").alias("url"), "aliases", inherited.alias("inherited"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged_rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged_rows = judged_rows.withColumn("own", judged(rules, F.col("host"), F.col("path")))
    return judged_rows.join(known, "url", "left").select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"),
        F.coalesce("aliases", F.lit(1)).cast("long").alias("aliases"),
    )
