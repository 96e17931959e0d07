"""URL filters with redirect equivalence, in DataFrame functions only.

Rules give the verdict of the urls they fit. Canonical links and refresh redirects in the pages' html, and any redirect
table that is given, are edges between urls; a distributed connected-components run finds aliases, and a block of one url
holds for all its aliases but those that a rule explicitly allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, cut

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: An attribute's name follows white space, a quote or a slash, so that data-rel isn't rel; rel is a list of words.
_LINK = (
    r"(?is)<link\b(?=[^>]*[\s\"'/]rel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>])))[^>]*>"
)
_META = r"(?is)<meta\b(?=[^>]*[\s\"'/]http-equiv\s*=\s*[\"']?refresh\b)[^>]*>"
#: What isn't markup of the page itself; one that doesn't end goes on to the end of the page.
_ASIDE = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b.*?(?:</\1\s*>|\z)"


def _after_scheme(url: Column) -> Column:
    """After the first ://, without fragment; null without one."""
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring_index(F.substr(url, at + 3), "#", 1))


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key(url: Column) -> Column:
    """What names a url as a node: host, path and query; null where there is no host."""
    tail = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.when(tail == "", F.lit("/")).otherwise(tail)))


def ruled(host_: Column, path_: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a parent domain of it and begins the path; the later
    of equally long ones; null if none fits."""
    if not rules:
        return F.lit(None).cast("struct<n:int,at:int,rule:string,verdict:string>")
    fits = []
    for i, (verdict, h, p) in enumerate(rules):
        fit = ((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p))
        fits.append(F.when(fit, F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(i).alias("at"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def resolved(target: Column, page: Column) -> Column:
    """The absolute url of a link on a page: absolute, scheme-relative, root-relative or relative to the page's folder."""
    target = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    folder = F.concat(host(page), F.when(path(page).contains("/"), F.regexp_extract(path(page), r"^(.*/)", 1)).otherwise(F.lit("/")))
    return (
        F.when(target == "", F.lit(None))
        .when(target.contains("://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(F.lit("http://"), host(page), target))
        .when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
        .when(F.startswith(target, F.lit("#")), F.lit(None))
        .otherwise(F.concat(F.lit("http://"), folder, target))
    )


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of canonical links and refresh redirects in html, outside comments, scripts, styles and templates."""
    html = F.col("html").cast("string")
    href = lambda tag: F.regexp_extract(tag, r"(?is)[\s\"'/]href\s*=\s*[\"']?([^\"'>\s]*)", 1)
    to = lambda tag: F.regexp_extract(tag, r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]*)", 1)
    own = F.regexp_replace(html, _ASIDE, " ")
    tags = F.concat(F.transform(F.regexp_extract_all(own, F.lit(_LINK), F.lit(0)), href), F.transform(F.regexp_extract_all(own, F.lit(_META), F.lit(0)), to))
    some = pages.where(F.rlike(html, F.lit(r"(?i)canonical|http-equiv")))
    return some.select(F.col("url").cast("string").alias("src"), F.explode(tags).alias("to")).select("src", resolved(F.col("to"), F.col("src")).alias("dst")).where("dst is not null")


def judged(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, via (the alias component that blocks it, else null).

    The verdict is that of the rule that fits; without one, block if an alias is blocked, else allow. A null or schemeless
    url has an empty host and path, no aliases, and is allowed unless a rule fits the empty host. redirects: src, dst urls.
    Repeated rows stay; an empty table gives no rows.
    """
    url = F.col("url").cast("string")
    own = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), key(url).alias("_key"))
    own = own.withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    pairs = links(pages)
    if redirects is not None:
        pairs = pairs.unionByName(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    pairs = cut(pairs.where("src <> dst").select("src", "dst").distinct())
    verdict = F.coalesce("_r.verdict", F.lit("allow"))
    if pairs.isEmpty():
        return own.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), F.lit(None).cast("string").alias("via"))
    edges = pairs.select(key(F.col("src")).alias("src"), key(F.col("dst")).alias("dst")).where("src is not null and dst is not null")
    parts = connected_components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    bad = parts.where(ruled(host(as_url), path(as_url), rules)["verdict"] == "block").select("component").distinct()
    blocked = parts.join(bad, "component", "left_semi").select(F.col("node").alias("_key"), F.col("component").alias("via"))
    out = own.join(blocked, "_key", "left")
    free = F.col("_r").isNull() & F.col("via").isNotNull()
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.when(free, F.lit("block")).otherwise(verdict).alias("verdict"), F.when(free, F.col("via")).alias("via"))
