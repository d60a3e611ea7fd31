"""Block and allow rules for pages, carried along redirects and canonical links.

Pages that redirect to one another, or name one another as their canonical page,
are aliases.  Aliases are connected components of the link edges, found by Spark
joins.  A page with a rule of its own follows it, so an explicit allow stands
above what its aliases suffer; a page without one is blocked if any alias is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronarch.llm.components import connected_components
from chronarch.llm.tables import prepare, with_results, written

#: A list of link types with canonical in it: quoted, or one word.
REL = r"(?:\"(?:[^\">]*\s)?canonical(?=[\s\"])|'(?:[^'>]*\s)?canonical(?=[\s'])|canonical\b)"
#: The beginning of an attribute, not of the rest of one such as data-href.
AT = r"(?<![\w-])"
#: Links to the canonical page, and redirects by a page itself.  The place of the address differs, so there are two forms of each.
LINKS = (
    rf"(?is)<link\b[^>]*?{AT}rel\s*=\s*{REL}[^>]*?{AT}href\s*=\s*[\"']?([^\"'\s>]+)",
    rf"(?is)<link\b[^>]*?{AT}href\s*=\s*[\"']?([^\"'\s>]+)[^>]*?{AT}rel\s*=\s*{REL}",
    rf"(?is)<meta\b[^>]*?{AT}http-equiv\s*=\s*[\"']?refresh\b[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)",
    rf"(?is)<meta\b[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)[^>]*?{AT}http-equiv\s*=\s*[\"']?refresh\b",
)
#: Elements whose content is text to a browser (fixed values).
TEXTUAL = ("script", "style", "textarea", "title")
#: What a browser does not read as markup: comments and the content of those elements.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{e}(?:[\s/][^>]*)?>.*?(?:</{e}(?:[\s/][^>]*)?>|\z)" for e in TEXTUAL)
#: The address that relative ones of the page are resolved by; the first counts.
BASE = rf"(?is)<base\b[^>]*?{AT}href\s*=\s*[\"']?([^\"'\s>]+)"
#: Where A-Z stand in a host, they are taken as a-z (fixed values).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """The address that aliases are told by: without fragment, its scheme and host in lower case."""
    whole = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    head = F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(head, UPPER, LOWER), F.substring(whole, F.length(head) + 1, F.length(whole)))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; a rule is its host and path, such as "example.com/de/"."""
    rule = verdict = F.lit(None).cast("string")
    for name, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def resolved(target: Column, source: Column) -> Column:
    """The address that ``target`` means on the page ``source``; null for schemes without ://, such as mailto:."""
    scheme = F.regexp_extract(source, r"(?s)^(.*?:)//", 1)
    root = F.regexp_extract(source, r"(?s)^(.*?://[^/?#]*)", 1)
    path = url_path(source)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.substring(target, F.length(own) + 1, F.length(target))
    whole = F.when(target.startswith("/"), own).otherwise(F.concat(folder, own))
    steps = F.split(F.substring(whole, F.lit(2), F.length(whole)), "/")

    def fold(done: Column, step: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), fold), "/"))
    # A last . or .. is a folder.
    folded = F.when(F.element_at(steps, -1).isin(".", "..") & (folded != "/"), F.concat(folded, F.lit("/"))).otherwise(folded)
    query = F.regexp_extract(source, r"(?s)^([^?#]*(?:\?[^#]*)?)", 1)
    return (
        F.when(target.rlike("(?s)^[^/?#]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/") & ~own.rlike(r"(?s)/\.\.?(?:/|$)"), F.concat(root, target))
        .when(~source.contains("://") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("#"), F.concat(query, target))
        .when(target.startswith("?"), F.concat(root, path, target))
        .otherwise(F.concat(root, folded, rest))
    )


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target) addresses of canonical links and redirects to absolute addresses and to those relative to the page or its base."""
    source = F.col(f"`{url_col}`")
    html = F.col(f"`{html_col}`")
    targets = F.concat(*[F.regexp_extract_all("seen", F.lit(p), F.lit(1)) for p in LINKS])
    # The cheap test comes first: most pages have neither.
    some = pages.where(source.contains("://") & html.rlike("(?i)canonical|http-equiv"))
    links = some.select(source.alias("source"), F.regexp_replace(html, UNREAD, "").alias("seen"))
    links = links.select("source", F.regexp_extract("seen", BASE, 1).alias("base"), F.explode(targets).alias("target"))
    plain = lambda c: F.regexp_replace(c, "&amp;", "&")
    base = F.when(F.col("base") != "", resolved(plain("base"), F.col("source")))
    links = links.select("source", F.coalesce(base, "source").alias("base"), plain("target").alias("target"))
    target = resolved(F.col("target"), F.col("base"))
    return links.select(url_node(F.col("source")).alias("source"), url_node(target).alias("target")).where("target IS NOT NULL AND source <> target").distinct()


def judge_pages(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` but the html, with host, path, rule and verdict (allow or block).

    rules: (host and path, "allow" or "block").  A rule fits its host and all
    subdomains if the path starts with the rule's; the longest wins.  redirects: a
    table (source, target) of more edges, as a crawler logs them.

    verdict: that of the page's rule; without a rule, block if an alias has a rule
    that blocks it (whether or not the alias is among the pages), else allow.  A null
    url or one without :// has an empty host and path, no aliases and no rule.  Null
    html, HTML comments, scripts, styles, titles and text fields have no links, and addresses without :// link nothing.  Relative addresses
    are resolved by the page's first base, where it has one.  Pages with the same url are judged alike.  Input columns
    named like a result are replaced.
    """
    prepare(pages.sparkSession)
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(url_node(F.col("source")).alias("source"), url_node(F.col("target")).alias("target"))
        edges = edges.union(more.where("source <> target AND source LIKE '%://%' AND target LIKE '%://%'")).distinct()
    edges = written(edges, "edges")
    ends = edges.select(F.col("source").alias("url")).union(edges.select("target")).distinct()
    component = connected_components(edges.select(F.xxhash64("source").alias("a"), F.xxhash64("target").alias("b")))
    _, own = matched_rule(url_host(F.col("url")), url_path(F.col("url")), rules)
    judged = ends.select(F.xxhash64("url").alias("node"), own.alias("own")).join(component, "node")
    blocked = judged.where("own = 'block'").select("component").distinct()
    blocked = component.join(blocked, "component", "left_semi").select(F.col("node").alias("__node"), F.lit(True).alias("__blocked"))

    url = F.col(f"`{url_col}`")
    host, path = url_host(url), url_path(url)
    rule, verdict = matched_rule(host, path, rules)
    out = pages.drop(html_col).withColumns({"__node": F.xxhash64(url_node(url)), "__rule": rule, "__own": verdict, "__host": host, "__path": path}).join(blocked, "__node", "left")
    final = F.coalesce("__own", F.when(F.col("__blocked"), "block"), F.lit("allow"))
    results = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__rule"), "verdict": final}
    return with_results(out, results).drop("__node", "__rule", "__own", "__host", "__path", "__blocked")
