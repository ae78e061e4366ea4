"""URL filters with redirect equivalence (DataFrame operations only).

Rules allow or block a host suffix and a path prefix; the longest rule that fits decides.  Pages
that no rule fits take the method's verdict: URLs joined by redirect or canonical-link edges form
classes (distributed connected components), a class with a blocked URL passes the block to its
aliases, and an explicitly allowed URL anywhere in the class takes precedence and keeps the
unruled aliases allowed.  Without either, the verdict is allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.llm.components import components
from panelspark.llm.scratch import stored
from panelspark.operators.small import join_per_key

#: (verdict, host, path) in the order given; the text form is host + path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _AFTER, 2)


def node_of(url: Column) -> Column:
    """A URL's identity: host, path and query; scheme and fragment do not matter."""
    return F.concat(host_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; at equal length the earlier rule."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        hit = fits(host, path, rule)
        text, verdict = F.when(hit, rule[1] + rule[2]).otherwise(text), F.when(hit, rule[0]).otherwise(verdict)
    return text, verdict


_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_CANONICAL, _REFRESH = r"(?i)\brel\s*=\s*[\"']?canonical\b", r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF, _URL = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _without_dots(path: Column) -> Column:
    """A path from the root on with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    parts = F.slice(parts, F.lit(2), F.size(parts))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: (
        F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))))
    last = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, last), "/"))


def absolute(target: Column, url: Column) -> Column:
    """``target`` as an absolute URL, seen from ``url``; NULL for an empty one and for schemes without ``://``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    query = F.regexp_extract(target, r"(?s)^[^?#]*(\?[^#]*)", 1)
    base = F.regexp_replace(path_of(url), r"[^/]*$", "")
    merged = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(base == "", F.lit("/")).otherwise(base), own))
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("#"), url)
            .when(own == "", F.concat(origin, path_of(url), query))
            .otherwise(F.concat(origin, _without_dots(merged), query)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): edges from a page's URL to its canonical link and to its redirect target."""
    url = F.col("url")
    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    targets = F.concat(F.transform(F.filter(tags, lambda t: t.rlike(_CANONICAL)), lambda t: F.regexp_extract(t, _HREF, 1)),
                       F.transform(F.filter(tags, lambda t: t.rlike(_REFRESH)), lambda t: F.regexp_extract(t, _URL, 1)))
    low = F.lower(F.col("html"))
    return (pages.where("url is not null").where(low.contains("canonical") | low.contains("refresh"))
            .select(url, F.explode(targets).alias("t"))
            .select(node_of(url).alias("a"), node_of(absolute(F.col("t"), url)).alias("b")).where("a <> '' and b <> ''"))


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_class of every row.

    ``edges`` adds redirect edges known from elsewhere, as (a, b) URLs.  Defined results: a NULL
    URL, or one without ``://``, has an empty host and path, no rule, no aliases, and is allowed;
    NULL or empty html gives no edges; repeated rows get equal answers.  Blocks and allows that
    take part in a class are those of its pages and of its link targets alike."""
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(host, path, rules)
    links = page_edges(pages)
    if edges is not None:
        links = links.union(edges.select(node_of(F.col("a")), node_of(F.col("b"))))
    members = components(links, "a", "b")
    at = F.concat(F.lit("x://"), F.col("node"))
    _, of_node = rule_of(host_of(at), path_of(at), rules)
    classes = members.withColumn("v", of_node)
    marked = classes.groupBy("root").agg(F.coalesce(F.max(F.col("v") == "block"), F.lit(False)).alias("blocked"),
                                         F.coalesce(F.max(F.col("v") == "allow"), F.lit(False)).alias("allowed"))
    aliases = stored(join_per_key(members, marked, "root"), "aliases")                 # a large class can be split
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("own"),
                          F.when(host != "", node_of(url)).alias("node"))
    out = judged.join(aliases, "node", "left")
    by_class = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", by_class).alias("verdict"),
                      F.col("root").alias("alias_class"))
