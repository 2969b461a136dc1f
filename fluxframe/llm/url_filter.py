"""URL filters over redirect equivalence.

A rule names a host and a path: it fits that host and its subdomains where the path starts with the rule's, and the longest
fitting rule decides. Pages that no rule fits take the verdict of their aliases: redirects and canonical links are edges,
distributed connected components give the classes of URLs that mean one page, and a class with a blocked member is blocked
unless a rule allows one of its members. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, cut, let, maybe_broadcast, text_or_empty

#: verdict, rule
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """From the first :// to the next / ? # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """path without its . and .. segments, as RFC 3986, 5.2.4 says; a path that is not empty begins with a slash."""
    segments = F.split(path, "/")

    def step(kept: Column, x: Column) -> Column:
        return F.when(x == ".", kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))

    def finish(kept: Column) -> Column:
        folder = F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0)
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))

    rest = F.slice(segments, 2, F.size(segments))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.aggregate(rest, F.array().cast("array<string>"), step, finish)).otherwise(path)


def resolve_reference(base: Column, to: Column) -> Column:
    """The absolute URL that to means on the page base, by RFC 3986, 5.2; null for one without a host, or where base has none."""

    def whole(x: Column) -> Column:
        base, to = x["base"], x["to"]
        root, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), path_of(base)
        folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
        return (
            F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
            .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (root == ""), F.lit(None))
            .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to))
            .when(to.startswith("/"), F.concat(root, to))
            .when(to.startswith("?"), F.concat(root, path, to))
            .when(to.startswith("#") | (to == ""), F.regexp_extract(base, "(?s)^([^#]*)", 1))
            .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), to))
        )

    def clean(w: Column) -> Column:
        part = lambda i: F.regexp_extract(w, r"(?s)^(.*?://[^/?#]*)([^?#]*)(.*)$", i)
        return F.concat(part(1), let(part(2), _without_dots), part(3))

    return let(let(F.struct(base.alias("base"), to.alias("to")), whole), clean)


def named_links(url: Column, html: Column) -> Column:
    """array of the absolute URLs that a page's canonical links and refreshes name."""
    low = F.lower(html)
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    none = F.array().cast("array<string>")
    # the plain search first: few pages have either, and the patterns cost more
    canonical = F.when(F.instr(low, "canonical") > 0, every(_CANONICAL)).otherwise(none)
    refresh = F.when(F.instr(low, "http-equiv") > 0, every(_REFRESH)).otherwise(none)
    base = F.when(F.instr(low, "<base") > 0, F.regexp_extract(html, _BASE, 1)).otherwise("")
    on = F.coalesce(resolve_reference(url, base), url)
    found = let(on, lambda b: F.transform(F.filter(F.concat(canonical, refresh), lambda x: x != ""), lambda to: resolve_reference(b, to)))
    return F.when((F.instr(low, "canonical") > 0) | (F.instr(low, "http-equiv") > 0), F.filter(found, lambda x: x.isNotNull())).otherwise(none)


def alias_key(url: Column) -> Column:
    """URLs that differ in nothing but their fragment, or the case of scheme and host, are one page."""

    def lower(u: Column) -> Column:
        part = lambda i: F.regexp_extract(u, r"(?s)^(.*?://)((?:[^/?#@]*@)?)([^/?#]*)(.*)$", i)
        return F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(ascii_lower(part(1)), part(2), ascii_lower(part(3)), part(4))).otherwise(u)

    return let(F.regexp_replace(url, r"(?s)#.*$", ""), lower)


def fitting_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages(host, path, ...) with rule and rule_verdict, null where no rule fits.

    A host has few suffixes, so they are tried as equal keys, not by a comparison with every rule. The rules are
    broadcast if counted to be few. An allow wins over a block of the same rule.
    """
    parsed = cut(rules.select("verdict", "rule", F.regexp_extract("rule", "^([^/]*)", 1).alias("rule_host"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("rule_path")))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = cut(pages.select("host", "path").distinct())
    tried = distinct.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(maybe_broadcast(parsed), "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule"), F.when(F.col("verdict") == "allow", 1).otherwise(0), "rule", "verdict")
    best = tried.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))
    return pages.join(best, ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict, equivalent) of every row of pages.

    rules(verdict, rule) as in RULES. links(src, dst) are redirects known from elsewhere; those that pages name are added.
    equivalent tells that aliases decided. A null URL, or one without ://, has an empty host and path and is allowed.
    Very long pages are searched whole. Repeated rows get equal verdicts; of rules of one length an allow wins. Null links are
    ignored. Empty tables are fine, and other columns are not looked at, whatever their names.

    pages is read once: what is kept of a page is its URL, host, path and links.
    """
    url = F.col("_url")
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), text_or_empty(html_col).alias("_html") if html_col else F.lit("").alias("_html"))
    base = cut(base.select("_id", "_url", host_of(url).alias("host"), path_of(url).alias("path"), named_links(url, F.col("_html")).alias("_to")))
    ruled = cut(fitting_rule(base.drop("_to"), rules))
    edges = base.filter("_url is not null and size(_to) > 0").select(url.alias("src"), F.explode("_to").alias("dst"))
    if links is not None:
        edges = edges.unionByName(links.select("src", "dst").filter("src is not null and dst is not null"))
    key = F.xxhash64(alias_key(url))
    to_key = lambda c: F.xxhash64(alias_key(F.col(c)))
    # targets that no page has are judged as well: a redirect into a blocked host is an alias of it
    edges = cut(edges.distinct().select("src", "dst", to_key("src").alias("a"), to_key("dst").alias("b")))
    classes = connected_components(edges, "a", "b")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("_url")).distinct().withColumns({"host": host_of(url), "path": path_of(url)})
    known = fitting_rule(ends, rules).filter("rule is not null").select(key.alias("node"), "rule_verdict").distinct()
    by_class = known.join(classes, "node").groupBy("component").agg(F.max(F.when(F.col("rule_verdict") == "allow", 1).otherwise(0)).alias("allows"))
    verdicts = cut(classes.join(by_class, "component").select("node", F.when(F.col("allows") == 1, "allow").otherwise("block").alias("class_verdict")))
    out = ruled.withColumn("node", key).join(maybe_broadcast(verdicts), "node", "left")
    return out.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"), (F.col("rule").isNull() & F.col("class_verdict").isNotNull()).alias("equivalent")
    )


def url_filter_query(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, rule string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).drop("equivalent")


#: The tables' pages name no canonical link and no refresh where this SQL is compared; it has the rules alone.
ORACLE = r"""
with p as (select page_id, lower_host as host, path from (select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages)),
r as (select * from (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) as t(verdict, h, q)),
f as (select page_id, h || q as rule, verdict, row_number() over (partition by page_id order by length(h || q) desc) as k
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q))
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join f on p.page_id = f.page_id and k = 1"""
