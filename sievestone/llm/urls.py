"""URL rules that follow redirects: pages known under several addresses share their block decision.

Edges come from `<link rel="canonical">` and `<meta http-equiv="refresh">` in the page, and from a table of redirects if there
is one. Links are resolved as RFC 3986 says, against the page's `<base href>` if it has one and its own address else. Connected
components over these edges (distributed) make classes of addresses. A rule that fits an address decides for it; an address
without a rule is blocked if its class holds a blocked address and no allowed one (an explicit allow anywhere in the class wins),
and allowed otherwise.

Edge cases: null url, or no `://`: host and path are empty, no rule fits, verdict allow; its relative links lead nowhere. Null html
has no edges. Addresses are compared without fragment and with scheme and host in lower case; an empty path is not `/`, as in the
rules. Repeated rows are judged alike; rows with null page_id too. Rules are a literal list of at most MAX_RULES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.shared import components

MAX_RULES = 1000
#: Fixed values: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SITE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
#: Entities decoded in links, `&` last: (pattern, character).
ENTITIES = [("&(?:lt|#0*60|#[xX]0*3[cC]);", "<"), ("&(?:gt|#0*62|#[xX]0*3[eE]);", ">"), ("&(?:quot|#0*34|#[xX]0*22);", '"'), ("&(?:apos|#0*39|#[xX]0*27);", "'"), ("&(?:sol|#0*47|#[xX]0*2[fF]);", "/"),
            ("&(?:colon|#0*58|#[xX]0*3[aA]);", ":"), ("&(?:quest|#0*63|#[xX]0*3[fF]);", "?"), ("&(?:equals|#0*61|#[xX]0*3[dD]);", "="), ("&(?:amp|AMP|#0*38|#[xX]0*26);", "&")]


def host_and_path(url) -> tuple[F.Column, F.Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules) -> F.Column:
    """The longest fitting rule as a struct (size, rule, verdict), or null; of equal lengths the one listed first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit in an expression")
    verdict = F.lit(None).cast("struct<rule:string,verdict:string>")
    for kind, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        verdict = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(kind).alias("verdict"))).otherwise(verdict)
    return verdict


def bound(column, use) -> F.Column:
    """use(column), with the column evaluated once: expressions that repeat their inputs don't multiply."""
    return F.element_at(F.transform(F.array(column), use), 1)


def address(url) -> F.Column:
    """A url without its fragment, scheme and host in lower case: what redirects and canonical links are compared by."""
    return F.concat(F.translate(F.regexp_extract(url, SITE, 0), UPPER, LOWER), F.regexp_replace(F.regexp_replace(url, SITE, ""), "#.*$", ""))


def decoded(link) -> F.Column:
    for pattern, character in ENTITIES:
        link = F.regexp_replace(link, pattern, character)
    return link


def without_dots(path) -> F.Column:
    """A path with its `.` and `..` folders resolved."""
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    kept = F.aggregate(F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/"), F.array().cast("array<string>"),
                       lambda done, s: F.when(s == ".", done).when(s == "..", up(done)).otherwise(F.concat(done, F.array(s))))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def resolved(link, base) -> F.Column:
    """The address `link` means on a page at `base`; null if it is relative and base is no full address."""
    page = F.struct(link.alias("link"), base.alias("base"), F.regexp_extract(base, SITE, 0).alias("site"), F.regexp_extract(base, SITE + "([^?#]*)", 1).alias("path"))

    def join(p):
        to, site = p["link"], p["site"]
        folder = F.when(p["path"] == "", F.lit("/")).otherwise(F.regexp_extract(p["path"], r"^.*/", 0))
        return (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
                .when(site == "", F.lit(None).cast("string"))
                .when(to.startswith("//"), F.concat(F.regexp_extract(site, "^[^:]+:", 0), to))
                .when(to.startswith("/"), F.concat(site, to))
                .when(to.startswith("?"), F.concat(site, p["path"], to))
                .when((to == "") | to.startswith("#"), F.concat(F.regexp_extract(p["base"], "^[^#]*", 0), to))
                .otherwise(F.concat(site, folder, to)))

    cut = lambda u: F.struct(u.alias("url"), F.regexp_extract(u, SITE, 0).alias("site"), F.regexp_extract(u, SITE + "([^?#]*)", 1).alias("path"), F.regexp_replace(u, SITE + "[^?#]*", "").alias("rest"))
    whole = lambda c: F.when(c["site"] == "", c["url"]).otherwise(F.concat(c["site"], without_dots(c["path"]), c["rest"]))
    return bound(bound(bound(page, join), cut), whole)


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) addresses of canonical links and refreshes in the html of pages (url, html)."""
    tag = lambda kind: F.regexp_extract_all("html", F.lit(rf"(?is)<(?:link|meta)\b[^>]*(?:rel|http-equiv)\s*=\s*[\"']?{kind}\b[^>]*>"), F.lit(0))
    href = F.transform(tag("canonical"), lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(tag("refresh"), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    base = F.regexp_extract("html", r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = pages.filter("url is not null and html is not null").select("url", "html", F.concat(href, refresh).alias("links")).filter(F.size("links") > 0)
    found = found.select("url", decoded(base).alias("base"), F.explode("links").alias("to")).filter("to <> ''")
    found = found.select("url", F.coalesce(resolved(F.col("base"), F.col("url")), F.col("url")).alias("base"), decoded(F.col("to")).alias("to"))
    return found.select(address(F.col("url")).alias("source"), bound(resolved(F.col("to"), F.col("base")), address).alias("target")).filter("target is not null")


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, html); redirects has (source, target)."""
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(address(F.col("source")).alias("source"), address(F.col("target")).alias("target")).dropna())
    number = lambda c: F.xxhash64(c)
    classes = components(links.select(number("source").alias("a"), number("target").alias("b")))
    classes = classes.unionByName(classes.select(F.col("component").alias("node"), "component")).distinct()
    ends = links.select(F.explode(F.array("source", "target")).alias("url")).unionByName(pages.filter("url is not null").select(address(F.col("url")).alias("url"))).distinct()
    judged = lambda df: df.select("*", *[c.alias(n) for n, c in zip(("host", "path"), host_and_path("url"))]).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    known = judged(ends).filter("own is not null").select(number("url").alias("node"), F.col("own.verdict").alias("said"))
    decided = classes.join(known, "node").groupBy("component").agg(F.max(F.col("said") == "block").alias("block"), F.max(F.col("said") == "allow").alias("allow"))
    spread = classes.join(decided.filter("block and not allow").select("component"), "component", "left_semi").select("node", F.lit(True).alias("blocked"))
    rows = judged(pages.select("page_id", "url")).withColumn("node", number(address(F.col("url")))).join(spread, "node", "left")
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                       F.coalesce("own.verdict", F.when(F.col("blocked"), "block"), F.lit("allow")).alias("verdict"))
