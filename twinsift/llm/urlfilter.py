"""URL verdicts by host and path rules, spread over redirect and canonical-link aliases.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import join_classes
from twinsift.operators.components import connected_components
from twinsift.stash import Stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of a page in which a tag is no tag.
SILENT = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b.*?(?:</{t}\b|\z)" for t in ("script", "style", "textarea", "template"))
#: One of the values of ``rel``, which are separated by white space.
REL = r"""(?:^|[\s"'/])rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?:[\s/>]|$))"""
CANONICAL = rf"""(?is)<link\b(?=[^>]*?{REL})[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Rules that are sent to every task; more are joined.
SENT_RULES = 100_000


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or none."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def node_of(rest: Column) -> Column:
    """A URL without scheme and fragment, its host lower-cased: what aliases are known by."""
    return F.concat(host_of(rest), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; what follows ``?`` stays as it is."""
    plain, rest = F.regexp_extract(path, r"^[^?#]*", 0), F.regexp_extract(path, r"^[^?#]*(.*)$", 1)
    parts = F.split(F.substr(plain, F.lit(2)), "/")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.locate("/.", plain) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"), rest)).otherwise(path)


def resolve(target: Column, base: Column) -> Column:
    """What follows the scheme of a link target found on the page whose URL has ``base`` after its scheme.

    Targets may be whole, without scheme, absolute or relative paths (with ``.`` and ``..``) or queries, and have
    ``&amp;`` for ``&``. A fragment is the page itself; schemes without ``//`` lead nowhere, that is, to null.
    """
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    host, path = F.regexp_extract(base, r"^[^/?#]*", 0), path_of(base)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(target.rlike(SCHEME + "//"), after_scheme(target))
        .when(target.rlike(SCHEME), F.lit(None))
        .when(target.startswith("//"), F.substr(target, F.lit(3)))
        .when(target.startswith("#"), base)
        .when(target.startswith("?"), F.concat(host, path, target))
        .when(target.startswith("/"), F.concat(host, without_dots(target)))
        .otherwise(F.concat(host, without_dots(F.concat(folder, target))))
    )


def links_in(pages: DataFrame) -> DataFrame:
    """``(a, b)``: nodes of pages and of the targets of their canonical links and immediate refreshes.

    A delay above zero makes a refresh a reload, not an alias. Relative targets start from the page's ``<base>``, if any.
    Comments, scripts, styles, templates and text areas hold no links.
    """
    rest = after_scheme(F.col("url"))
    found = pages.where(F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv")).withColumn("html", F.regexp_replace("html", SILENT, " "))
    found = found.select(
        rest.alias("rest"),
        F.regexp_extract("html", BASE, 1).alias("base"),
        F.explode(F.array(F.regexp_extract("html", CANONICAL, 1), F.regexp_extract("html", REFRESH, 1))).alias("target"),
    )
    found = found.where("target <> '' and rest <> ''")
    start = F.when(F.col("base") == "", F.col("rest")).otherwise(F.coalesce(resolve(F.col("base"), F.col("rest")), "rest"))
    links = found.select(node_of(F.col("rest")).alias("a"), node_of(resolve(F.col("target"), start)).alias("b"))
    return links.where("b is not null")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)`` for the distinct ``urls(host, path)`` that a rule fits; the longest wins.

    ``rules(host, path, verdict)`` fit their host and its subdomains if the path starts with theirs. Every
    suffix of a host meets rules by an equi-join: up to SENT_RULES rules, which are counted, are sent to the URLs; more
    are first joined with distinct hosts, and what fits a host then meets its paths. Of two rules of one length that with the longer host wins,
    then an allow.
    """
    names = F.split("host", r"\.")
    upto = F.sequence(F.lit(1), F.size(names))
    suffixes = F.transform(upto, lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    if r.limit(SENT_RULES + 1).count() <= SENT_RULES:
        met = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).join(F.broadcast(r), "rule_host")
    else:
        fit = urls.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(r, "rule_host")
        met = urls.join(fit.hint("merge"), "host")
    met = met.where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(rule), F.length("rule_host"), F.col("verdict") == "allow", rule.alias("rule"), "verdict")
    best = met.groupBy("host", "path").agg(F.max(order).alias("x"))
    return best.select("host", "path", "x.rule", "x.verdict")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row ``(page_id, host, path, rule, verdict)`` per row of ``pages(page_id, url, html)``.

    A page that a rule fits gets its verdict. Others are blocked if they are an alias of a blocked URL, that
    is, if canonical links, immediate refreshes in the html and ``redirects(from_url, to_url)`` connect them
    with one; an explicit allow takes precedence: aliases of an allowed URL are not blocked by the rest of
    their group. All others are allowed. Null URLs and those without ``://`` have empty host and path, no rule
    and no aliases; null html has no links; repeated rows are judged each time; extra columns are ignored; no
    rows give no rows.
    """
    stash = Stash(pages.sparkSession)
    rest = after_scheme(F.col("url"))
    links = links_in(pages)
    if redirects is not None:
        ends = redirects.select(after_scheme(F.col("from_url")).alias("a"), after_scheme(F.col("to_url")).alias("b"))
        ends = ends.where("a <> '' and b <> ''").select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
        links = links.unionByName(ends)
    links = stash.put(links, "links")
    narrow = pages.select("page_id", host_of(rest).alias("host"), path_of(rest).alias("path"), F.coalesce(node_of(rest), F.lit("")).alias("node"))
    place = F.concat("host", "path").alias("place")
    places = narrow.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    best = ruled(places.select("host", "path"), rules)
    places = stash.put(places.join(best.hint("merge"), ["host", "path"], "left").select(place, "n", "rule", "verdict"), "places")
    judged = join_classes(narrow.select("*", place), places, "place", "n")
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    # Only the nodes of links have groups; their own rules vote on the others of the group.
    groups = stash.put(connected_components(links, stash), "groups")
    groups = groups.select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    own = ruled(groups.select("host", "path").distinct(), rules).select("host", "path", "verdict")
    voting = groups.join(own.hint("merge"), ["host", "path"])
    votes = voting.groupBy("component").agg(F.bool_or(F.col("verdict") == "block").alias("block"), F.bool_or(F.col("verdict") == "allow").alias("allow"))
    votes = votes.where("block and not allow").select("component")
    blocked = groups.join(votes.hint("merge"), "component").select("node", F.lit("block").alias("aliased"))
    judged = judged.join(stash.put(blocked, "blocked").hint("merge"), "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "aliased", F.lit("allow")).alias("verdict"))
