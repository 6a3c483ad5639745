"""URL filter: rules for hosts and paths, passed on between addresses that are the same page.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textmeter.llm.common import connected_components, store
from textmeter.session import remove

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tags that name another address of the page, and the attribute in them that does.
CANONICAL_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*(?:\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"
REFRESH_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
#: A step of a path that names nothing itself.
DOT_STEP = r"/\.\.?(?:/|$)"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, the beginning of a path, and ``allow`` or ``block``."""

    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(name, action); null if none does. At equal length allow wins."""
    found = F.lit(None).cast("struct<name:string,action:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.action).alias("action"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """The url without its fragment, scheme and host lowered, steps like ``..`` taken: one name for what is fetched alike."""
    whole = F.regexp_extract(url, r"^([^#]*)", 1)
    head = F.regexp_extract(whole, r"^[^:/?#]*://[^/?]*", 0)
    rest = F.substring(whole, F.length(head) + 1, F.length(whole))
    path = F.regexp_extract(rest, r"^[^?]*", 0)
    query = F.substring(rest, F.length(path) + 1, F.length(rest))
    return F.concat(F.translate(head, UPPER, LOWER), F.when(path.rlike(DOT_STEP), F.concat(_walked(path), query)).otherwise(rest))


def _walked(path: Column) -> Column:
    """The path after its steps: ``.`` stays, ``..`` goes up, at most to the root; a step at the end leaves the folder."""
    steps = F.split(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    taken = F.aggregate(
        F.slice(steps, F.lit(2), F.size(steps)), F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", up(done)).when(step == ".", done).otherwise(F.concat(done, F.array(step))))
    return F.concat(F.lit("/"), F.array_join(taken, "/"))


def resolved(link: Column, url: Column) -> Column:
    """A link on the page at ``url`` as a whole address; null if there is none.

    Links may be whole, without a scheme, from the root, or relative to the
    page's folder; steps like ``..`` in them are taken.
    """
    scheme = F.regexp_extract(url, r"^([^:/?#]*:)//", 1)
    site = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    whole = (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(folder.endswith("/"), F.concat(folder, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )
    return F.when((link != "") & (site != "") & ~link.startswith("#"), address(whole))


def page_links(pages: DataFrame) -> Column:
    """Addresses that the page's canonical links and refresh redirects name, all of them."""
    def named(tags: str, link: str) -> Column:
        target = lambda tag: resolved(F.replace(F.regexp_extract(tag, link, 1), F.lit("&amp;"), F.lit("&")), F.col("url"))
        return F.transform(F.regexp_extract_all("html", F.lit(tags), F.lit(0)), target)

    links = F.concat(named(CANONICAL_TAG, HREF), named(REFRESH_TAG, REFRESH_URL))
    # Most pages have neither: a search for the two words spares them the patterns.
    return F.when(F.col("html").rlike("(?i)canonical|refresh"), F.array_distinct(F.filter(links, lambda x: x.isNotNull())))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) for each page.

    A page with a fitting rule has that rule's verdict. Another page is blocked
    if an address equivalent to it is blocked by a rule and none is explicitly
    allowed by one; otherwise it is allowed. Addresses are equivalent if
    redirects (``redirects``: columns ``source``, ``target``, and refreshes in
    the page) or canonical links connect them, in any direction and number of
    steps. Addresses count although no page with them was fetched.
    ``alias_of`` is the smallest equivalent address, null if there is no other.

    Rules are a literal list. Html is read once; only addresses with a link to
    another one are shuffled and connected. A null url, or one without ``://``,
    has neither host nor path nor equivalents and fits no rule; null html has no
    links. Repeated pages come back as often as they are there; an empty table
    gives an empty table. Other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read, _ = store(
        pages.select(
            "page_id",
            F.coalesce(host, F.lit("")).alias("host"),
            F.coalesce(path, F.lit("")).alias("path"),
            F.when(F.col("url").contains("://"), address(F.col("url"))).alias("address"),
            page_links(pages).alias("links"),
        ),
        "addresses",
    )
    links = read.filter("size(links) > 0").select(F.col("address").alias("source"), F.explode("links").alias("target"))
    if redirects is not None:
        links = links.union(redirects.select(address(F.col("source")), address(F.col("target"))))
    member, path_ = store(connected_components(links, "source", "target"), "equivalents")
    by_rule = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["action"]
    groups = member.groupBy("component").agg(
        F.max(F.coalesce(by_rule == "allow", F.lit(False))).alias("allowed"),
        F.max(F.coalesce(by_rule == "block", F.lit(False))).alias("blocked"),
    )
    aliases, _ = store(member.join(groups, "component"), "aliases")
    remove(spark, path_)
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    inherited = F.when(F.col("blocked") & ~F.col("allowed"), "block").otherwise("allow")
    return (
        read.drop("links").join(aliases, read["address"] == aliases["node"], "left")
        .withColumn("found", rule)
        .select(
            "page_id", "host", "path", F.col("found.name").alias("rule"),
            F.coalesce("found.action", inherited).alias("verdict"), F.col("component").alias("alias_of"),
        )
    )
