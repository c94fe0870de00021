"""Operator 2: URL filter by rules and link-graph propagation.

Rules decide first: a rule ``host/path`` fits its host and all subdomains
when the url's path starts with the rule's path (which begins with the
slash); the longest rule wins (ties: longer host, then block). A page
without a rule gets its host's verdict from two personalised PageRanks
over the host graph that the pages' links span:

* trust starts at hosts with allowed pages and flows along the links,
* distrust starts at hosts with blocked pages and flows against them.

A host's seed is the share of its pages that a rule allows (blocks). What a
host gets in a step (at first its seed) is added to its score, and
``DAMPING`` of it is passed on in the next step, in proportion to the number
of links. Steps go on until nothing is left to pass on: amounts below
``TOLERANCE`` are not, which ends any walk after 57 links at the latest and
leaves out under 1e-4 of a full seed a walk. A host is blocked where distrust
exceeds ``ratio`` times trust. Scores are whole numbers in units of 1e-12, so
sums do not depend on the order of rows.

Hot hosts: links are summed to one row per host pair before anything is
joined (partial sums in each task), so a host with a third of all pages
enters a step once per neighbour; the final join of pages to host verdicts
has one row per host on one side and is split by adaptive skew joins.

Defined cases: null url or no ``://``: host and path are empty, no rule
fits and the empty host is allowed unless the graph blocks it (it never
has links); null html: no links; links without a host point to the page's
own host and are left out, as are links of an empty host; repeated rows
count as pages of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import cut, settle

#: (verdict, rule) pairs of the registered query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
RATIO = 1.0
UNIT = 10 ** 12
TOLERANCE = 10 ** 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"(?i)<a[\x20\x09-\x0D][^>]*?href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*[\"']?([^\"'\x20\x09-\x0D>]*)"
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"


def ordered(rules) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path), the rule that wins first."""
    parts = [(v, r, r[: r.index("/")], r[r.index("/"):]) for v, r in rules]
    return sorted(parts, key=lambda x: (-len(x[1]), -len(x[2]), x[0] != "block", x[1]))


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule (null where none fits), rule_verdict."""
    host, path = host_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))

    def fits(h, p):
        return ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)

    def first(at):
        out = F.lit(None).cast("string")
        for r in reversed(ordered(rules)):
            out = F.when(fits(r[2], r[3]), F.lit(r[at])).otherwise(out)
        return out

    return df.select("page_id", "host", "path", first(1).alias("rule"), first(0).alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, summed."""
    links = F.filter(F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1)), lambda x: x.rlike(ABSOLUTE))
    to = F.explode(links).alias("link")
    df = pages.select(host_path(F.col("url"))[0].alias("src"), to)
    dst, _ = host_path(F.concat(F.lit("x://"), F.regexp_replace("link", ABSOLUTE, "")))
    df = df.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return df.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(ruled: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: int = TOLERANCE) -> DataFrame:
    """(kind, host, score): kind is trust or distrust."""
    seeds = ruled.groupBy("host").agg(
        F.count("*").alias("n"),
        F.sum((F.col("rule_verdict") == "allow").cast("long")).alias("trust"),
        F.sum((F.col("rule_verdict") == "block").cast("long")).alias("distrust"),
    )
    seeds = seeds.select("host", "n", F.explode(F.create_map(
        F.lit("trust"), F.coalesce("trust", F.lit(0)), F.lit("distrust"), F.coalesce("distrust", F.lit(0)),
    )).alias("kind", "hits")).where("hits > 0")
    seeds = cut(seeds.select("kind", "host", F.floor(F.col("hits") * F.lit(float(UNIT)) / F.col("n")).cast("long").alias("score")))

    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("u"), F.col("src").alias("v"), "n"))
    out = both.groupBy("kind", "u").agg(F.sum("n").alias("n_out"))
    both = cut(both.join(out, ["kind", "u"]).select("kind", F.col("u").alias("host"), "v", "n", "n_out"))

    def merged(rows, more):
        for m in more:
            rows = rows.unionByName(m)
        return settle(rows.groupBy("kind", "host").agg(F.sum("score").alias("score")))

    got, total, waiting = seeds, seeds, []
    while True:
        passed = got.where(F.col("score") >= tolerance).join(both, ["kind", "host"]).select(
            "kind", F.col("v").alias("host"),
            F.floor(F.col("score") * F.lit(float(damping)) * F.col("n") / F.col("n_out")).cast("long").alias("score"))
        got = settle(passed.groupBy("kind", "host").agg(F.sum("score").alias("score")))
        if got.isEmpty():
            return merged(total, waiting)
        waiting.append(got)
        if len(waiting) == 8:
            total, waiting = merged(total, waiting), []


def filter_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: int = TOLERANCE,
                ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every page."""
    ruled = with_rules(pages, rules)
    scores = host_scores(ruled, cut(host_edges(pages)), damping, tolerance)
    blocked = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0)).alias("distrust"),
    ).where(F.col("distrust") > F.col("trust") * F.lit(float(ratio))).select("host", F.lit("block").alias("host_verdict"))
    return ruled.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"))
