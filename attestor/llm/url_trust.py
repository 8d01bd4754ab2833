"""URL filter by rules and by trust that flows over the link graph of hosts.

Rules decide where one fits. Elsewhere the host decides: trust is a personalised PageRank
from hosts that the rules mostly allow, along links; distrust starts at hosts that the
rules mostly block and runs against the links, for who links to bad hosts is suspect. A
host is blocked if its distrust exceeds its trust by a factor.

Links are reduced to weighted host edges with map-side combine before anything iterates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.session import materialize

DAMPING = 0.85
TOLERANCE = 1e-6
FACTOR = 1.0

#: Verdict, host and path of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s{0,8}=\s{0,8}["']?\s{0,8}(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; or empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; or empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits host and path, or null."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n`` for links of ``pages(host, html)`` from one host to another."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate(F.regexp_replace("dst", r"^[^@]*@|:[0-9]*$", ""), _UPPER, _LOWER).alias("dst"))
    return links.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def enough_rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which two vectors of sum one change by less than ``tolerance`` together:
    each round scales the change, at first ``2 * damping`` at most for either, by ``damping``."""
    return max(1, 2 + math.ceil(math.log(tolerance / 4) / math.log(damping)))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` from ``edges(src, dst, n)`` and ``seeds(host, trusted, blocked)``.

    Both start vectors add up to one, if they have any host. What reaches a host without
    onward links is lost, as no walk goes on from there. Stops when the two vectors together
    change by less than ``tolerance``, which they do after :func:`enough_rounds`; ``rounds``
    is for tests.
    """
    rounds = rounds or enough_rounds(damping, tolerance)
    edges = materialize(edges)
    leaving = materialize(edges.groupBy("src").agg(F.sum("n").alias("_out")))
    entering = materialize(edges.groupBy("dst").agg(F.sum("n").alias("_in")))
    shares = [(F.col("n") / F.col("_out")).alias("out_share"), (F.col("n") / F.col("_in")).alias("in_share")]
    both = materialize(edges.join(leaving, "src").join(entering, "dst").select("src", "dst", *shares))
    sums = seeds.agg(F.sum(F.col("trusted").cast("double")), F.sum(F.col("blocked").cast("double"))).first()
    part = lambda c, s: F.col(c).cast("double") / F.lit(s or 1.0)
    start = materialize(seeds.where("trusted or blocked").select("host", part("trusted", sums[0]).alias("t0"), part("blocked", sums[1]).alias("d0")))
    scores = start.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    if both.isEmpty():
        return scores.select("host", *[((1 - damping) * F.col(c)).alias(c) for c in ("trust", "distrust")])
    for _ in range(rounds):
        forth = both.join(scores.withColumnRenamed("host", "src"), "src").select(
            F.col("dst").alias("host"), (damping * F.col("trust") * F.col("out_share")).alias("trust"), F.lit(0.0).alias("distrust")
        )
        back = both.join(scores.withColumnRenamed("host", "dst"), "dst").select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust"), (damping * F.col("distrust") * F.col("in_share")).alias("distrust")
        )
        own = start.select("host", ((1 - damping) * F.col("t0")).alias("trust"), ((1 - damping) * F.col("d0")).alias("distrust"))
        new = materialize(forth.unionByName(back).unionByName(own).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        old = scores.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        moved = new.join(old, "host", "full").agg(F.sum(F.abs(zero("trust") - zero("t")) + F.abs(zero("distrust") - zero("d")))).first()[0]
        scores = new
        if (moved or 0.0) < tolerance:
            break
    return scores


def judged(df: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int | None = None, factor: float = FACTOR) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``df(page_id, url, html, ...)``.

    A url that is null or has no ``://`` has empty host and path; no rule fits it, and it is
    allowed, as is a host that neither trust nor distrust reaches. Null html has no links.
    Repeated rows repeat; an empty table gives an empty result; other columns are not
    looked at.
    """
    pages = df.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").alias("html"))
    ruled = pages.select("*", matched_rule(F.col("host"), F.col("path"), rules).alias("r"))
    part = lambda v: F.avg(F.when(F.col("r.verdict") == v, 1.0).otherwise(0.0)) > 0.5
    seeds = materialize(ruled.where("host <> ''").groupBy("host").agg(part("allow").alias("trusted"), part("block").alias("blocked")))
    scores = propagate(host_edges(pages), seeds, damping, rounds)
    blocked = materialize(scores.where(F.col("distrust") > factor * F.col("trust")).select("host", F.lit("block").alias("_method")))
    told = ruled.drop("html").join(blocked, "host", "left")
    verdict = F.coalesce("r.verdict", "_method", F.lit("allow"))
    return told.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
