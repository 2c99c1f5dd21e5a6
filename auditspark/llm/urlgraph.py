"""URL filters: allow and block rules, and trust spread over the host link graph where no rule fits.

A personalised PageRank starts at trusted hosts (those with allowed pages) and follows links; a reversed one starts
at distrusted hosts (those with blocked pages) and goes against links, since whoever links to bad hosts is suspect.
Both teleport vectors are distributions: a seed weighs its share of all allowed, or of all blocked, pages. A host
without links gives its score back to them, which scales all scores alike, so it is done once at the end: the scores
are made distributions too. A host is blocked if distrust is more than `threshold` of its trust and distrust together;
a host that neither reaches is allowed. Only DataFrame functions are used.

Links are added up by host pair before anything else, so a hub is one row for each neighbour. Each round joins the
scores with the edges and adds up by host; rounds are checkpointed and end when no host's own trust or distrust moves
by more than `tolerance` of itself. A host that was not reached before moves by all it has, so every chain of links is
followed to its end (as far as a double holds the score, some 4,500 links), whatever else the table holds.

Cases: a null url or one without :// has an empty host and path, fits no rule, and is allowed; a null html has no
links; links within a host count for nothing; repeated pages count as often as they occur; an empty table gives an
empty table; among rules of equal length the first by text wins; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or protocol-relative target; its host is the group.
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""
DAMPING = 0.85
TOLERANCE = 1e-6
THRESHOLD = 0.5


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (text, verdict), or null."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, added up."""
    links = pages.select(
        F.col(host_col).alias("src"),
        F.explode(F.transform(F.regexp_extract_all(html_col, F.lit(_LINK), 1), lambda h: F.translate(h, _UPPER, _LOWER))).alias("dst"),
    )
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust), each adding up to 1 (0 without seeds), from edges (src, dst, links) and seeds (host, good, bad)."""
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("total"))
    forward = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("links") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("links") / F.col("total")).alias("d"))
    steps = cut(forward.unionByName(back))
    start = cut(_shares(seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))))
    scores, rounds = start, 0
    while True:
        moved = scores.join(steps, "host").select(F.col("to").alias("host"), (F.col("trust") * F.col("t") * damping).alias("trust"), (F.col("distrust") * F.col("d") * damping).alias("distrust"))
        before = scores.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        both = start.unionByName(moved).unionByName(before, allowMissingColumns=True)
        added = both.groupBy("host").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("trust", "distrust", "t0", "d0")])
        new = cut(added)
        moving = (F.abs(F.col("trust") - F.col("t0")) > tolerance * F.col("trust")) | (F.abs(F.col("distrust") - F.col("d0")) > tolerance * F.col("distrust"))
        done = new.where(moving).isEmpty()
        scores, rounds = new.select("host", "trust", "distrust"), rounds + 1
        if done:
            return _shares(scores)
        if rounds % 10 == 0:
            release(scores.sparkSession)


def _shares(scores: DataFrame) -> DataFrame:
    """Each score as its share of the total."""
    totals = scores.agg(F.sum("trust"), F.sum("distrust")).first()
    return scores.select("host", *[(F.col(c) / F.lit(t or 1.0)).alias(c) for c, t in zip(("trust", "distrust"), totals, strict=True)])


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """Per page: page_id, host, path, rule (text or null), verdict, trust, distrust."""
    seen = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html")
    )
    ruled = seen.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    edges = cut(host_edges(ruled))
    count = lambda v: F.sum(F.when(F.col("fit.verdict") == v, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(count("allow").alias("good"), count("block").alias("bad"))
    scores = propagate(edges, seeds)
    bad = F.coalesce(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False))
    return (
        ruled.drop("html")
        .join(scores, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.text").alias("rule"),
            F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
            F.coalesce("trust", F.lit(0.0)).alias("trust"),
            F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
        )
    )
