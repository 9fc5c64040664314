"""URL filters: rules by host and path, and trust propagated over host links.

Hosts that allow rules reach seed a personalised PageRank along links (what
trusted hosts link to is trusted); hosts that block rules reach seed one
against the links (what links to blocked hosts is distrusted). A page without
a rule gets its host's verdict: block where distrust outweighs trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scratch

DAMPING, CUT_EVERY = 0.85, 4
#: Scores are settled when none changes by more than this share of itself between two cuts.
TOLERANCE = 1e-4
#: Below this a score is too near to underflow to be followed further.
TINY = 1e-290
#: A host is blocked if its distrust exceeds this times its trust.
RATIO = 1.0
#: What the SQL stops at (its steps, and its least score); the operator has neither limit.
STEPS, LEAST = 12, 1e-9
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, or null.

    A rule (verdict, host, path) fits its host and all subdomains, for paths
    that start with its own. The list is a parameter and becomes part of the plan.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, links`` between different hosts, from the absolute links of the pages."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))).alias("href"))
    absolute = links.where(F.col("href").rlike(r"\A([A-Za-z][A-Za-z0-9+.\-]*:)?//")).select("src", host_of(F.regexp_replace("href", r"\A//", "http://")).alias("dst"))
    return absolute.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``host, trust, distrust`` from ``seeds`` (host, trust, distrust; each sums to 1) over ``edges``.

    One join and one sum a step for both: trust follows links by their share of
    the source's links, distrust goes back by their share of the target's.
    Mass at a host without further links is not passed on. Steps go on until
    every host that a seed reaches has its score, however far it is, and none
    changes by more than TOLERANCE of itself.
    """
    both = edges.select(F.lit("t").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "links").unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "links")
    )
    total = both.groupBy("kind", "from").agg(F.sum("links").alias("total"))
    flow = cut(both.join(total, ["kind", "from"]).select("kind", "from", "to", (F.col("links") / F.col("total")).alias("share")))
    seed = cut(seeds.select("host", F.explode(F.create_map(F.lit("t"), F.col("trust"), F.lit("d"), F.col("distrust"))).alias("kind", "score")).where("score > 0"))
    score, last = seed, None
    while last is None or not settled(score, last):
        last = score
        for _ in range(CUT_EVERY):
            passed = flow.join(score.withColumnRenamed("host", "from"), ["kind", "from"]).select("kind", F.col("to").alias("host"), (DAMPING * F.col("share") * F.col("score")).alias("score"))
            score = passed.unionByName(seed.withColumn("score", (1 - DAMPING) * F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        score = cut(score)
    either = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0))
    return score.groupBy("host").agg(either("t").alias("trust"), either("d").alias("distrust"))


def settled(score: DataFrame, last: DataFrame) -> bool:
    """Whether no score is new or differs from the last one by more than TOLERANCE of itself."""
    both = score.join(last.withColumnRenamed("score", "old"), ["kind", "host"], "left")
    moved = F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))) > TOLERANCE * F.col("score")
    return both.where(moved & (F.col("score") > TINY)).isEmpty()


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, host, path, rule, verdict`` per row of ``pages``; ``rule`` is null where none fits.

    Null urls, and those without ``://``, have an empty host and path, no rule
    and the verdict allow. Null html has no links. Repeated rows are judged each
    (and count as links each); other columns are not read. Without links,
    seeds or rows the scores are the seeds' own, or none: allow.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path")).withColumn("__rule", apply_rules(F.col("host"), F.col("path"), rules))
    per_host = judged.where("host <> '' and __rule is not null").groupBy("host").agg(
        F.count_if(F.col("__rule.verdict") == "allow").alias("t"), F.count_if(F.col("__rule.verdict") == "block").alias("d")
    )
    with scratch() as kept:
        per_host = cut(per_host)
        sums = per_host.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()  # one row
        share = lambda c: F.col(c) / F.lit(max(1, sums[c] or 0))
        scores = propagate(host_edges(pages, url_col, html_col), per_host.select("host", share("t").alias("trust"), share("d").alias("distrust")))
        blocked = cut(scores.where((F.col("distrust") > RATIO * F.col("trust")) & (F.col("distrust") > 0)).select("host", F.lit("block").alias("__of_host")))
        kept.append(blocked)
    verdict = F.coalesce("__rule.verdict", "__of_host", F.lit("allow"))
    return judged.join(blocked, "host", "left").select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))
