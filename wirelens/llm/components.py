"""Connected components of links, and the search for links inside candidate groups without all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.frames import cut

#: Candidate pairs a group may have for each of its members before an exact rule thins them.
PAIRS_A_MEMBER = 6


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u, v) is either on the left, and once, or on the right."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("left"), F.lit(0).alias("right"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("left"), F.lit(1).alias("right")))
    each = ends.groupBy("node").agg(F.sum("left").alias("left"), F.max("right").alias("right"))
    return each.filter("left > 1 OR (left = 1 AND right = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node in ``links`` (a, b).

    Alternating large-star and small-star rounds: each takes minima by node and
    joins them to the edges, so a hub with a third of all links is a skewed
    join key whose other side is one row. Every round is written to the shared
    folder; edges that are stars around their smallest node are done.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # links that meet here are told apart once, below
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def leader_pairs(members: DataFrame) -> DataFrame:
    """Each member (bucket, node) paired with the leader of its bucket: linear in the members.

    The leader is the node that shares buckets with the most others, so the
    original of a group of edited copies leads, not one of the copies.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"))
    weights = members.join(sizes, "bucket").groupBy("node").agg(F.sum("m").alias("w"))
    lead = members.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("w", "node"))["node"].alias("lead"))
    both = members.join(lead, "bucket").filter("node <> lead")
    return both.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    return members.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))


def open_groups(members: DataFrame) -> DataFrame:
    """Buckets whose members (bucket, node, comp) are in several components: the largest one, and pairs across."""
    by_comp = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    sums = by_comp.groupBy("bucket").agg(
        F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("k")
    )
    return sums.filter("k > 1").select("bucket", "m", F.col("top.comp").alias("top"), ((F.col("m") * F.col("m") - F.col("same")) / 2).alias("across"))


def cross_pairs(members: DataFrame, groups: DataFrame, facts: DataFrame, may_link: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of members of one bucket in different components that ``may_link`` doesn't rule out by their facts.

    Members outside a bucket's largest component meet all members, so a big
    component costs one comparison for each of its members and each outsider.
    ``facts`` has (node, fact).
    """
    # written once, as both sides of the join read it
    marked = cut(members.join(groups.select("bucket", "top"), "bucket").join(facts, "node"))
    minor = marked.filter("comp <> top").select("bucket", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("fact").alias("fx"))
    major = marked.select("bucket", F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("fact").alias("fy"))
    fits = (minor["bucket"] == major["bucket"]) & (F.col("cx") != F.col("cy")) & may_link(F.col("fx"), F.col("fy"))
    return minor.join(major, fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def grouped_links(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    rest: Callable[[DataFrame], DataFrame],
    facts: DataFrame,
    may_link: Callable[[Column, Column], Column],
) -> DataFrame:
    """Links (a, b) among members (bucket, node), enough for the true components of all pairs that share a bucket.

    Every member is compared with its bucket's leader first. A bucket whose
    members are then in one component is done, however large it is. In the
    others, pairs across components are compared, unless these are many times
    the members: the members (bucket, node, comp) of such buckets go to
    ``rest``, which makes fewer candidate pairs of them by an exact rule of its
    own. ``may_link`` of two facts is true for every linked pair. Nothing is
    capped.
    """
    pairs = cut(leader_pairs(members))
    links = cut(verify(pairs))
    labelled = cut(_labelled(members, components(links)))
    groups = cut(open_groups(labelled))
    heavy = F.col("across") > PAIRS_A_MEMBER * F.col("m")
    more = cross_pairs(labelled, groups.filter(~heavy), facts, may_link)
    many = groups.filter(heavy).select("bucket")
    if not many.isEmpty():
        more = more.unionByName(rest(cut(labelled.join(many, "bucket", "left_semi"))))
    return links.unionByName(cut(verify(cut(more.distinct().join(pairs, ["a", "b"], "left_anti")))))
