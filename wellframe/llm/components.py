"""Connected components of a graph given as a DataFrame of edges.

Every node first takes the smallest of its neighbours and itself in its place, which leaves one node of a star and few of most
groups.  What edges are left between these is labelled: labels are lowered along edges, then through the labels
themselves (pointer jumping), so that the number of rounds grows with the logarithm of a component's diameter.  Each round is
a written table: nothing is collected, and a lost executor repeats one round at most.  A hub costs a split join, as its rows
meet in a sort-merge join whose sides Spark can cut, and minima are taken before rows move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.llm.staging import discard, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node of its component, for every node of an edge.  Null ends are dropped."""
    pairs = staged(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"), "cc-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    places = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("place")), "cc-places")
    of = lambda x: places.select(F.col("node").alias(x), F.col("place").alias(f"p{x}"))
    rest = pairs.join(of("a"), "a").join(of("b"), "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
    rest = staged(rest.distinct(), "cc-rest")
    labels = _lowered(rest)
    out = places.join(labels.select(F.col("node").alias("place"), "label"), "place", "left").select("node", F.coalesce("label", "place").alias("label"))
    out = staged(out, "components")
    discard(pairs, places, rest, labels)
    return out


def _lowered(edges: DataFrame) -> DataFrame:
    """node, label of every node of the distinct edges (a, b)."""
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = staged(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-low")
        jump = low.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = low.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label"))
        new = staged(new, "cc-labels")
        discard(low, labels)
        labels = new
        if new.where("label <> old").isEmpty():
            discard(both)
            return new


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) and further ``links`` (a, b) between any nodes: the labels of both together."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    further = components(between)
    known = labels.join(further.select(F.col("node").alias("label"), F.col("label").alias("low")), "label", "left").select("node", F.coalesce("low", "label").alias("label"))
    new = further.join(labels.select("node"), "node", "left_anti")
    out = staged(known.unionByName(new), "components")
    discard(further)
    return out
