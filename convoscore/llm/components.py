"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Minima are aggregated before they are shuffled and joined back, so that a vertex with a third of all edges is split like
any skewed join.  Lineage is cut after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) and least, the smallest of u and its neighbours, for every direction given in ``pairs``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("w"), F.least("u", "least").alias("least"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "least")


def _settled(state: DataFrame) -> bool:
    """Whether every component is a star around its smallest node: each u has one v, and no v is a u."""
    twice = state.groupBy("u").count().filter("count > 1").select("u")
    inner = state.join(state.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return twice.union(inner).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, label long): every node of an edge with the smallest node that it is linked with, itself included.

    Loops, repeated edges and nulls are ignored; without edges the result is empty.
    """
    state = cut(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v").distinct())
    while not _settled(state):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u > v").distinct()
        small = _stars(large)
        small = small.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*")
        before, state = state, cut(small.filter("u > v").distinct())
        free(before)
    roots = state.select("v").distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links: components of the links between labels, carried over to the nodes.  ``labels`` is
    not to be read any more after that, if it was ``cut`` and there were links."""
    if links.isEmpty():
        return labels
    here = labels.select(F.col("node"), F.col("label"))
    ends = links.select("a", "b").join(here.toDF("a", "la"), "a", "left").join(here.toDF("b", "lb"), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    more = cut(components(ends))
    moved = here.join(more.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = more.join(here.select("node"), "node", "left_anti")
    out = cut(moved.unionByName(fresh))
    free(more, labels)
    return out
