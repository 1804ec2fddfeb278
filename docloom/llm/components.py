"""Connected components of a table of links, by contraction on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Rounds after which the contraction is taken not to end (each leaves about half of the nodes at most).
MOST_ROUNDS = 60


def _place(column: str):
    """The order in which nodes are preferred: by hash, so that ids in sequence make no long chains."""
    return F.xxhash64(column, F.lit(71))


def labels(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): for every node of the links one node of its component, the same for all. Links of a node to itself and nulls count for nothing.

    In a round every node learns the first node (by hash) of its neighbourhood, then takes the first that a neighbour
    has learnt; links are renamed by what was taken, and those within a name go, until none is left. Both steps aggregate with
    a map-side part, so a node with very many neighbours costs no task more than its share."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = checkpoint(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    found = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    for _ in range(MOST_ROUNDS):
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min_by("v", _place("v")).alias("v"))
        low = low.select("u", F.when(_place("v") < _place("u"), F.col("v")).otherwise(F.col("u")).alias("m"))
        heard = both.join(low, "u").select(F.col("v").alias("u"), "m").unionAll(low)
        taken = checkpoint(heard.groupBy("u").agg(F.min_by("m", _place("m")).alias("m")))
        found = checkpoint(found.join(taken, F.col("label") == F.col("u"), "left").select("node", F.coalesce("m", "label").alias("label")))
        renamed = pairs.join(taken.withColumnRenamed("m", "x"), "u").join(taken.select(F.col("u").alias("v"), F.col("m").alias("y")), "v").where("x <> y")
        pairs = checkpoint(renamed.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
        if pairs.isEmpty():
            return found
    raise RuntimeError(f"the components are not settled after {MOST_ROUNDS} rounds")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): for every node of the links, the least node that it reaches."""
    found = labels(links, a, b)
    least = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(least, "label").select("node", "component")
