"""Connected components of undirected links by seed-tree pruning.

In each round every vertex points itself and its neighbours to the least vertex around (minimum selection); a vertex that
nobody, itself included, chose as least drops out into a propagation forest below the least of its choices, and the chosen ones
are linked among themselves for the next round (pruning). The graph shrinks by a factor each round; when no link is left, the
vertices that remain are the seeds, and their identifiers flow down the forest from the last round to the first.

A vertex with very many links costs no task more than its share: minima are combined before the shuffle, and the joins
that hand a minimum to each link are plain equi-joins, whose hot partitions adaptive execution splits. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.store import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    ends: Column = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def _prune_round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of the next round and this round's part of the forest (child, parent)."""
    links = _both_ways(edges)
    least = links.groupBy("u").agg(F.min(F.least("u", "v")).alias("x"))
    chosen = materialize(
        links.join(least, "u").select(F.col("v").alias("u"), "x").unionByName(least).distinct(), "chosen")
    best = materialize(chosen.groupBy("u").agg(F.min("x").alias("m"), F.max(F.col("x") == F.col("u")).alias("stays")), "best")
    after = materialize(
        chosen.join(best.select("u", "m"), "u").where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), "links")
    discard(chosen)
    return after, best.where("not stays").select(F.col("u").alias("child"), F.col("m").alias("parent"))


def seed_labels(edges: DataFrame) -> DataFrame:
    """(id, seed) of every vertex of ``edges`` (a, b longs, a < b); the seed is the least id of its group."""
    forest, links, n = [], edges, 0
    while not links.isEmpty():
        after, dropped = _prune_round(links)
        forest.append(dropped)
        if n:
            discard(links)
        links, n = after, n + 1
    labels = None
    for dropped in reversed(forest):
        if labels is None:
            labels = dropped.select(F.col("child").alias("id"), F.col("parent").alias("seed"))
            continue
        above = labels.select(F.col("id").alias("parent"), "seed")
        below = dropped.join(above, "parent", "left").select(F.col("child").alias("id"), F.coalesce("seed", "parent").alias("seed"))
        labels = materialize(below.unionByName(labels), "labels")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "id bigint, seed bigint")
    return labels.unionByName(labels.select("seed").distinct().select(F.col("seed").alias("id"), "seed"))
