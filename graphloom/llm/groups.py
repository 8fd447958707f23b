"""Groups of records tied together by accepted pairwise matches (connected components).

The groups are found by seed-tree pruning, see ``operators/components.py``: vertices connect to neighbourhood minima, non-minimal
vertices drop out into a propagation forest, then seed identifiers flow down that forest.

Descriptions become ids that keep their byte order, so rounds shuffle two longs a link and the least
id of a group is its least description. A vertex with very many links costs no task more than its
share: minima are combined before the shuffle, and the joins that hand a minimum to each link are plain
equi-joins, whose hot partitions adaptive execution splits. All rounds are written to the shared
folder, so lost executors cost a task, not the chain of rounds.

Defined cases: a row is accepted when both texts are neither null nor empty and differ and the confidence is a number
of at least ``threshold``; null and NaN are refused; repeated and reversed pairs count once; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.store import discard, materialize
from graphloom.operators.components import seed_labels


def accepted_pairs(matches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Distinct accepted pairs (a, b) with a < b by UTF-8 bytes."""
    a, b, c = F.col("entity_a_desc"), F.col("entity_b_desc"), F.col("confidence")
    good = (a != "") & (b != "") & (a != b) & ~F.isnan(c) & (c >= threshold)
    return matches.where(good).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def ordered_ids(values: DataFrame) -> DataFrame:
    """Distinct ``v`` with a long ``id`` that grows with v. Sorted by range, numbered where they lie, then written, so the numbers hold."""
    return materialize(values.distinct().orderBy("v").withColumn("id", F.monotonically_increasing_id()), "ids")


def match_groups(matches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(group_desc, entity_desc): every description in an accepted row with the least one of its group."""
    pairs = materialize(accepted_pairs(matches, threshold), "pairs")
    ids = ordered_ids(pairs.select(F.explode(F.array("a", "b")).alias("v")))
    a, b = (ids.select(F.col("v").alias(k), F.col("id").alias(f"{k}_id")) for k in "ab")
    edges = materialize(pairs.join(a, "a").join(b, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "edges")
    labels = materialize(seed_labels(edges), "labels")
    discard(edges)
    discard(pairs)
    named = labels.join(ids.withColumnRenamed("v", "entity_desc"), "id").select("seed", "entity_desc")
    seeds = labels.select("seed").distinct().join(ids.select(F.col("id").alias("seed"), F.col("v").alias("group_desc")), "seed")
    return named.join(seeds, "seed").select("group_desc", "entity_desc")
