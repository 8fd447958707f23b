"""Creating, merging, changing and deleting; every function gives a new graph.

New ids follow the largest one in use, in the order of their keys, so a merge gives the same ids again on the same input.
Batches are applied in input order (``seq``): of two writes of a property the later one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.store import materialize
from graphloom.model import Graph

_EMPTY = "map<string,string>"


def latest_props(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One row per key with all properties, each from the last row that has it; nulls do not overwrite."""
    flat = rows.select(*keys, F.col(seq).alias("_seq"), F.explode("props").alias("k", "v")).where("v is not null")
    last = flat.groupBy(*keys, "k").agg(F.max_by("v", "_seq").alias("v"))
    props = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    every = rows.select(*keys).distinct()
    return every.join(props, keys, "left").withColumn("props", F.coalesce("props", F.create_map().cast(_EMPTY)))


def over(old: Column, new: Column) -> Column:
    """Properties of ``new`` over those of ``old``."""
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast(_EMPTY)), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), F.coalesce(new, F.create_map().cast(_EMPTY)))


def create(graph: Graph, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    return Graph(graph.nodes.unionByName(nodes, allowMissingColumns=True) if nodes is not None else graph.nodes, graph.edges.unionByName(edges, allowMissingColumns=True) if edges is not None else graph.edges)


def numbered(rows: DataFrame, order: list[str], after: int) -> DataFrame:
    """Rows with new ids after ``after``: numbered within range partitions, offset by the counts of those before."""
    spread = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    counts = {r[0]: (r[1], r[2]) for r in spread.groupBy("_p").agg(F.count("*"), F.min("_m")).collect()}  # a row a partition
    base, offsets = after, {}
    for p in sorted(counts):
        offsets[p] = base - counts[p][1]
        base += counts[p][0]
    if not offsets:
        return spread.withColumn("id", F.lit(0).cast("bigint")).drop("_p", "_m")
    add = F.create_map(*[F.lit(x) for p, o in offsets.items() for x in (p, o)])
    return spread.withColumn("id", (F.col("_m") + add[F.col("_p")] + 1).cast("bigint")).drop("_p", "_m")


def merge_nodes(graph: Graph, rows: DataFrame, key: Column) -> tuple[Graph, DataFrame]:
    """Upsert rows (label, merge_key, props, seq): properties overwrite, absent ones stay. Gives the graph and (label, merge_key, id, created)."""
    incoming = latest_props(rows, ["label", "merge_key"])
    known = graph.nodes.select("*", key.alias("merge_key"))
    ids = known.where("merge_key is not null").groupBy("label", "merge_key").agg(F.min("id").alias("id"))
    joined = materialize(incoming.join(ids, ["label", "merge_key"], "left"), "merge")
    top = graph.nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(joined.where("id is null").drop("id"), ["label", "merge_key"], top)
    changed = joined.where("id is not null").select(F.col("label").alias("_l"), F.col("merge_key").alias("_k"), F.col("props").alias("_new"))
    old = known.join(changed, (F.col("label") == F.col("_l")) & (F.col("merge_key") == F.col("_k")), "left")
    updated = old.withColumn("props", F.when(F.col("_new").isNull(), F.col("props")).otherwise(over(F.col("props"), F.col("_new")))).select(*graph.nodes.columns)
    new = fresh.select("id", F.array("label").alias("labels"), "label", "props")
    merged = Graph(updated.unionByName(new, allowMissingColumns=True), graph.edges)
    return merged, joined.where("id is not null").select("label", "merge_key", "id", F.lit(False).alias("created")).unionByName(fresh.select("label", "merge_key", "id", F.lit(True).alias("created")))


def merge_edges(graph: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """Upsert rows (src, type, dst, props, seq). Gives the graph and the created edges."""
    keys = ["src", "type", "dst"]
    incoming = latest_props(rows, keys)
    fresh = numbered(incoming.join(graph.edges.select(*keys), keys, "left_anti"), keys, graph.edges.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    old = graph.edges.join(incoming.withColumnRenamed("props", "_new"), keys, "left").withColumn("props", F.when(F.col("_new").isNull(), F.col("props")).otherwise(over(F.col("props"), F.col("_new")))).select(*graph.edges.columns)
    created = fresh.select("id", "src", "dst", "type", "props")
    return Graph(graph.nodes, old.unionByName(created)), created


def set_props(graph: Graph, where: Column, values: dict[str, str | Column]) -> Graph:
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    return Graph(graph.nodes.withColumn("props", F.when(where, over(F.col("props"), new)).otherwise(F.col("props"))), graph.edges)


def detach_delete(graph: Graph, where: Column) -> Graph:
    """Delete nodes for which ``where`` is true, and all their relationships."""
    gone = graph.nodes.where(where).select("id")
    kept = graph.nodes.where(~F.coalesce(where, F.lit(False)))
    edges = graph.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(*graph.edges.columns)
    return Graph(kept, edges)


def duplicate_keys(nodes: DataFrame, label: str, key: Column) -> DataFrame:
    """(merge_key, n): keys that a uniqueness constraint on a label would refuse."""
    return nodes.where(F.array_contains("labels", label)).groupBy(key.alias("merge_key")).agg(F.count("*").alias("n")).where("merge_key is not null and n > 1")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
