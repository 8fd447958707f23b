"""Change events between full snapshots of a graph.

Every item (node or relationship) of a graph gets validity intervals: maximal runs of consecutive
snapshots in which it is there with one content hash (gaps and islands). The start of an interval
that follows no other directly is an ``added`` event, its end before the last snapshot without a
direct successor a ``removed`` event, and two intervals that touch make a ``changed`` event.

Which delivery of a snapshot counts is decided from ids and counts alone, by a scan that reads nothing else. Items are
hashed where their rows lie; before the first shuffle, all snapshots of one content are folded into masks of 64 snapshots, so
that an item that stays as it was for a thousand snapshots is a few rows, and no array is ever shuffled. The table of
deliveries (some bytes a snapshot) is broadcast only below a checked number of rows. A graph with a third of
all snapshots is spread over its items.

Defined cases: snapshots are ordered by instant, ties by snapshot_id; a null or unreadable timestamp,
a null graph_id or a null snapshot_id leaves the row out; a delivery with fewer array entries than
node_count or rel_count (null counts as 0) is incomplete and dropped when the same snapshot_id has a full one, else the
longest delivery stands in; of several deliveries of one snapshot_id the one with most entries counts, ties by a hash of the ids, and what is equal
even then is taken together; a null array is empty; items without id are ignored; of differing repeats of an id the least
hash counts; further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.store import small_enough

#: Properties that say when a row was made, not what it says.
VOLATILE = ("extracted_at",)
#: Snapshots in one mask.
MASK = 64


def _entries(props: str, ignored: tuple[str, ...]) -> Column:
    """Sorted entries without nulls and ignored keys; none for a null map."""
    kept = F.filter(F.map_entries(props), lambda e: e["value"].isNotNull() & ~e["key"].isin(*ignored))
    return F.array_sort(F.coalesce(kept, F.expr("cast(array() as array<struct<key:string,value:string>>)")))


def _digest(*parts: Column) -> Column:
    """64 bits; only versions of one item are ever compared. Null counts as a value of its own."""
    return F.xxhash64(*[x for p in parts for x in (p.isNull(), p)])


def _counted(snapshots: DataFrame) -> DataFrame:
    """``snapshots`` with ``at`` and ``rank``, by which the delivery that counts is chosen; rows that cannot be placed are left out."""
    size = lambda c: F.greatest(F.coalesce(F.size(F.col(c)), F.lit(0)), F.lit(0))
    full = (size("nodes") >= F.coalesce("node_count", F.lit(0))) & (size("relationships") >= F.coalesce("rel_count", F.lit(0)))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    rank = F.struct(full.alias("full"), (size("nodes") + size("relationships")).alias("n"), F.xxhash64(ids("nodes"), ids("relationships")).alias("tie"))
    return snapshots.withColumns({"at": F.expr("try_cast(trim(timestamp) as timestamp)"), "rank": rank}).where("graph_id is not null and snapshot_id is not null and at is not null")


def delivery_heads(snapshots: DataFrame) -> DataFrame:
    """(graph_id, snapshot_id, rank, at, seq) of the delivery that counts; seq is its position by time within the graph."""
    best = _counted(snapshots).groupBy("graph_id", "snapshot_id").agg(F.max(F.struct("rank", "at")).alias("d")).select("graph_id", "snapshot_id", "d.*")
    return best.withColumn("seq", F.row_number().over(Window.partitionBy("graph_id").orderBy("at", "snapshot_id")))


def complete_deliveries(snapshots: DataFrame) -> DataFrame:
    """One row (graph_id, snapshot_id, at, nodes, relationships) per snapshot, whole; of equal deliveries the one with the least content."""
    rows = _counted(snapshots).select("graph_id", "snapshot_id", "at", "rank", F.when(F.col("nodes").isNull(), F.expr("slice(nodes, 1, 0)")).otherwise(F.col("nodes")).alias("nodes"), "relationships")
    best = rows.groupBy("graph_id", "snapshot_id").agg(F.max_by(F.struct("at", "nodes", "relationships"), F.struct("rank", F.xxhash64(F.to_json(F.struct("nodes", "relationships"))))).alias("d"))
    return best.select("graph_id", "snapshot_id", "d.*")


def snapshot_items(deliveries: DataFrame, keys: tuple[str, ...] = ("graph_id", "snapshot_id"), ignored: tuple[str, ...] = VOLATILE) -> DataFrame:
    """(keys, item_kind, item_id, h): every item of every row, with a hash of what counts as its content."""
    labels = lambda x: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(x, F.array().cast("array<string>")))))
    nodes = deliveries.select(*keys, F.explode("nodes").alias("i")).select(*keys, F.lit("node").alias("item_kind"), F.col("i.id").alias("item_id"), _digest(labels(F.col("i.labels")), _entries("i.props", ignored)).alias("h"))
    rels = deliveries.select(*keys, F.explode("relationships").alias("i")).select(
        *keys, F.lit("relationship").alias("item_kind"), F.col("i.id").alias("item_id"), _digest(F.col("i.type"), F.col("i.start_id"), F.col("i.end_id"), _entries("i.props", ignored)).alias("h"))
    return nodes.unionByName(rels).where("item_id is not null")


def snapshot_changes(snapshots: DataFrame, ignored: tuple[str, ...] = VOLATILE, small: int = 500_000) -> DataFrame:
    """(graph_id, snapshot_id, item_kind, item_id, change), see the module."""
    heads = delivery_heads(snapshots)
    placed = heads.select("graph_id", "snapshot_id", "rank", "seq")
    rows = _counted(snapshots).select("graph_id", "snapshot_id", "rank", "nodes", "relationships")
    rows = rows.join(F.broadcast(placed) if small_enough(snapshots.select("snapshot_id"), small) else placed, ["graph_id", "snapshot_id", "rank"])
    item = ["graph_id", "item_kind", "item_id"]
    masks = snapshot_items(rows, ("graph_id", "seq"), ignored).withColumn("chunk", F.floor(F.col("seq") / MASK)).groupBy(*item, "h", "chunk").agg(F.bit_or(F.expr(f"shiftleft(1L, cast(seq % {MASK} as int))")).alias("mask"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(MASK - 1)), lambda i: F.getbit("mask", i) == 1)
    timed = masks.repartition(*item).select(*item, "h", F.explode(F.transform(bits, lambda i: F.col("chunk") * MASK + i)).alias("seq"))

    run = Window.partitionBy(*item).orderBy("seq", "h")
    timed = timed.withColumn("before", F.lag("seq").over(run)).where("before is null or before <> seq")
    order = Window.partitionBy(*item).orderBy("seq")
    # an interval starts where the snapshot before lacks the item or has it otherwise, and ends where the next one does
    timed = timed.withColumns({"before": F.lag("seq").over(order), "h_before": F.lag("h").over(order), "after": F.lead("seq").over(order)})
    touches = F.coalesce(F.col("before") == F.col("seq") - 1, F.lit(False))
    event = lambda seq, kind: F.struct(seq.alias("seq"), F.lit(kind).alias("change"))
    events = timed.select(*item, F.explode(F.array_compact(F.array(
        F.when(touches & (F.col("h_before") != F.col("h")), event(F.col("seq"), "changed")).when(~touches & (F.col("seq") > 1), event(F.col("seq"), "added")),
        F.when(F.coalesce(F.col("after") > F.col("seq") + 1, F.lit(True)), event(F.col("seq") + 1, "removed")),
    ))).alias("e")).select(*item, "e.*")
    # what would be removed after the last snapshot finds no head
    return events.join(placed.drop("rank"), ["graph_id", "seq"]).select("graph_id", "snapshot_id", "item_kind", "item_id", "change")
