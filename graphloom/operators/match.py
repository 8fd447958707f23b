"""Pattern matching: hops, optional and negated hops, and paths of variable length.

Relationships are distinct within one pattern (trails); nodes may repeat. Undirected hops see each
relationship from both ends, a self-loop once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.store import discard, materialize
from graphloom.model import Graph, with_both_ends
from graphloom.operators.components import seed_labels


def oriented(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(edge_id, u, v, type): relationships as steps from u to v; direction is out, in or both."""
    out = F.struct(F.col("src").alias("u"), F.col("dst").alias("v"))
    back = F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))
    steps = {"out": F.array(out), "in": F.array(back), "both": F.when(F.col("src") == F.col("dst"), F.array(out)).otherwise(F.array(out, back))}[direction]
    return edges.select(F.col("id").alias("edge_id"), "type", F.explode(steps).alias("s")).select("edge_id", "s.u", "s.v", "type")


def hop(graph: Graph, start: DataFrame, types: tuple[str, ...] | None = None, direction: str = "out", end: DataFrame | None = None) -> DataFrame:
    """(start_id, edge_id, type, end_id) of all steps from nodes of ``start`` to nodes of ``end`` (any node of the graph by default)."""
    steps = oriented(graph.links(*types or ()), direction)
    from_start = steps.join(start.select(F.col("id").alias("u")), "u")
    to = (graph.nodes if end is None else end).select(F.col("id").alias("v"))
    return from_start.join(to, "v").select(F.col("u").alias("start_id"), "edge_id", "type", F.col("v").alias("end_id"))


def optional_hop(graph: Graph, start: DataFrame, types: tuple[str, ...] | None = None, direction: str = "out", end: DataFrame | None = None) -> DataFrame:
    """As ``hop``, with one row of nulls for each start node without a step."""
    return start.select(F.col("id").alias("start_id")).join(hop(graph, start, types, direction, end), "start_id", "left")


def with_hop(graph: Graph, start: DataFrame, types: tuple[str, ...] | None = None, direction: str = "out", end: DataFrame | None = None) -> DataFrame:
    """Rows of ``start`` that have such a step (EXISTS)."""
    return start.join(hop(graph, start, types, direction, end).select(F.col("start_id").alias("id")), "id", "left_semi")


def without_hop(graph: Graph, start: DataFrame, types: tuple[str, ...] | None = None, direction: str = "out", end: DataFrame | None = None) -> DataFrame:
    """Rows of ``start`` that have no such step (NOT EXISTS)."""
    return start.join(hop(graph, start, types, direction, end).select(F.col("start_id").alias("id")), "id", "left_anti")


def isolated(graph: Graph) -> DataFrame:
    """Nodes without any relationship."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return graph.nodes.join(ends, "id", "left_anti")


def paths(graph: Graph, start: DataFrame, lo: int, hi: int, types: tuple[str, ...] | None = None, direction: str = "out") -> DataFrame:
    """(start_id, end_id, length, node_ids, edge_ids) of all trails of lo to hi relationships; a union of unrolled joins."""
    steps = oriented(graph.typed(*types) if types else graph.edges, direction)
    at = steps.join(start.select(F.col("id").alias("u")).distinct(), "u").select(F.col("u").alias("start_id"), F.col("v").alias("end_id"), F.array("u", "v").alias("node_ids"), F.array("edge_id").alias("edge_ids"))
    found = at if lo <= 1 else None
    for n in range(2, hi + 1):
        nxt = steps.select(F.col("u").alias("end_id"), F.col("v").alias("next_id"), "edge_id")
        at = at.join(nxt, "end_id").where(~F.array_contains("edge_ids", F.col("edge_id"))).select(
            "start_id", F.col("next_id").alias("end_id"), F.array_append("node_ids", F.col("next_id")).alias("node_ids"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"))
        if n >= lo:
            found = at if found is None else found.unionByName(at)
    return found.select("start_id", "end_id", F.size("edge_ids").alias("length"), "node_ids", "edge_ids")


def all_paths(graph: Graph, start: DataFrame, types: tuple[str, ...] | None = None, direction: str = "out", max_rounds: int = 10_000) -> DataFrame:
    """As ``paths`` from one relationship on without an upper bound; ends when no trail grows. Each round is written, so lineage stays short."""
    steps = oriented(graph.typed(*types) if types else graph.edges, direction)
    nxt = steps.select(F.col("u").alias("end_id"), F.col("v").alias("next_id"), "edge_id")
    at = materialize(steps.join(start.select(F.col("id").alias("u")).distinct(), "u").select(F.col("u").alias("start_id"), F.col("v").alias("end_id"), F.array("u", "v").alias("node_ids"), F.array("edge_id").alias("edge_ids")), "trails")
    found, rounds = at, 0
    while rounds < max_rounds:
        at = materialize(at.join(nxt, "end_id").where(~F.array_contains("edge_ids", F.col("edge_id"))).select(
            "start_id", F.col("next_id").alias("end_id"), F.array_append("node_ids", F.col("next_id")).alias("node_ids"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids")), "trails")
        if at.isEmpty():
            return found.select("start_id", "end_id", F.size("edge_ids").alias("length"), "node_ids", "edge_ids")
        found, rounds = found.unionByName(at), rounds + 1
    raise RuntimeError(f"trails still grow after {max_rounds} rounds")


def cycles(graph: Graph, types: tuple[str, ...], lo: int = 2, hi: int = 5) -> DataFrame:
    """(start_id, length, node_ids): closed trails, each rotation a row."""
    return paths(graph, graph.nodes, lo, hi, types).where("start_id = end_id").select("start_id", "length", "node_ids")


def on_cycles(graph: Graph, types: tuple[str, ...]) -> DataFrame:
    """Edges left when sources and sinks are peeled off again and again, self-loops aside: not empty exactly if a closed trail of two or more relationships exists."""
    edges = materialize(graph.typed(*types).where("src <> dst").select("id", "src", "dst"), "peel")
    n = edges.count()
    while n:
        left = materialize(
            edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("id", "src", "dst"), "peel")
        m = left.count()
        discard(edges)
        edges = left
        if m == n:
            break
        n = m
    return edges


def components(graph: Graph) -> DataFrame:
    """(id, component): the least id that undirected relationships tie a node to; isolated nodes are their own. By seed-tree pruning."""
    links = with_both_ends(graph.edges, graph.nodes).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    labels = materialize(seed_labels(materialize(links, "links")), "components")
    return graph.nodes.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("seed", "id").alias("component"))


def degree(graph: Graph) -> DataFrame:
    """(id, degree) of nodes with relationships; a self-loop counts once."""
    return oriented(graph.edges, "both").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))


def condition_hops(graph: Graph, start: DataFrame, missing: list[tuple[tuple[str, ...], str, tuple[str, ...] | None]]) -> DataFrame:
    """Rows of ``start`` for which none of the (types, direction, end labels) patterns holds."""
    for types, direction, labels in missing:
        start = without_hop(graph, start, types, direction, graph.labelled(*labels) if labels else None)
    return start


def equal_classes(nodes: DataFrame, key: Column) -> DataFrame:
    """(id, first_id, key): nodes that share labels and key with others, each with the least id of its class; no class is multiplied out into pairs."""
    k = nodes.select("id", "labels", key.alias("key")).where("key is not null")
    classes = k.groupBy("labels", "key").agg(F.min("id").alias("first_id"), F.count_distinct("id").alias("n")).where("n > 1").drop("n")
    return k.distinct().join(classes, ["labels", "key"]).select("id", "first_id", "key")
