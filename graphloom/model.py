"""Property graphs as two DataFrames.

nodes: id, labels array<string>, label (= labels[0]), props map<string,string>, source, source_type,
confidence double, confidence_raw, extracted_at, ontology_id
edges: id, src, dst, type, props map<string,string>
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.MapType(T.StringType(), T.StringType())
NODE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("label", T.StringType()), T.StructField("props", STRINGS),
    T.StructField("source", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("confidence_raw", T.StringType()),
    T.StructField("extracted_at", T.StringType()), T.StructField("ontology_id", T.StringType())])
EDGE_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("type", T.StringType()), T.StructField("props", STRINGS)])

#: The property chains that identify an entity; the first that is there counts.
DESC_LINEAR = ("description", "name_or_description", "value", "summary")
DESC_PROBE = ("description", "name_or_description", "value")
DESC_FULL = ("description", "name_or_description", "name", "value", "summary")


def prop(name: str, props: str | Column = "props") -> Column:
    return (F.col(props) if isinstance(props, str) else props)[name]


def desc_linear(props: str = "props", node_id: str = "id") -> Column:
    """As in triples: no name, at last the id."""
    return F.coalesce(*[prop(k, props) for k in DESC_LINEAR], F.col(node_id).cast("string"))


def desc_probe(props: str = "props", default: str | None = None) -> Column:
    return F.coalesce(*[prop(k, props) for k in DESC_PROBE], *([F.lit(default)] if default is not None else []))


def desc_full(props: str = "props", default: str | None = None) -> Column:
    return F.coalesce(*[prop(k, props) for k in DESC_FULL], *([F.lit(default)] if default is not None else []))


def desc_truthy(props: str = "props") -> Column:
    """As ``desc_full``, but empty strings are passed over too."""
    return F.coalesce(*[F.nullif(prop(k, props), F.lit("")) for k in DESC_FULL])


def has_label(*labels: str) -> Column:
    """Label membership, not the first label."""
    return F.array_contains("labels", labels[0]) if len(labels) == 1 else F.arrays_overlap("labels", F.array(*map(F.lit, labels)))


@dataclass(frozen=True)
class Graph:
    """An immutable graph; every change makes a new one, so a snapshot is a reference.

    ``node_rows`` and ``edge_rows`` are the rows that ``nodes`` and ``edges`` come from while exact repeats are still among them:
    labels and types are then chosen before repeats are taken out, so that the filter stands at the scan and only what is asked for is shuffled.
    """

    nodes: DataFrame
    edges: DataFrame
    node_rows: DataFrame | None = None
    edge_rows: DataFrame | None = None

    def labelled(self, *labels: str) -> DataFrame:
        return self.nodes.where(has_label(*labels)) if self.node_rows is None else self.node_rows.where(has_label(*labels)).dropDuplicates(["id"])

    def links(self, *types: str) -> DataFrame:
        """Relationships of these types (of all, if none is given), for patterns that look both ends up themselves: those that point nowhere are still there."""
        rows = self.edges if self.edge_rows is None else self.edge_rows
        rows = rows.where(F.col("type").isin(*types)) if types else rows
        return rows if self.edge_rows is None else rows.dropDuplicates(["id"])

    def typed(self, *types: str) -> DataFrame:
        if self.edge_rows is None:
            return self.edges.where(F.col("type").isin(*types))
        return with_both_ends(self.links(*types), self.node_rows if self.node_rows is not None else self.nodes)

    def where_nodes(self, condition: Column) -> "Graph":
        return Graph(self.nodes.where(condition), self.edges)

    def map(self, change: Callable[["Graph"], "Graph"]) -> "Graph":
        return change(self)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships whose ends are nodes."""
    ids = lambda c: nodes.select(F.col("id").alias(c))
    return edges.join(ids("src"), "src", "left_semi").join(ids("dst"), "dst", "left_semi").select("id", "src", "dst", "type", "props")


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """A graph from Python rows; missing fields are null and label is labels[0]."""
    n = [tuple((r.get("labels") or [None])[0] if f == "label" and "label" not in r else r.get(f) for f in NODE_SCHEMA.names) for r in nodes]
    e = [tuple(r.get(f, {} if f == "props" else None) for f in EDGE_SCHEMA.names) for r in edges]
    return Graph(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA))


def node(node_id: int, *labels: str, **props: object) -> dict:
    """A node row; source fields are taken from the properties of the same name."""
    row = {k: props.pop(k) for k in ("source", "source_type", "confidence", "confidence_raw", "extracted_at", "ontology_id") if k in props}
    return {"id": node_id, "labels": list(labels), "props": {k: None if v is None else str(v) for k, v in props.items()}} | row


def edge(edge_id: int, src: int, type_: str, dst: int, **props: object) -> dict:
    return {"id": edge_id, "src": src, "dst": dst, "type": type_, "props": {k: str(v) for k, v in props.items()}}
