"""The standard tables as graphs, and the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.store import table
from graphloom.model import Graph, with_both_ends


def incidents(spark: SparkSession, sf_dir: str) -> Graph:
    """graph_nodes and graph_edges, repeated rows once, null properties absent, relationships with both ends."""
    nodes = table(spark, sf_dir, "graph_nodes").withColumn("props", F.map_filter("props", lambda k, v: v.isNotNull()))
    edges = table(spark, sf_dir, "graph_edges")
    return Graph(nodes.dropDuplicates(["id"]), with_both_ends(edges.dropDuplicates(["id"]), nodes), nodes, edges)


INCIDENTS = """n AS (SELECT * FROM graph_nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1),
e AS (SELECT * FROM graph_edges WHERE src IN (SELECT id FROM graph_nodes) AND dst IN (SELECT id FROM graph_nodes) QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)"""


def _nodes(df: DataFrame, label: str, key: str, offset: int, **props: str) -> DataFrame:
    entries = F.map_from_arrays(F.array(*map(F.lit, props)), F.array(*[F.col(c).cast("string") for c in props.values()]))
    return df.select((F.col(key) + offset).cast("bigint").alias("id"), F.array(F.lit(label)).alias("labels"), F.lit(label).alias("label"), entries.alias("props"))


#: Where the ids of each kind begin.
REGION, NATION, CUSTOMER, SUPPLIER, ORDER = 0, 100, 10_000_000, 20_000_000, 100_000_000


def trade(spark: SparkSession, sf_dir: str, orders: bool = False) -> Graph:
    """Regions, nations, customers and suppliers with IN_REGION, LOCATED_IN and, if asked for, orders with PLACED."""
    t = lambda n: table(spark, sf_dir, n)
    nodes = (_nodes(t("region"), "Region", "r_regionkey", REGION, name="r_name").unionByName(_nodes(t("nation"), "Nation", "n_nationkey", NATION, name="n_name"))
             .unionByName(_nodes(t("customer"), "Customer", "c_custkey", CUSTOMER, name="c_name", segment="c_mktsegment")).unionByName(_nodes(t("supplier"), "Supplier", "s_suppkey", SUPPLIER, name="s_name")))
    link = lambda df, a, ao, b, bo, kind, base: df.select((F.col(a) + base).cast("bigint").alias("id"), (F.col(a) + ao).cast("bigint").alias("src"), (F.col(b) + bo).cast("bigint").alias("dst"), F.lit(kind).alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    edges = (link(t("nation"), "n_nationkey", NATION, "n_regionkey", REGION, "IN_REGION", 0).unionByName(link(t("customer"), "c_custkey", CUSTOMER, "c_nationkey", NATION, "LOCATED_IN", 1_000))
             .unionByName(link(t("supplier"), "s_suppkey", SUPPLIER, "s_nationkey", NATION, "LOCATED_IN", 50_000_000)))
    if orders:
        nodes = nodes.unionByName(_nodes(t("orders"), "Order", "o_orderkey", ORDER, status="o_orderstatus", priority="o_orderpriority"))
        edges = edges.unionByName(link(t("orders"), "o_custkey", CUSTOMER, "o_orderkey", ORDER, "PLACED", 0).withColumn("id", F.col("dst")))
    return Graph(nodes, edges)


def ring(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations that precede others: n before (2n + 1) mod 25, and before its neighbour where n is a multiple of 5. It has cycles."""
    n = table(spark, sf_dir, "nation")
    nodes = _nodes(n, "Nation", "n_nationkey", 0, name="n_name")
    k = F.col("n_nationkey")
    one = n.select(k.cast("bigint").alias("id"), k.cast("bigint").alias("src"), ((2 * k + 1) % 25).cast("bigint").alias("dst"))
    two = n.where("n_nationkey % 5 = 0").select((k + 100).cast("bigint").alias("id"), k.cast("bigint").alias("src"), ((k + 1) % 25).cast("bigint").alias("dst"))
    edges = one.unionByName(two).select("id", "src", "dst", F.lit("PRECEDES").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    return Graph(nodes, edges)


RING = """r AS (SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS src, ((2 * n_nationkey + 1) % 25)::BIGINT AS dst FROM nation
UNION ALL SELECT n_nationkey + 100, n_nationkey, (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey % 5 = 0)"""


def tree(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations that manage others: n manages 2n + 1 and 2n + 2."""
    n = table(spark, sf_dir, "nation")
    nodes = _nodes(n, "Nation", "n_nationkey", 0, name="n_name")
    k = F.col("n_nationkey")
    edges = n.where("n_nationkey > 0").select(k.cast("bigint").alias("id"), F.floor((k - 1) / 2).cast("bigint").alias("src"), k.cast("bigint").alias("dst"), F.lit("MANAGES").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    return Graph(nodes, edges)


TREE = "t AS (SELECT n_nationkey::BIGINT AS id, ((n_nationkey - 1) // 2)::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation WHERE n_nationkey > 0)"
