"""The queries of the general problems: instants and snapshot changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions.store import table
from graphloom.operators.instants import node_instants
from graphloom.operators.snapshots import snapshot_changes


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_instants(table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "sources"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "graph_snapshots"))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found}

SQL = {
    # every pair of neighbouring snapshots compared item by item
    "p5_found": """
WITH rows_ AS (
  SELECT graph_id, snapshot_id, CAST("timestamp" AS TIMESTAMPTZ) AS at_, coalesce(nodes, []) AS nodes, coalesce(relationships, []) AS rels,
         len(coalesce(nodes, [])) >= coalesce(node_count, 0) AND len(coalesce(relationships, [])) >= coalesce(rel_count, 0) AS full_
  FROM graph_snapshots WHERE graph_id IS NOT NULL AND snapshot_id IS NOT NULL AND "timestamp" IS NOT NULL),
one AS (
  SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY graph_id, snapshot_id ORDER BY full_ DESC, len(nodes) + len(rels) DESC) = 1),
seqs AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY at_, snapshot_id) AS seq FROM one),
flat AS (
  SELECT graph_id, seq, 'node' AS item_kind, n.id AS item_id,
         CAST(list_sort(list_distinct(n.labels)) AS VARCHAR) AS a, CAST(list_sort(list_filter(map_entries(n.props), lambda e: e.value IS NOT NULL AND e.key <> 'extracted_at')) AS VARCHAR) AS b
  FROM (SELECT graph_id, seq, unnest(nodes) AS n FROM seqs)
  UNION
  SELECT graph_id, seq, 'relationship', r.id, concat_ws('|', r.type, r.start_id, r.end_id),
         CAST(list_sort(list_filter(map_entries(r.props), lambda e: e.value IS NOT NULL AND e.key <> 'extracted_at')) AS VARCHAR)
  FROM (SELECT graph_id, seq, unnest(rels) AS r FROM seqs)),
items AS (SELECT graph_id, seq, item_kind, item_id, min(a || '#' || b) AS c FROM flat GROUP BY ALL),
pairs AS (
  SELECT coalesce(n.graph_id, o.graph_id) AS graph_id, coalesce(n.seq, o.seq + 1) AS seq, coalesce(n.item_kind, o.item_kind) AS item_kind, coalesce(n.item_id, o.item_id) AS item_id, o.c AS before, n.c AS after_
  FROM items n FULL JOIN items o ON n.graph_id = o.graph_id AND n.seq = o.seq + 1 AND n.item_kind = o.item_kind AND n.item_id = o.item_id)
SELECT p.graph_id, s.snapshot_id, p.item_kind, p.item_id, CASE WHEN before IS NULL THEN 'added' WHEN after_ IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM pairs p JOIN seqs s ON s.graph_id = p.graph_id AND s.seq = p.seq
WHERE p.seq > 1 AND before IS DISTINCT FROM after_
""",
}
