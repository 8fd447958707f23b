"""The queries of this package's problems, and SQL where SQL can state the result."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.store import table
from graphloom.llm.encode import encode_texts
from graphloom.llm.entities import same_things
from graphloom.llm.groups import match_groups
from graphloom.llm.leaks import leaked_items, without_leaks
from graphloom.llm.pairs import answer_pairs, defective_pairs
from graphloom.llm.privacy import pii_replaced, pii_rows, state_texts
from graphloom.llm.spam import spam_pages
from graphloom.llm.split import split_texts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups(table(spark, sf_dir, "fusion_matches"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rag = table(spark, sf_dir, "rag_documents").select(F.lit("rag_documents").alias("origin"), "id", F.col("content").alias("text"))
    src = table(spark, sf_dir, "source_documents").select(F.lit("source_documents").alias("origin"), "id", "text")
    return rag.unionByName(src)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a text is over the limit exactly when it has a second piece
    return split_texts(_texts(spark, sf_dir), "text").where("piece_no = 1").select("origin", "id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(_texts(spark, sf_dir).distinct(), "text").where("n_pieces > 1")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


def p10_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(answer_pairs(table(spark, sf_dir, "agent_states")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_rows(state_texts(table(spark, sf_dir, "agent_states")))


def p2_replaced(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """With ``key``, or that of the setting graphloom.pii.key; where neither is given, a fresh one, whose surrogates agree within this run only."""
    key = key or spark.conf.get("graphloom.pii.key", "").encode() or secrets.token_bytes(32)
    return pii_replaced(state_texts(table(spark, sf_dir, "agent_states")), key)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_things(table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "sources")).select("id_a", "id_b")


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_things(table(spark, sf_dir, "graph_nodes"), table(spark, sf_dir, "sources")).withColumn("confidence", F.round("confidence", 4))


QUERIES = {f.__name__: f for f in (p1_found, p7_found, p7_pieces, p8_ids, p9_found, p9_scrubbed, p10_found, p10_evidence, p6_found, p2_found, p2_replaced, p4_found, p4_confidence)}

SQL = {
    "p1_found": """
WITH RECURSIVE e AS (
  SELECT entity_a_desc AS a, entity_b_desc AS b FROM fusion_matches
  WHERE entity_a_desc <> '' AND entity_b_desc <> '' AND entity_a_desc <> entity_b_desc AND confidence >= 0.7 AND NOT isnan(confidence)),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT a AS v, a AS w FROM both_
  UNION
  SELECT r.v, x.b FROM reach r JOIN both_ x ON x.a = r.w)
SELECT min(w) AS group_desc, v AS entity_desc FROM reach GROUP BY v
""",
    "p7_found": """
SELECT DISTINCT 'rag_documents' AS origin, id FROM rag_documents WHERE length(content) > 1200
UNION SELECT DISTINCT 'source_documents', id FROM source_documents WHERE length("text") > 1200
""",
    "p9_found": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower("text"), '[\p{L}\p{N}]+') AS t FROM documents),
d AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 10), lambda i: array_to_string(t[i:i + 11], ' '))) AS g FROM w WHERE len(t) >= 12),
v AS (SELECT item_id, regexp_extract_all(lower("text"), '[\p{L}\p{N}]+') AS t FROM eval_items),
e AS (SELECT item_id, unnest(list_transform(range(1, len(t) - 10), lambda i: array_to_string(t[i:i + 11], ' '))) AS g FROM v WHERE len(t) >= 12)
SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g)
""",
}
