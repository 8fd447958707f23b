"""Ingest, fusion, retrieval, probes and reports on small graphs."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph, edge, from_rows, node
from graphloom.ontology import SCHEMA_ORG, Shape, violations
from graphloom.operators import fusion, ingest, quality, retrieval, temporal, training

RECORD = {"entities": [{"id": "e1", "label": "Event", "properties": {"description": "Collision at the mill", "type": "collision"}}, {"id": "p1", "label": "Person", "properties": {"name_or_description": "Ann Lee", "role": "witness"}}, {"id": "x", "label": "Ghost", "properties": {}}],
          "relationships": [{"from_id": "p1", "rel_type": "WITNESSED", "to_id": "e1"}, {"from_id": "p1", "rel_type": "HAUNTED", "to_id": "e1"}]}


def small(spark):
    nodes = [node(1, "Event", description="Collision at the mill", source="a", source_type="cctv"), node(2, "Event", description="Siren heard", source="b"), node(3, "Person", name_or_description="Ann Lee", role="witness", source="a"),
             node(4, "Time", value="10:05"), node(5, "Time", value="09:30"), node(6, "Observation", description="Statement from a"), node(7, "Observation", description="Statement from b"), node(8, "Person", name_or_description="Ann Lee", source="b")]
    edges = [edge(1, 1, "OCCURRED_AT_TIME", 4), edge(2, 2, "OCCURRED_AT_TIME", 5), edge(3, 3, "WITNESSED", 1), edge(4, 1, "DERIVED_FROM", 6), edge(5, 2, "CONTRADICTS", 1, field="time")]
    return from_rows(spark, nodes, edges)


def test_ingest_asks_again_and_counts_what_it_made(spark):
    statements = spark.createDataFrame([("s1", "statement", "text one", 1, "Ann Lee"), ("s2", "statement", "text two", 2, None), ("s3", "statement", "", 3, None)], "source_id string, source_type string, text string, seq int, witness string")
    rounds = []

    def extractor(rows):
        rounds.append(rows.count())
        return rows.select("source_id", F.when((F.col("source_id") == "s1") | (F.lit(len(rounds) > 1) & (F.col("source_id") == "s2")), F.lit(json.dumps(RECORD))).otherwise(F.lit("sorry, no JSON")).alias("answer"))

    empty = from_rows(spark, [], [])
    graph, steps = ingest.ingest(empty, statements, extractor, SCHEMA_ORG, "2025-01-01T00:00:00Z")
    assert rounds[0] == 3 and rounds[-1] == 2
    assert {r["step"]: r["n"] for r in steps.collect()} == {"statements": 3, "read": 2, "nodes created": 2, "relationships created": 1, "observations": 3}
    assert {r["label"]: r["n"] for r in graph.nodes.groupBy("label").agg(F.count("*").alias("n")).collect()} == {"Event": 1, "Person": 1, "Observation": 3}
    assert {r["type"]: r["n"] for r in graph.edges.groupBy("type").agg(F.count("*").alias("n")).collect()} == {"WITNESSED": 1, "MADE_BY": 3, "OBSERVED": 3, "DERIVED_FROM": 3}


def test_interview_facts_have_no_source(spark):
    graph = small(spark)
    facts = spark.createDataFrame([(1, RECORD["entities"][:2] + [{"id": "v", "label": "Vehicle", "properties": {"description": "red van"}}], [])], "seq int, entities array<struct<id:string,label:string,properties:map<string,string>>>, relationships array<struct<from_id:string,rel_type:string,to_id:string>>").select("seq", F.struct("entities", "relationships").alias("x"))
    merged = ingest.merge_facts(graph, facts, SCHEMA_ORG, "2025-01-01T00:00:00Z")
    rows = {r["d"]: (r["source"], r["confidence_raw"]) for r in merged.nodes.select(F.coalesce(F.col("props")["description"], F.col("props")["name_or_description"]).alias("d"), "source", "confidence_raw").where("d in ('red van', 'Collision at the mill')").collect()}
    assert rows["red van"] == (None, "medium") and rows["Collision at the mill"][0] == "a"


def test_fusion_of_all_pairs(spark):
    fused, steps = fusion.run_fusion(small(spark))
    assert {r["step"]: r["n"] for r in steps.collect()} == {"matches": 1, "corroborations": 2}
    assert fused.edges.where("type = 'CORROBORATED_BY'").count() == 2
    against = lambda entities, pairs: entities.sparkSession.createDataFrame([(1, "Siren heard", "Collision at the mill", "time")], "seq int, entity_a_desc string, entity_b_desc string, field string")
    fused, steps = fusion.run_fusion(small(spark), contradictor=against)
    assert {r["step"]: r["n"] for r in steps.collect()}["contradictions"] == 1
    assert fused.edges.where("type = 'CONTRADICTS'").count() >= 1


def test_order_of_time_is_written(spark):
    graph, made = temporal.precede(small(spark))
    assert [(r["src"], r["dst"]) for r in made.collect()] == [(2, 1)] and graph.edges.where("type = 'PRECEDED_BY'").count() == 1
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 37 % 501).cast("double").alias("t"))
    want = sorted((k * 37 % 501, k) for k in range(500))
    got = {(r["k"], r["next_k"]) for r in temporal.neighbours_in_time(rows, "k", "t", "k").collect()}
    assert got == {(a[1], b[1]) for a, b in zip(want, want[1:])}


def test_commands(spark):
    graph = small(spark)
    assert {tuple(r) for r in retrieval.command(graph, "/sources").collect()} == {("a", "cctv", 1), ("a", None, 1), ("b", None, 2)}
    assert retrieval.command(graph, "/from b").count() == 2 and retrieval.command(graph, "/contradictions").first()["field"] == "time"
    assert [r["description"] for r in retrieval.command(graph, "/timeline").orderBy("time_minutes").collect()] == ["Siren heard", "Collision at the mill"]
    assert retrieval.command(graph, "/export dot").count() == 13 and "vis.Network" in retrieval.command(graph, "/export html")
    assert {r["status"] for r in retrieval.command(graph, "/whatif remove b").collect()} >= {"only_a", "common"}
    for bad in ("", "/export xml", "/nothing", "hello"):
        with pytest.raises(ValueError):
            retrieval.command(graph, bad)
    assert retrieval.detected('names: ["Ann", "Bo"]') == ["Ann", "Bo"] and retrieval.detected("none") == [] and retrieval.detected(None) == []


def test_embedder_is_called_by_batch(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [r["embedding"] for r in retrieval.embed(rows, lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_rotations_learn_what_they_are_shown():
    triples = [(f"h{i}", r, f"{r}{i % 4}") for i in range(24) for r in ("p", "q")]
    model = quality.Rotations(triples, dims=24, epochs=150)
    ranks = [int((model.score(h, r) > model.score(h, r)[model.entities[t]]).sum()) for h, r, t in triples]
    assert sum(k < 5 for k in ranks) > 0.8 * len(ranks)


def test_link_prediction_and_plausibility(spark):
    triples = spark.createDataFrame([(f"h{i}", "r", f"t{i % 3}") for i in range(30)], "head string, relation string, tail string")
    a, b = quality.link_prediction(triples, epochs=10), quality.link_prediction(triples, epochs=10)
    assert a.score == b.score and 0 <= a.score <= 1 and len(a.violations) <= 10
    assert quality.link_prediction(triples.limit(5)).score == 1.0 and 0 <= quality.plausible(triples, epochs=10).score <= 1


def test_reports():
    results = [quality.Result("schema", 0.45678, ["error: no events"]), quality.Result("structural", 0.65), quality.Result("coherence", quality.SKIPPED)]
    out = quality.extended_report(results)
    assert out["composite"] == round((0.45678 + 0.65) / 2, 4) and out["recommendations"] == ["Critical: schema is 0.46", "Improve: structural is 0.65", "Fix: no events"]
    body = json.loads(quality.report_json(results))
    assert body["dimensions"][0]["score"] == 0.4568 and body["dimensions"][2]["skipped"]
    assert quality.temporal_result(["cycle", "event without timestamp"]).violations == ["error: cycle", "warning: event without timestamp"]
    assert quality.temporal_result(["x"] * 30).score == 0.0
    assert quality.graded("faithfulness", None, "").score == quality.SKIPPED
    assert quality.graded("faithfulness", lambda p: (0.45, "made up"), "").violations == ["error: made up"] and quality.graded("faithfulness", lambda p: (0.7, "thin"), "").violations == ["warning: thin"]
    assert quality.graded("coherence", lambda p: (0.61, "fine"), "").violations == [] and quality.strict(0.9, 2, 3) == pytest.approx(0.6)


def test_strict_consistency_and_datatypes(spark):
    graph = small(spark)
    checks = {r["check"]: r["passed"] for r in quality.consistency_checks(graph).collect()}
    assert checks == {"cycles": True, "duplicates": False, "order of time": True, "one role": True}
    assert violations(graph, [Shape("T", ("Time",), "value", "datatype", ("string",))]).count() == 0
    assert violations(graph, [Shape("T", ("Time",), "value", "datatype", ("int",))]).count() == 2


def test_training_extras(spark, tmp_path):
    writer = lambda asked: asked.select("scenario_id", "template", F.upper("prompt").alias("text"))
    assert training.scenarios(spark, 3, writer).count() == 12
    triples = spark.createDataFrame([(f"a{i}", "KNOWS", "b") for i in range(200)] + [("a", "POSSIBLY_SAME_AS", "b")], "head string, relation string, tail string")
    parts = training.triple_split(triples)
    assert parts.count() == 200 and {r["part"] for r in parts.select("part").distinct().collect()} == {"train", "valid", "test"}
    (tmp_path / "gold.jsonl").write_text(json.dumps({"source_id": "s", **RECORD}))
    gold = training.read_gold(spark, str(tmp_path / "gold.jsonl"))
    keys = training.triple_keys(gold)
    assert keys.count() == 2
    scores = training.extraction_scores(keys.limit(1), keys, ["head", "rel_type", "tail"]).first()
    assert scores["precision"] == 1.0 and scores["recall"] == 0.5
