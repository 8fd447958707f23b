"""Ontology, quality, time, fusion, ingest, text, export, state machine, training and streaming on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import ontology as O
from graphloom.functions import text as X
from graphloom.model import desc_full, desc_linear, desc_probe, desc_truthy, edge, from_rows, node
from graphloom.operators import agent, fusion, ingest, quality, retrieval, temporal, training
from graphloom.sources import files
from graphloom.streaming import ingest as stream


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [node(1, "Event", description="Crash", type="incident", source="s1"), node(2, "Event", description="Fall", type="party", source="s2"), node(3, "Person", name_or_description="Ann", role="suspect", source="s1", confidence=0.8, confidence_raw="0.8"), node(4, "Person", name_or_description="Bob", role="witness", source="s2"),
             node(5, "Time", value="14:13", source="s1"), node(6, "Location", description='Main "St"', source="s1"), node(7, "Vehicle", description="Van", source="s2"), node(8, "Observation", description="Report from s1", observation_type="statement"), node(9, "GraphVersion", source_id="s1"), node(10, "Time", value="half past three", source="s2")]
    edges = [edge(1, 1, "OCCURRED_AT_TIME", 5), edge(2, 1, "OCCURRED_AT", 6), edge(3, 4, "WITNESSED", 1), edge(4, 3, "DROVE", 7), edge(5, 1, "DERIVED_FROM", 8), edge(6, 2, "OCCURRED_AT_TIME", 10), edge(7, 2, "OCCURRED_AT", 7)]
    return from_rows(spark, nodes, edges)


def col(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("14:13:45", 853.75), ("14:13", 853), ("2:15 PM", 855), ("9:30 AM", 570), ("quarter past two", 135), ("half past three", 210), ("approximately 2:15 PM", 855), ("soon", None), ("", None), (None, None), ("0:00", 0), ("Impact at 14:13", 853), ("half past zog", 30)])
def test_parse_time(spark, text, want):
    assert col(spark, text, temporal.parse_time(F.col("v"))) == want


def test_clock(spark):
    assert [col(spark, m, temporal.clock(F.col("v")), "double") for m in (853.0, 0.0, 720.0, 1445.0)] == ["14:13", "00:00", "12:00", "00:05"]


def test_descriptions(spark):
    g = from_rows(spark, [node(1, "N", name="n", description=""), node(2, "N", name="n"), node(3, "N")], [])
    got = {r["id"]: tuple(r)[1:] for r in g.nodes.select("id", desc_linear(), desc_probe(default="unknown"), desc_full(), desc_truthy()).collect()}
    assert got == {1: ("", "", "", "n"), 2: ("2", "unknown", "n", "n"), 3: ("3", "unknown", None, None)}


def test_ontologies():
    assert [(len(o.nodes), len(o.rels), len(o.rules)) for o in O.ONTOLOGIES.values()] == [(8, 14, 5), (7, 10, 5), (9, 14, 5)]
    for o in O.ONTOLOGIES.values():
        assert all(n.merge_key in n.required for n in o.nodes.values())
        assert all(r.start in o.nodes and r.end in o.nodes for r in o.rels.values())
        for rule in o.rules:
            assert rule.label in o.nodes and rule.priority in O.PRIORITIES and "{entity_desc}" in rule.template
            assert all(t in o.rels and label in o.nodes for types, _, label in rule.missing for t in types)
        assert all(x in o.prompt() for x in o.nodes if x not in o.system_nodes) and not any(f"[{r}]" in o.prompt() for r in o.system_rels)
        assert len(o.constraint_lines()) == len(o.nodes) and o.spec_id in o.summary()


def test_gaps_and_shapes(graph):
    got = {(r["rule_id"], r["entity_desc"]) for r in O.gaps(graph, O.SCHEMA_ORG).collect()}
    assert got == {("event_needs_location", "Fall"), ("event_needs_participant", "Fall"), ("suspect_needs_description", "Ann"), ("vehicle_needs_identifiers", "Van")}
    broken = {(r["path"], r["kind"], r["id"]) for r in O.violations(graph, O.EVENT_SHAPES).where("severity = 'Violation'").collect()}
    assert broken == {("type", "in", 2), ("OCCURRED_AT", "class", 2), ("MADE_BY", "relation", 8)}
    bfo = from_rows(graph.nodes.sparkSession, [node(1, "Process", description="p"), node(2, "Agent", name_or_description="a"), node(3, "AgentRole", role_type="suspect")], [edge(1, 2, "AGENT_IN", 1), edge(2, 2, "BEARS_ROLE", 3)])
    assert {r["rule_id"] for r in O.gaps(bfo, O.BFO_CCO).collect()} == {"process_needs_temporal", "process_needs_site", "suspect_needs_description"}
    assert {(r["name"], r["n"]) for r in O.outside_vocabulary(graph, O.SCHEMA_ORG).collect()} == {("GraphVersion", 1)}
    assert O.in_vocabulary(graph, O.SCHEMA_ORG).nodes.count() == 9


def test_quality(spark, graph):
    assert quality.schema_score(graph, ("Event", "Zebra")).first()["score"] == 0.5
    assert quality.structural_score(graph).first()["score"] == pytest.approx(0.9)
    empty = from_rows(spark, [], [])
    assert quality.structural_score(empty).first()["score"] == 0.0 and quality.grounding_score(empty).first()["score"] == 1.0
    assert quality.grounding_score(graph).first()["orphans"] == 1
    lone = from_rows(spark, [node(i, "N") for i in range(40)], [])
    assert quality.grounding_score(lone).first()["score"] == 0.5 and quality.grounding_score(lone, None).first()["score"] == 0.0
    assert quality.consistency_score(from_rows(spark, [node(1, "N", value="x"), node(2, "N", value="x")], [edge(1, 1, "PRECEDED", 2), edge(2, 2, "PRECEDED", 1)])) == 0.0
    assert {r["check"]: r["passed"] for r in quality.population_checks(graph).collect()} == {"events": True, "persons": True, "places": True, "times": True, "participants": False, "sources": True}
    every = [quality.Result(d, 1.0) for d in quality.BASE_WEIGHTS]
    assert sum(quality.BASE_WEIGHTS.values()) == pytest.approx(1) and quality.overall(every) == pytest.approx(1) and quality.overall([]) == 0
    assert quality.overall(every[:4]) == pytest.approx(0.65) and quality.overall(every[:4], normalise_active=True) == pytest.approx(1) and quality.recommendations(every) == []
    scores = iter([0.6, 0.8, 0.7])
    best, spread = quality.calibrate(lambda: quality.Result("coherence", next(scores)))
    assert best.score == 0.7 and spread["mean"] == pytest.approx(0.7)
    assert quality.calibrate(lambda: quality.Result("coherence", quality.SKIPPED)) == (quality.Result("coherence", quality.SKIPPED), {})


def test_near_vectors_against_brute_force(spark):
    import random

    rnd = random.Random(1)
    v = [(i, [rnd.random() * 2 for _ in range(4)], i % 2) for i in range(80)]
    want = {(a[0], b[0]) for a in v for b in v if a[0] < b[0] and a[2] == b[2] and sum((x - y) ** 2 for x, y in zip(a[1], b[1])) ** 0.5 < 0.5}
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>, label int")
    assert {(r["id_a"], r["id_b"]) for r in quality.near_pairs(df, 0.5).collect()} == want and want
    assert quality.centroid_outliers(df.limit(0)).count() == 0


def test_timeline_and_conflicts(graph):
    got = {r["description"]: r["time_minutes"] for r in temporal.timeline(graph).collect()}
    assert got == {"Crash": 853.0, "Fall": 210.0}
    order = temporal.neighbours_in_time(temporal.timeline(graph), "description", "time_minutes", "n")
    assert [(r["description"], r["next_description"]) for r in order.collect()] == [("Fall", "Crash")]
    assert temporal.conflicts(graph).count() == 0


def test_confidence(spark):
    b = lambda c: round(col(spark, c, fusion.boosted(F.col("v")), "double"), 6)
    d = lambda c: round(col(spark, c, fusion.decayed(F.col("v")), "double"), 6)
    assert (b(0.8), b(None), b(0.97), d(0.8), d(None), d(0.2)) == (0.86, 0.9, 0.97, 0.56, 0.5, 0.2)
    c = 0.4
    for up in (True, True, False, True):
        c = (c + (1 - c) * 0.3 if c < 0.95 else c) if up else (c * 0.7 if c > 0.3 else c)
    assert col(spark, 0.4, fusion.folded(F.col("v"), F.array(*map(F.lit, (True, True, False, True)))), "double") == pytest.approx(c)


def test_fusion(spark, graph):
    m = spark.createDataFrame([(1, "Ann", "Bob", 0.9, "r"), (2, "Ann", "Ann", 0.9, "r"), (3, "", "Bob", 0.9, "r"), (4, "Bob", "Ann", 0.5, "r")], "seq int, entity_a_desc string, entity_b_desc string, confidence double, reasoning string")
    out = fusion.apply_matches(graph, m)
    assert sorted((r["src"], r["dst"]) for r in out.typed("POSSIBLY_SAME_AS").collect()) == [(3, 4), (4, 3)]
    assert {r["id"]: round(r["confidence"], 6) for r in out.nodes.where("label = 'Person'").collect()} == {3: 0.86, 4: 0.9}
    no = fusion.apply_contradictions(graph, spark.createDataFrame([(1, "Ann", "Bob", "time", "a", "b", None)], "seq int, entity_a_desc string, entity_b_desc string, field string, value_a string, value_b string, reasoning string"))
    assert no.typed("CONTRADICTS").first()["props"] == {"field": "time", "value_a": "a", "value_b": "b"} and round(no.nodes.where("id = 3").first()["confidence"], 6) == 0.56
    assert [tuple(r) for r in fusion.source_pairs(graph).collect()] == [("s1", "s2")]
    assert fusion.resolve(graph, lambda e, p: e.limit(0)).count() == 0


def test_what_if(graph):
    after, counts = fusion.remove_source(graph, "s1")
    assert tuple(counts.first()) == (4, 5) and after.nodes.where("source = 's1' or id = 8").count() == 0
    assert {r["status"] for r in fusion.compare(graph, graph).collect()} == {"common"}
    diff = {(r["desc"], r["status"]) for r in fusion.compare(graph, after).where("status <> 'common'").collect()}
    assert ("Ann", "only_a") in diff and ("Report from s1", "only_a") in diff


def test_ingest(spark, graph):
    st = spark.createDataFrame([("new", "statement", 1), ("bad", "statement", 2)], "source_id string, source_type string, seq int")
    answer = "Sure:\n```json\n" + json.dumps({"entities": [{"id": "e1", "label": "Event", "properties": {"description": "Crash", "severity": "high", "BAD NAME": "x"}}, {"id": "p1", "label": "Person", "properties": {"name_or_description": "Zoe", "role": None}}, {"id": "p2", "label": "Person", "properties": {"name_or_description": "Zoe W"}}, {"id": "z", "label": "Zebra", "properties": {}}],
                                              "relationships": [{"from_id": "p1", "rel_type": "WITNESSED", "to_id": "e1"}, {"from_id": "p2", "rel_type": "WITNESSED", "to_id": "e1"}, {"from_id": "p1", "rel_type": "EATS", "to_id": "e1"}]}) + "\n```"
    rec = ingest.extract(st, lambda s: spark.createDataFrame([("new", answer), ("bad", "no idea")], "source_id string, answer string")).join(st.select("source_id", "seq"), "source_id")
    rec = ingest.remap(rec, spark.createDataFrame([("new", "p2", "p1")], "source_id string, id string, canonical string"))
    out, ids, created = ingest.load(graph, rec, O.SCHEMA_ORG, "2024-01-01T00:00:00Z")
    assert out.nodes.count() == graph.nodes.count() + 1 and created.count() == 1
    crash = out.nodes.where("id = 1").first()
    assert crash["props"]["severity"] == "high" and "BAD NAME" not in crash["props"] and crash["source"] == "new"
    again, _, more = ingest.load(out, rec, O.SCHEMA_ORG, "2024-01-01T00:00:00Z")
    assert again.nodes.count() == out.nodes.count() and more.count() == 0
    obs = spark.createDataFrame([(8, "statement", None)], "obs bigint, source_type string, witness string")
    assert {(r["type"], r["src"], r["dst"]) for r in ingest.provenance_links(graph, obs).collect()} == {("MADE_BY", 8, 4), ("OBSERVED", 8, 1), ("OBSERVED", 8, 2), ("DERIVED_FROM", 1, 8), ("DERIVED_FROM", 2, 8)}


def test_text(spark):
    s = lambda t: col(spark, t, X.sentences(F.col("v")))
    assert [len(s(t)) for t in ("A b. C d! E?", "One. Two.", "No stop", "", "a.b c")] == [3, 2, 1, 0, 1]
    assert [c["text"] for c in col(spark, "a. b. c. d. e.", X.chunks(F.col("v")))] == ["a. b. c. d.", "e."] and col(spark, "", X.chunks(F.col("v"))) is None
    j = lambda t: col(spark, t, X.tolerant_json(F.col("v"), "a int"))
    assert j('{"a": 1}')["a"] == j('```json\n{"a": 1}\n```')["a"] == j('so {"a": 1} there')["a"] == 1 and j("none") is None and j(None) is None
    assert [col(spark, t, X.plain_name(F.col("v"))) for t in ("Dr. Ann Lee ", "mr bob", "Drake")] == ["ann lee", "bob", "drake"]
    assert [col(spark, t, X.source_type(F.col("v"))) for t in ("cctv_log", "paramedic_report", "officer_notes", "x", "paramedic")] == ["cctv", "forensic_report", "police_report", "statement", "medical_report"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id int, embedding array<float>")
    assert [r["vec_id"] for r in retrieval.top_k(v, [1.0, 0.0], 2).collect()] == [1, 3]


def test_exports(spark, graph, tmp_path):
    ttl = {(r["kind"], r["id"]): r["line"] for r in files.turtle_lines(graph).collect()}
    assert ttl["node", 6] == 'node:6\n    a schema:Place ;\n    rdfs:label "Main \\"St\\"" .' and ttl["relationship", 1] == "node:1 schema:startDate node:5 ."
    assert col(spark, 'a"b\nc\\', files.turtle_text(F.col("v"))) == 'a\\"b\\nc\\\\'
    ld = {r["id"]: json.loads(r["json"]) for r in files.jsonld_nodes(graph).collect()}
    assert ld[1]["occurred_at"] == {"@id": "urn:event-twin:node:6"} and ld[6]["description"] == 'Main "St"' and ld[3]["@type"] == ["Person"]
    dot = {(r["kind"], r["id"]): r["line"] for r in files.dot_lines(graph).collect()}
    assert dot["node", 3] == 'n3 [label="Person\\nAnn\\n[s1] (0.8)", fillcolor="#3498db", fontcolor="white"];' and dot["relationship", 4] == 'n3 -> n7 [label="DROVE"];'
    assert "CREATE (n6:Location {description: 'Main \"St\"'});" in [r["line"] for r in files.cypher_lines(graph).collect()]
    assert "Ann" in files.vis_html(graph) and retrieval.linearised(from_rows(spark, [], [])) == "(empty graph)" and "(Person: Ann) -[DROVE]-> (Vehicle: Van)" in retrieval.linearised(graph)
    files.write_lines(files.turtle_lines(graph), str(tmp_path / "ttl"))
    files.write_tsv(files.tsv_triples(graph), str(tmp_path / "tsv"))
    assert spark.read.text(str(tmp_path / "tsv")).where("value like 'Ann\tDROVE\tVan'").count() == 1
    (tmp_path / "cctv_log.txt").write_text(" hello ")
    assert [tuple(r) for r in files.read_statements(spark, str(tmp_path / "*.txt")).collect()] == [("cctv_log", "cctv", "hello")]
    assert files.rdf_triples(graph).where("p = 'rdf:type'").count() == 10


def test_machine(spark):
    def ask(state):
        if "answer" not in state:
            raise agent.Interrupt("when?")
        return {"rounds": state.get("rounds", 0) + 1}

    m = agent.Machine("ask", {"ask": ask, "write": lambda s: {"done": True}}, {"ask": "write", "write": agent.END})
    assert list(m.run("t", {"q": 1})) == []
    assert [n for n, _ in m.resume("t", {"answer": "now"})] == ["ask", "write"]
    assert m.table(spark).count() == 3 and json.loads(m.checkpoints[-1][3]) == {"q": 1, "answer": "now", "rounds": 1, "done": True}
    loop = agent.Machine("a", {"a": lambda s: {"n": s.get("n", 0) + 1}}, {"a": lambda s: agent.END if s["n"] == 3 else "a"})
    assert [s["n"] for _, s in loop.run("x", {})] == [1, 2, 3]
    assert agent.stops(True, 0, 5, 1) and agent.stops(False, 5, 5, 1) and agent.stops(False, 1, 5, 0) and not agent.stops(False, 0, 5, 0)
    assert col(spark, "Insufficient", retrieval.relevance_route(F.col("v"))) == "retry" and col(spark, " sufficient", retrieval.relevance_route(F.col("v"))) == "answer"


def test_training(spark):
    gold = spark.createDataFrame([("s", [(f"e{i}", "Person", {}) for i in range(5)], [("e0", "KNOWS", "e1"), ("e0", "KNOWS", "e4")])], "source_id string, " + ingest.EXTRACTION.replace(":string", ": string"))
    st = spark.createDataFrame([("s", "text"), ("t", "no gold")], "source_id string, text string")
    rows = {r["variant"]: json.loads(r["rejected"]) for r in training.preference_pairs(st, gold).collect()}
    assert [e["id"] for e in rows["incomplete"]["entities"]] == ["e0", "e1", "e2"] and len(rows["incomplete"]["relationships"]) == 1
    assert len(rows["hallucinated"]["entities"]) == 6 and rows["hallucinated"]["entities"][0]["label"] == "Observation" and len(rows["hallucinated"]["relationships"]) == 3
    chat = training.chat_rows(st, gold).collect()
    assert len(chat) == 1 and [t["role"] for t in chat[0]["messages"]] == ["system", "user", "assistant"]
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert tuple(training.extraction_scores(k(1, 2, 2, 3), k(2, 3, 4, 5), ["k"]).first()) == pytest.approx((2 / 3, 0.5, 4 / 7))


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:20:00", "a", 2.0), (1, "2024-01-01 12:00:00", "b", 3.0)], "user_id int, ts string, event_type string, value double")
    assert stream.windowed_counts(ev).count() == 2 and sorted(r["n"] for r in stream.sessions(ev).collect()) == [1, 2]
    rows = spark.createDataFrame([("Person", "Zoe", {"name": "Zoe"}, 1), ("Person", "Zoe", {"age": "4"}, 2)], "label string, merge_key string, props map<string,string>, seq int")
    rows.write.parquet(str(tmp_path / "in"))
    g = from_rows(spark, [node(1, "Person", name="Ann")], [])
    q = stream.keep_graph(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), g, F.col("props")["name"], str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(r["props"]["name"] for r in spark.read.parquet(str(tmp_path / "out" / "v0")).collect()) == ["Ann", "Zoe"]


def test_judges_and_reports(spark, graph):
    assert quality.coherence("t", lambda p: '{"score": 8, "issues": ["gap"]}') == quality.Result("coherence", 0.8, ["gap"]) and quality.coherence("t", lambda p: "well").score == 0.5
    f = quality.faithfulness("t", "s", lambda p: 'so {"score": 5, "hallucinated": ["x"], "missing": ["y"]}')
    assert f.violations == ["error: x", "warning: y"]
    assert quality.narrative("t", lambda p: "SCORE: 4").score == 0.8 and quality.narrative("t", lambda p: "").score == 0.6 and quality.narrative("(empty graph)", lambda p: "SCORE: 5").score == 0
    skip = lambda: quality.Result("link_prediction", quality.SKIPPED)
    assert quality.first_that_answers(skip, lambda: quality.Result("x", 0.3)).score == 0.3 and quality.first_that_answers(lambda: 1 / 0).score == 0.5 and quality.first_that_answers(skip).score == quality.SKIPPED
    assert "schema 1.0000" in quality.report([quality.Result("schema", 1.0), quality.Result("link_prediction", quality.SKIPPED)]) and "skipped" in quality.report([quality.Result("link_prediction", quality.SKIPPED)])
    share = {r["id"]: r["share"] for r in quality.borne_out(retrieval.triples(graph), "Ann drove the van, person vehicle").collect()}
    assert share[4] == 1.0 and share[1] < 0.5
    assert quality.triple_plausibility(spark.createDataFrame([(5.0,), (-5.0,)], "score double")).first()["score"] == 0.5


def test_intervals_and_questions(spark, graph):
    cases = {(0, 1, 2, 3): "before", (2, 3, 0, 1): "after", (0, 1, 1, 2): "meets", (1, 2, 0, 1): "met by", (0, 2, 1, 3): "overlaps", (1, 3, 0, 2): "overlapped by", (0, 1, 0, 2): "starts", (0, 2, 0, 1): "started by", (1, 2, 0, 3): "during", (0, 3, 1, 2): "contains", (1, 2, 0, 2): "finishes", (0, 2, 1, 2): "finished by", (0, 1, 0, 1): "equals", (2, 1, 0, 1): None}
    rows = spark.createDataFrame([(*k,) for k in cases], "a int, b int, c int, d int")
    got = {(r["a"], r["b"], r["c"], r["d"]): r["x"] for r in rows.withColumn("x", temporal.allen(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()}
    assert got == cases
    assert temporal.ascii_timeline(temporal.timeline(graph)).split("\n")[0].startswith("03:30 | Fall")
    ok = retrieval.ask_sql(spark, "how many?", lambda q: "```sql\nSELECT count(*) AS n FROM nodes;\n```", {"nodes": graph.nodes})
    assert ok["rows"].first()["n"] == 10 and ok["error"] is None
    assert retrieval.ask_sql(spark, "?", lambda q: "DROP TABLE nodes", {})["error"] == "only queries are run" and retrieval.ask_sql(spark, "?", lambda q: "SELECT x FROM nowhere", {})["rows"] is None


def test_interview_helpers(spark, graph, tmp_path):
    g = O.gaps(graph, O.SCHEMA_ORG)
    done = spark.createDataFrame([("event_needs_location", "Fall")], "rule_id string, entity_desc string")
    assert [(r["rule_id"], r["entity_desc"]) for r in agent.next_gaps(g, done, 2).collect()] == [("event_needs_participant", "Fall"), ("suspect_needs_description", "Ann")]
    assert agent.follow_up({"gap_description": "x"}) == "Can you tell us more? x." and agent.follow_up({"gap_description": "x"}, lambda d: " Why? ") == "Why?"
    assert [col(spark, a, agent.says_nothing(F.col("v"))) for a in ("I don't know.", "", None, "no idea", "It was red.", "not sure")] == [True, True, True, True, False, True]
    assert [col(spark, a, agent.normalised_label(F.col("v"), ("qualified", "unqualified"), "unqualified")) for a in (" Qualified ", "maybe", None)] == ["qualified", "unqualified", "unqualified"]
    st = spark.createDataFrame([("t", 0, "ask_user", '{"questions":[{"question":"When?"}],"user_answers":["now"]}')], agent.CHECKPOINT.replace(",", ", "))
    assert agent.transcript(st).first()["line"] == "Q: When?\nA: now"
    assert O.shapes_turtle(O.SEM).count("sh:targetClass") == 7 and 0 < O.conformance(graph, O.EVENT_SHAPES).first()["score"] < 1 and O.conformance(from_rows(spark, [], []), O.EVENT_SHAPES).first()["score"] == 1.0
    out = training.rewritten(spark.createDataFrame([("s", "text")], "source_id string, text string"), ["brief", "formal"], lambda asked: asked.withColumnRenamed("prompt", "text"))
    assert out.count() == 2
    files.write_by_source(spark.createDataFrame([("s", 1)], "source_id string, x int"), str(tmp_path / "by"))
    assert (tmp_path / "by" / "source_id=s").is_dir()
