"""Queries of quality, time, fusion, retrieval, export, state and training operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.store import table
from graphloom.model import DESC_FULL, Graph, desc_full
from graphloom.ontology import EVENT_SHAPES, SCHEMA_ORG, gaps, in_vocabulary, outside_vocabulary, priority_rank, shapes_of, violations
from graphloom.operators import agent, fusion, quality, temporal, training
from graphloom.operators.ingest import resolve_names
from graphloom.operators.retrieval import relevance_route as route
from graphloom.operators.retrieval import top_k, triples
from graphloom.plans.graphs import INCIDENTS, incidents, ring, tree
from graphloom.sources import files
from graphloom.streaming import ingest as stream

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL that states the same."""
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


LABELS = tuple(SCHEMA_ORG.nodes) + ("Role",)
_FULL = "coalesce(" + ", ".join(f"props['{k}']" for k in DESC_FULL) + ")"


@query(f"WITH {INCIDENTS}, l AS (SELECT unnest({list(LABELS)!r}) AS label) SELECT l.label, count(n.id) AS n FROM l LEFT JOIN n ON list_contains(n.labels, l.label) GROUP BY l.label")
def schema_population(spark: SparkSession, sf: str) -> DataFrame:
    return quality.population(incidents(spark, sf), LABELS)


@query(f"WITH {INCIDENTS}, l AS (SELECT unnest({list(LABELS)!r}) AS label) SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM n WHERE list_contains(n.labels, l.label)) THEN 1.0 ELSE 0.0 END), 6) AS score FROM l")
def schema_score(spark: SparkSession, sf: str) -> DataFrame:
    return quality.schema_score(incidents(spark, sf), LABELS).select(F.round("score", 6).alias("score"))


@query(f"WITH {INCIDENTS}, i AS (SELECT id FROM n WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)) SELECT t AS total, k AS isolated, round((t - k) / t, 6) AS score FROM (SELECT (SELECT count(*) FROM n) AS t, (SELECT count(*) FROM i) AS k)")
def structural_score(spark: SparkSession, sf: str) -> DataFrame:
    return quality.structural_score(incidents(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {INCIDENTS}, o AS (SELECT * FROM n WHERE NOT list_contains(labels, 'Observation')) SELECT t AS total, least(k, 20) AS orphans, round(greatest(0, 1 - least(k, 20) / t), 6) AS score FROM (SELECT count(*) AS t, count(*) FILTER (source IS NULL) AS k FROM o)")
def grounding_capped(spark: SparkSession, sf: str) -> DataFrame:
    return quality.grounding_score(incidents(spark, sf)).withColumn("score", F.round("score", 6))


_MIN = [("EventShape", "Event", "description"), ("EventShape", "Event", "type"), ("PersonShape", "Person", "name_or_description"), ("PersonShape", "Person", "role"), ("VehicleShape", "Vehicle", "description"), ("LocationShape", "Location", "description"), ("TimeShape", "Time", "value"),
        ("ObservationShape", "Observation", "description"), ("ObservationShape", "Observation", "observation_type"), ("PhysicalDescriptionShape", "PhysicalDescription", "summary")]


@query(f"WITH {INCIDENTS} " + " UNION ALL ".join(f"SELECT '{s}' AS shape, '{p}' AS path, 'Violation' AS severity, id FROM n WHERE list_contains(labels, '{x}') AND props['{p}'] IS NULL" for s, x, p in _MIN)
       + " UNION ALL " + " UNION ALL ".join(f"SELECT 'ProvenanceShape', '{p}', '{sev}', id FROM n WHERE list_has_any(labels, ['Event', 'Person', 'Vehicle', 'Location', 'Time', 'Object', 'PhysicalDescription']) AND {c} IS NULL" for p, c, sev in (("source", "source", "Warning"), ("confidence", "confidence_raw", "Info"))))
def shape_min_count(spark: SparkSession, sf: str) -> DataFrame:
    return violations(incidents(spark, sf), [s for s in EVENT_SHAPES if s.kind == "min_count"]).select("shape", "path", "severity", "id")


@query(f"""WITH {INCIDENTS} SELECT 'EventShape' AS shape, id FROM n WHERE list_contains(labels, 'Event') AND props['type'] NOT IN ('incident', 'observation', 'action', 'arrival', 'departure', 'communication', 'environmental')
UNION ALL SELECT 'PersonShape', id FROM n WHERE list_contains(labels, 'Person') AND props['role'] NOT IN ('witness', 'suspect', 'victim', 'bystander', 'first_responder', 'reporting_officer', 'driver', 'passenger')""")
def shape_in(spark: SparkSession, sf: str) -> DataFrame:
    return violations(incidents(spark, sf), [s for s in EVENT_SHAPES if s.kind == "in"]).select("shape", "id")


@query(f"""WITH {INCIDENTS} SELECT 'OCCURRED_AT' AS path, id FROM n WHERE list_contains(labels, 'Event') AND id NOT IN (SELECT src FROM e WHERE type = 'OCCURRED_AT')
UNION ALL SELECT 'OCCURRED_AT_TIME', id FROM n WHERE list_contains(labels, 'Event') AND id NOT IN (SELECT src FROM e WHERE type = 'OCCURRED_AT_TIME')
UNION ALL SELECT 'MADE_BY', id FROM n WHERE list_contains(labels, 'Observation') AND id NOT IN (SELECT src FROM e WHERE type = 'MADE_BY')""")
def shape_relation(spark: SparkSession, sf: str) -> DataFrame:
    return violations(incidents(spark, sf), [s for s in EVENT_SHAPES if s.kind == "relation"]).select("path", "id")


@query(f"WITH {INCIDENTS} " + " UNION ALL ".join(f"SELECT '{s.name}' AS shape, '{s.path}' AS path, count(*) AS n FROM n WHERE list_contains(labels, '{s.labels[0]}') AND props['{s.path}'] IS NULL HAVING count(*) > 0" for s in shapes_of(SCHEMA_ORG)))
def shapes_from_spec(spark: SparkSession, sf: str) -> DataFrame:
    return violations(incidents(spark, sf), shapes_of(SCHEMA_ORG)).groupBy("shape", "path").agg(F.count("*").alias("n"))


def _gap(rule: str, priority: str, label: str, desc: str, template: str, where: str) -> str:
    a, b = template.replace("'", "''").split("{entity_desc}")
    return f"SELECT '{rule}' AS rule_id, '{priority}' AS priority, labels[1] AS label, props['{desc}'] AS entity_desc, '{a}' || coalesce(props['{desc}'], 'None') || '{b}' AS gap_description FROM n WHERE list_contains(labels, '{label}') AND {where}"


def _lacks(types: str, side: str, other: str, label: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM e JOIN n x ON x.id = e.{other} WHERE e.{side} = n.id AND e.type IN ({types}) AND list_contains(x.labels, '{label}'))"


_GAPS = " UNION ALL ".join([
    _gap("event_needs_time", "critical", "Event", "description", "Event '{entity_desc}' has no timestamp", _lacks("'OCCURRED_AT_TIME'", "src", "dst", "Time")),
    _gap("event_needs_location", "critical", "Event", "description", "Event '{entity_desc}' has no location", _lacks("'OCCURRED_AT'", "src", "dst", "Location")),
    _gap("event_needs_participant", "critical", "Event", "description", "Event '{entity_desc}' has no participants or witnesses", _lacks("'PARTICIPATED_IN', 'WITNESSED'", "dst", "src", "Person")),
    _gap("suspect_needs_description", "high", "Person", "name_or_description", "Suspect '{entity_desc}' has no physical description", "props['role'] = 'suspect' AND " + _lacks("'DESCRIBED_AS'", "src", "dst", "PhysicalDescription")),
    _gap("vehicle_needs_identifiers", "high", "Vehicle", "description", "Vehicle '{entity_desc}' has no identifying details", "props['colour'] IS NULL AND props['make'] IS NULL AND props['registration'] IS NULL"),
])


@query(f"WITH {INCIDENTS} {_GAPS}")
def completeness_rules_union(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(incidents(spark, sf), SCHEMA_ORG)


@query(f"WITH {INCIDENTS}, g AS ({_GAPS}) SELECT gap_description, CASE min(priority) WHEN 'critical' THEN 0 ELSE 1 END AS priority_order, count(*) AS n FROM g GROUP BY gap_description")
def gap_priority_sort(spark: SparkSession, sf: str) -> DataFrame:
    rows = gaps(incidents(spark, sf), SCHEMA_ORG).withColumn("priority_order", priority_rank())
    return rows.groupBy("gap_description").agg(F.min("priority_order").alias("priority_order"), F.count("*").alias("n")).orderBy("priority_order", "gap_description")


@query(f"""WITH {INCIDENTS}, k AS (SELECT count(*) FILTER (list_has_any(labels, ['Event', 'Process'])) AS ev, count(*) FILTER (list_has_any(labels, ['Person', 'Actor', 'Agent'])) AS pe, count(*) FILTER (list_has_any(labels, ['Location', 'Place', 'SpatialRegion', 'Site'])) AS pl,
count(*) FILTER (list_has_any(labels, ['Time', 'TemporalInterval'])) AS ti, count(*) FILTER (source IS NULL AND NOT list_has_any(labels, ['Observation', 'GraphVersion'])) AS un FROM n),
j AS (SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM e WHERE (e.src = n.id OR e.dst = n.id) AND e.type IN ('PARTICIPATED_IN', 'WITNESSED', 'HAS_ACTOR', 'HAS_AGENT', 'AGENT_IN', 'INVOLVED_IN'))) AS free FROM n WHERE list_contains(labels, 'Event'))
SELECT 'events' AS "check", ev >= 1 AS passed FROM k UNION ALL SELECT 'persons', pe >= 2 FROM k UNION ALL SELECT 'places', pl >= 1 FROM k UNION ALL SELECT 'times', ti >= 1 FROM k UNION ALL SELECT 'participants', free = 0 FROM j UNION ALL SELECT 'sources', un = 0 FROM k""")
def population_checks(spark: SparkSession, sf: str) -> DataFrame:
    return quality.population_checks(incidents(spark, sf))


@query(f"""WITH {INCIDENTS}, l AS (SELECT unnest({list(LABELS)!r}) AS label), s AS (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM n WHERE list_contains(n.labels, l.label)) THEN 1.0 ELSE 0.0 END) AS x FROM l),
i AS (SELECT count(*) FILTER (id IN (SELECT src FROM e UNION SELECT dst FROM e)) / count(*) AS x FROM n), g AS (SELECT 1 - count(*) FILTER (source IS NULL) / count(*) AS x FROM n WHERE NOT list_contains(labels, 'Observation'))
SELECT round(0.15 * s.x + 0.15 * i.x + 0.20 * g.x, 6)::DOUBLE AS skipped, round((0.15 * s.x + 0.15 * i.x + 0.20 * g.x) / 0.5, 6)::DOUBLE AS active FROM s, i, g""")
def overall_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Schema, structure and grounding of the incidents; the dimensions that were skipped count as 0, or not at all where only active ones are asked for."""
    g = incidents(spark, sf)
    score = lambda df: float(df.first()["score"])
    results = [quality.Result("schema", score(quality.schema_score(g, LABELS))), quality.Result("structural", score(quality.structural_score(g))), quality.Result("constraint", score(quality.grounding_score(g, None)))]
    results += [quality.Result(d, quality.SKIPPED) for d in ("consistency", "coherence", "faithfulness")]
    return spark.createDataFrame([(round(quality.overall(results), 6), round(quality.overall(results, normalise_active=True), 6))], "skipped double, active double")


@query("""SELECT doc_id, round(sqrt(s), 4) AS distance FROM (
WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY label, i),
q AS (SELECT vec_id, d.label, sqrt(sum((x - m) * (x - m))) AS dist FROM d JOIN c ON c.label = d.label AND c.i = d.i GROUP BY vec_id, d.label), s AS (SELECT label, avg(dist) AS a, stddev_pop(dist) AS sd, count(*) AS k FROM q GROUP BY label)
SELECT vec_id AS doc_id, dist * dist AS s FROM q JOIN s USING (label) WHERE k >= 2 AND sd >= 1e-8 AND dist > a + 2 * sd)""")
def label_centroid_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return quality.centroid_outliers(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("doc_id"), F.round("distance", 4).alias("distance"))


@query("""SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 4) AS distance
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) < 1.21""")
def near_duplicate_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return quality.near_pairs(table(spark, sf, "embeddings"), 1.1).withColumn("distance", F.round("distance", 4))


@query("SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10)")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten vectors nearest to the first one: a top-k report."""
    v = table(spark, sf, "embeddings")
    return top_k(v, v.orderBy("vec_id").select("embedding").first()["embedding"], 10).select("vec_id", F.round("score", 6).alias("score"))


_PARSE = r"""CASE WHEN regexp_matches(v, '(\d{1,2}):(\d{2}):(\d{2})') THEN regexp_extract(v, '(\d{1,2}):(\d{2}):(\d{2})', 1)::DOUBLE * 60 + regexp_extract(v, '(\d{1,2}):(\d{2}):(\d{2})', 2)::DOUBLE + regexp_extract(v, '(\d{1,2}):(\d{2}):(\d{2})', 3)::DOUBLE / 60
WHEN regexp_matches(v, '(\d{1,2}):(\d{2})\s*(AM|PM|am|pm)') THEN (regexp_extract(v, '(\d{1,2}):(\d{2})\s*(AM|PM|am|pm)', 1)::INT % 12 + CASE WHEN upper(regexp_extract(v, '(\d{1,2}):(\d{2})\s*(AM|PM|am|pm)', 3)) = 'PM' THEN 12 ELSE 0 END) * 60.0 + regexp_extract(v, '(\d{1,2}):(\d{2})\s*(AM|PM|am|pm)', 2)::DOUBLE
WHEN regexp_matches(v, '(\d{1,2}):(\d{2})\b') THEN regexp_extract(v, '(\d{1,2}):(\d{2})\b', 1)::DOUBLE * 60 + regexp_extract(v, '(\d{1,2}):(\d{2})\b', 2)::DOUBLE
WHEN regexp_matches(v, 'quarter past (\w+)') THEN coalesce(map {'one': 1, 'two': 2, 'three': 3, 'four': 4, 'five': 5, 'six': 6, 'seven': 7, 'eight': 8, 'nine': 9, 'ten': 10, 'eleven': 11, 'twelve': 12, 'noon': 12, 'midnight': 0}[lower(regexp_extract(v, 'quarter past (\w+)', 1))], 0) * 60.0 + 15
WHEN regexp_matches(v, 'half past (\w+)') THEN coalesce(map {'one': 1, 'two': 2, 'three': 3, 'four': 4, 'five': 5, 'six': 6, 'seven': 7, 'eight': 8, 'nine': 9, 'ten': 10, 'eleven': 11, 'twelve': 12, 'noon': 12, 'midnight': 0}[lower(regexp_extract(v, 'half past (\w+)', 1))], 0) * 60.0 + 30 END"""


@query(f"WITH {INCIDENTS}, t AS (SELECT id, props['value'] AS v FROM n WHERE list_contains(labels, 'Time')) SELECT id, round({_PARSE}, 6)::DOUBLE AS minutes FROM t")
def parse_time(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).labelled("Time").select("id", F.round(temporal.parse_time(F.col("props")["value"]), 6).alias("minutes"))


@query(f"""WITH {INCIDENTS}, r AS (SELECT ev.id, t.id AS m, ev.props['description'] AS description, t.props['value'] AS v, ev.source, ev.labels[1] AS label FROM e JOIN n ev ON ev.id = e.src AND list_contains(ev.labels, 'Event') JOIN n t ON t.id = e.dst AND list_contains(t.labels, 'Time') WHERE e.type IN ('AT_TIME', 'OCCURRED_AT_TIME', 'HAS_TIME'))
SELECT description, coalesce(nullif(v, ''), 'unknown') AS time, round({_PARSE}, 6)::DOUBLE AS minutes, source, label FROM r QUALIFY row_number() OVER (PARTITION BY description ORDER BY id, m) = 1""")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.timeline(incidents(spark, sf)).select("description", "time", F.round("time_minutes", 6).alias("minutes"), "source", "label")


@query("SELECT user_id, event_id, next_event_id FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_id FROM events) WHERE next_event_id IS NOT NULL")
def timeline_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return temporal.neighbours_in_time(ev, "event_id", "ts", "event_id", "user_id").select("user_id", "event_id", "next_event_id")


@query(f"""WITH {INCIDENTS}, h AS (SELECT src, dst FROM e WHERE type = 'OCCURRED_AT_TIME')
SELECT 'two times' AS issue, a.src AS id FROM h a JOIN h b ON a.src = b.src AND a.dst <> b.dst JOIN n x ON x.id = a.dst AND list_contains(x.labels, 'Time') JOIN n y ON y.id = b.dst AND list_contains(y.labels, 'Time')
UNION ALL SELECT 'no time', v.id FROM n v WHERE list_contains(v.labels, 'Event') AND NOT EXISTS (SELECT 1 FROM h JOIN n t ON t.id = h.dst WHERE h.src = v.id AND list_contains(t.labels, 'Time'))""")
def temporal_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.conflicts(incidents(spark, sf), each=None)


@query(f"""WITH {INCIDENTS}, gone AS (SELECT id FROM n WHERE source = 'cam-wesgate-000' OR (list_contains(labels, 'Observation') AND contains(props['description'], 'cam-wesgate-000')))
SELECT (SELECT count(*) FROM n WHERE source = 'cam-wesgate-000') AS nodes, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM n WHERE source = 'cam-wesgate-000') OR dst IN (SELECT id FROM n WHERE source = 'cam-wesgate-000')) AS relationships,
(SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM gone)) AS left_nodes, (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) AS left_relationships""")
def whatif_remove_source(spark: SparkSession, sf: str) -> DataFrame:
    after, counts = fusion.remove_source(incidents(spark, sf), "cam-wesgate-000")
    return counts.join(after.nodes.agg(F.count("*").alias("left_nodes"))).join(after.edges.agg(F.count("*").alias("left_relationships")))


_TRUTHY = "coalesce(" + ", ".join(f"nullif(props['{k}'], '')" for k in DESC_FULL) + ")"


@query(f"""WITH {INCIDENTS}, a AS (SELECT DISTINCT array_to_string(list_sort(labels), '+') AS labels, {_TRUTHY} AS d FROM n), b AS (SELECT DISTINCT array_to_string(list_sort(labels), '+') AS labels, {_TRUTHY} AS d FROM n WHERE source IS DISTINCT FROM 'cam-wesgate-000')
SELECT labels, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.labels = a.labels AND b.d = a.d) THEN 'kept' ELSE 'only_a' END AS status, count(*) AS n FROM a WHERE d IS NOT NULL GROUP BY 1, 2""")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    g = incidents(spark, sf)
    out = fusion.what_if(g, lambda x: Graph(x.nodes.where(~F.col("source").eqNullSafe(F.lit("cam-wesgate-000"))), x.edges))
    return out.groupBy("labels", F.when(F.col("status") == "only_a", "only_a").otherwise("kept").alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH {INCIDENTS}, k AS (SELECT array_to_string(list_sort(labels), '+') AS labels, {_TRUTHY} AS d, props, id FROM n), o AS (SELECT * FROM k WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY labels, d ORDER BY id DESC) = 1)
SELECT labels, d AS "desc", 'type' AS key, props['type'] AS value_a, 'street' AS value_b FROM o WHERE props['type'] = 'road'""")
def property_diff(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.write import set_props

    out = fusion.what_if(incidents(spark, sf), lambda g: set_props(g, F.col("props")["type"] == "road", {"type": "street"}))
    return out.select("labels", "desc", F.explode("changes").alias("c")).select("labels", "desc", "c.*")


@query(f"WITH {INCIDENTS} SELECT id, round(CASE WHEN confidence IS NULL THEN 0.9 WHEN confidence < 0.95 THEN confidence + (1 - confidence) * 0.3 ELSE confidence END, 6) AS confidence FROM n")
def confidence_boost(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).nodes.select("id", F.round(fusion.boosted(F.col("confidence")), 6).alias("confidence"))


@query(f"WITH {INCIDENTS} SELECT id, round(CASE WHEN confidence IS NULL THEN 0.5 WHEN confidence > 0.3 THEN confidence * 0.7 ELSE confidence END, 6) AS confidence FROM n")
def confidence_decay(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).nodes.select("id", F.round(fusion.decayed(F.col("confidence")), 6).alias("confidence"))


@query(f"WITH {INCIDENTS} SELECT id, lower(trim(regexp_replace(trim(props['name_or_description']), '^(?i:dr|mr|ms|mrs)\\.?\\s+', ''))) AS name FROM n WHERE label = 'Person' AND props['name_or_description'] IS NOT NULL")
def normalise_names(spark: SparkSession, sf: str) -> DataFrame:
    p = incidents(spark, sf).nodes.where("label = 'Person' and props['name_or_description'] is not null")
    return p.select("id", X.plain_name(F.col("props")["name_or_description"]).alias("name"))


@query(f"""WITH {INCIDENTS}, p AS (SELECT id, props, lower(trim(regexp_replace(trim(props['name']), '^(?i:dr|mr|ms|mrs)\\.?\\s+', ''))) AS key FROM n WHERE label = 'Person' AND props['name'] IS NOT NULL)
SELECT key, arg_min(props['name'], id) AS name, arg_min(props['role'], id) FILTER (props['role'] IS NOT NULL) AS role, arg_min(props['gender'], id) FILTER (props['gender'] IS NOT NULL) AS gender FROM p GROUP BY key""")
def resolve_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    p = incidents(spark, sf).nodes.where("label = 'Person' and props['name'] is not null").select(F.col("props")["name"].alias("name"), "props", F.col("id").alias("seq"))
    return resolve_names(p).select("key", "name", F.try_element_at("props", F.lit("role")).alias("role"), F.try_element_at("props", F.lit("gender")).alias("gender"))


@query(f"WITH {INCIDENTS}, s AS (SELECT DISTINCT source FROM n WHERE NOT list_has_any(labels, ['Observation', 'GraphVersion']) AND source IS NOT NULL) SELECT a.source AS source_a, b.source AS source_b FROM s a JOIN s b ON a.source < b.source")
def source_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.source_pairs(incidents(spark, sf))


@query(f"WITH {INCIDENTS} SELECT e.id, '(' || a.labels[1] || ': ' || coalesce(a.props['description'], a.props['name_or_description'], a.props['value'], a.props['summary'], a.id::VARCHAR) || ') -[' || e.type || ']-> (' || b.labels[1] || ': ' || coalesce(b.props['description'], b.props['name_or_description'], b.props['value'], b.props['summary'], b.id::VARCHAR) || ')' AS triple FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst")
def linearise_triples(spark: SparkSession, sf: str) -> DataFrame:
    return triples(incidents(spark, sf))


@query(f"WITH {INCIDENTS}, k AS (SELECT id, coalesce({_FULL}, 'unknown') AS d FROM n WHERE NOT list_contains(labels, 'GraphVersion')) SELECT a.d AS head, e.type AS relation, b.d AS tail FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst")
def tsv_triples(spark: SparkSession, sf: str) -> DataFrame:
    return files.tsv_triples(incidents(spark, sf))


@query(f"""WITH {INCIDENTS} SELECT p, is_iri, count(*) AS n FROM (SELECT 'rdf:type' AS p, true AS is_iri FROM n, unnest(n.labels) UNION ALL SELECT x.key, false FROM (SELECT unnest(map_entries(props)) AS x FROM n) WHERE x.value IS NOT NULL UNION ALL SELECT type, true FROM e) GROUP BY 1, 2""")
def rdf_triples(spark: SparkSession, sf: str) -> DataFrame:
    return files.rdf_triples(incidents(spark, sf)).groupBy("p", "is_iri").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT DISTINCT thread_id, step, node FROM agent_states) SELECT thread_id, step, node, (count(*) OVER (PARTITION BY thread_id) - row_number() OVER (PARTITION BY thread_id ORDER BY step))::INT AS later FROM s""")
def thread_state_history(spark: SparkSession, sf: str) -> DataFrame:
    return agent.history(table(spark, sf, "agent_states")).select("thread_id", "step", "node", "later")


@query("""WITH s AS (SELECT DISTINCT thread_id, step, node FROM agent_states) SELECT thread_id, step, node, lag(node) OVER w AS previous_node, (step - lag(step) OVER w)::INT AS gap FROM s WINDOW w AS (PARTITION BY thread_id ORDER BY step)""")
def thread_state_diff(spark: SparkSession, sf: str) -> DataFrame:
    return agent.transitions(table(spark, sf, "agent_states"))


@query("""WITH d AS (SELECT DISTINCT id, content FROM rag_documents WHERE content IS NOT NULL), p AS (SELECT id, list_filter(list_transform(string_split(content, '.'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS s FROM d)
SELECT id, i AS pos, array_to_string(s[i * 4 + 1: i * 4 + 4], '. ') || '.' AS chunk FROM (SELECT id, s, unnest(range(0, ((len(s) + 3) // 4)::BIGINT))::INT AS i FROM p WHERE len(s) > 0)""")
def chunk_4(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "rag_documents").where("content is not null").select("id", "content").distinct()
    return d.select("id", F.explode(X.chunks(F.col("content"))).alias("c")).select("id", "c.pos", F.col("c.text").alias("chunk"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf, "events").select("event_id", X.tolerant_json(fenced, "k string")["k"].alias("k"))


@query("SELECT doc_id, CASE WHEN lower(trim(v)) = 'sufficient' THEN 'answer' ELSE 'retry' END AS route FROM (SELECT doc_id, CASE WHEN n_chars > 500 THEN 'Sufficient' ELSE 'insufficient' END AS v FROM documents)")
def relevance_route(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", route(F.when(F.col("n_chars") > 500, "Sufficient").otherwise("insufficient")).alias("route"))


@query("SELECT o_orderkey, coalesce(n_name, 'not found') AS n_name FROM (SELECT o_orderkey, o_custkey % 40 AS k FROM orders) LEFT JOIN nation ON n_nationkey = k")
def kv_lookup(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 40).cast("int").alias("n_nationkey"))
    return agent.lookup(keys, table(spark, sf, "nation"), "n_nationkey", "n_name").select("o_orderkey", "n_name")


_KNOWN_L, _KNOWN_R = tuple(SCHEMA_ORG.nodes), tuple(SCHEMA_ORG.rels)


@query(f"WITH {INCIDENTS} SELECT 'label' AS item_kind, label AS name, count(*) AS n FROM n WHERE label NOT IN {_KNOWN_L!r} GROUP BY label UNION ALL SELECT 'relationship', type, count(*) FROM e WHERE type NOT IN {_KNOWN_R!r} GROUP BY type")
def vocabulary_violations(spark: SparkSession, sf: str) -> DataFrame:
    return outside_vocabulary(incidents(spark, sf), SCHEMA_ORG)


@query(f"WITH {INCIDENTS}, k AS (SELECT id FROM n WHERE label IN {_KNOWN_L!r}) SELECT type, count(*) AS n FROM e WHERE type IN {_KNOWN_R!r} AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY type")
def vocabulary_filter(spark: SparkSession, sf: str) -> DataFrame:
    return in_vocabulary(incidents(spark, sf), SCHEMA_ORG).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = stream.windowed_counts(table(spark, sf, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return stream.sessions(table(spark, sf, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query(f"WITH {INCIDENTS}, k AS (SELECT id, {_FULL} AS d FROM n WHERE NOT list_has_any(labels, ['Observation', 'GraphVersion']) AND source IS NOT NULL) SELECT d AS entity, count(*) AS n FROM k WHERE d IS NOT NULL GROUP BY d HAVING count(*) > 1")
def shared_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.entities(incidents(spark, sf)).where("desc is not null").groupBy(F.col("desc").alias("entity")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {INCIDENTS}, b AS (SELECT id, src AS u, dst AS v FROM e UNION SELECT id, dst, src FROM e), s AS (SELECT id FROM n WHERE lower({_FULL}) LIKE '%norwick%' ORDER BY id LIMIT 5)
SELECT start_id, end_id, length FROM (SELECT b.u AS start_id, b.v AS end_id, 1 AS length FROM b JOIN s ON s.id = b.u UNION ALL SELECT a.u, c.v, 2 FROM b a JOIN s ON s.id = a.u JOIN b c ON c.u = a.v AND c.id <> a.id)""")
def seeded_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """Two hops around the first five nodes that name a place; the limit per term is the retriever's."""
    from graphloom.operators.retrieval import neighbourhood, seeds

    g = incidents(spark, sf)
    seed = seeds(g, spark.createDataFrame([("Norwick",)], "term string"))
    return neighbourhood(g, seed, each=1_000_000).select("start_id", "end_id", "length")
