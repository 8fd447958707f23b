"""Queries of ingest, fusion, provenance, retrieval, exports, training records and further probes, each compared in every row and column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.functions.store import materialize, table
from graphloom.model import DESC_FULL, Graph
from graphloom.ontology import SCHEMA_ORG, Shape, aligned, property_completeness, stale, violations
from graphloom.operators import fusion, ingest, quality, retrieval, temporal, training
from graphloom.operators import match as M
from graphloom.operators.instants import node_instants
from graphloom.operators.snapshots import complete_deliveries
from graphloom.plans.graphs import INCIDENTS, incidents, ring, tree
from graphloom.sources import files

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL that states the same."""
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


_FULL = "coalesce(" + ", ".join(f"props['{k}']" for k in DESC_FULL) + ")"
_TRUTHY = "coalesce(" + ", ".join(f"nullif(props['{k}'], '')" for k in DESC_FULL) + ")"
_ENTRIES = "list_sort(list_filter(map_entries(props), lambda x: x.value IS NOT NULL))"

# ---- exports, whole


def _case(table_: dict[str, str], column: str, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {default} END"


_ESCAPED = r"""replace(replace(replace(replace(x.value, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r')"""


@query(f"""WITH {INCIDENTS} SELECT 'node' AS kind, id, 'node:' || id || chr(10) || array_to_string(list_concat(['    a ' || {_case(files.CLASSES, "coalesce(labels[1], 'Thing')", "'evt:' || coalesce(labels[1], 'Thing')")}],
list_transform({_ENTRIES}, lambda x: CASE WHEN x.key = 'confidence' THEN '    evt:confidence "' || {_ESCAPED} || '"^^xsd:float' WHEN x.key = 'extracted_at' THEN '    prov:generatedAtTime "' || {_ESCAPED} || '"^^xsd:dateTime'
WHEN x.key = 'source' THEN '    prov:wasAttributedTo "' || {_ESCAPED} || '"' WHEN x.key IN ('description', 'name_or_description', 'name') THEN '    rdfs:label "' || {_ESCAPED} || '"' ELSE '    evt:' || x.key || ' "' || {_ESCAPED} || '"' END)), ' ;' || chr(10)) || ' .' AS line FROM n
UNION ALL SELECT 'relationship', id, 'node:' || src || ' ' || {_case(files.PREDICATES, "type", "'evt:' || type")} || ' node:' || dst || ' .' FROM e""")
def turtle_graph(spark: SparkSession, sf: str) -> DataFrame:
    return files.turtle_lines(incidents(spark, sf))


_JSON = """'"' || replace(replace(replace(replace(replace({}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"'"""


@query(f"""WITH {INCIDENTS}, r AS (SELECT src AS id, lower(type) AS k, list_sort(list('{{"@id":"urn:event-twin:node:' || dst || '"}}')) AS refs FROM e GROUP BY 1, 2),
g AS (SELECT id, list('"' || k || '":' || CASE WHEN len(refs) = 1 THEN refs[1] ELSE '[' || array_to_string(refs, ',') || ']' END ORDER BY k) AS links FROM r GROUP BY id)
SELECT n.id, '{{' || array_to_string(list_concat(['"@id":"urn:event-twin:node:' || n.id || '"', '"@type":' || '[' || array_to_string(list_transform(labels, lambda l: '"' || l || '"'), ',') || ']'],
list_transform({_ENTRIES}, lambda x: '"' || x.key || '":' || {_JSON.format('x.value')}), coalesce(links, [])), ',') || '}}' AS json FROM n LEFT JOIN g ON g.id = n.id""")
def jsonld_graph(spark: SparkSession, sf: str) -> DataFrame:
    return files.jsonld_nodes(incidents(spark, sf))


_SHORT = f"coalesce({_TRUTHY}, 'node_' || id)"


@query(f"""WITH {INCIDENTS} SELECT 'node' AS kind, id, 'n' || id || ' [label="' || coalesce(labels[1], 'Node') || '\\n' || replace(CASE WHEN length({_SHORT}) > 40 THEN substring({_SHORT}, 1, 37) || '...' ELSE {_SHORT} END, '"', '\\"')
|| CASE WHEN coalesce(source, '') <> '' THEN '\\n[' || source || ']' ELSE '' END || CASE WHEN coalesce(confidence_raw, '') <> '' THEN ' (' || confidence_raw || ')' ELSE '' END || '", fillcolor="' || {_case(files.COLOURS, "coalesce(labels[1], 'Node')", "'#bdc3c7'")} || '", fontcolor="white"];' AS line FROM n
UNION ALL SELECT 'relationship', id, 'n' || src || ' -> n' || dst || ' [label="' || type || '"' || {_case(files.EDGE_STYLES, "type", "''")} || '];' FROM e""")
def dot_graph(spark: SparkSession, sf: str) -> DataFrame:
    return files.dot_lines(incidents(spark, sf))


@query(f"""WITH {INCIDENTS} SELECT 'node' AS kind, id, 'CREATE (n' || id || array_to_string(list_transform(labels, lambda l: ':' || l), '') || ' {{' || array_to_string(list_transform({_ENTRIES}, lambda x: x.key || ': ''' || replace(replace(x.value, '\\', '\\\\'), '''', '\\''') || ''''), ', ') || '}});' AS line FROM n
UNION ALL SELECT 'relationship', id, 'CREATE (n' || src || ')-[:' || type || ']->(n' || dst || ');' FROM e""")
def cypher_graph(spark: SparkSession, sf: str) -> DataFrame:
    return files.cypher_lines(incidents(spark, sf))


@query(f"""WITH {INCIDENTS}, k AS (SELECT * FROM n WHERE ontology_id = 'sem-event-v1') SELECT 'node:' || id AS s, 'rdf:type' AS p, unnest(labels) AS o, true AS is_iri FROM k
UNION ALL SELECT s, x.key, x.value, false FROM (SELECT 'node:' || id AS s, unnest(map_entries(props)) AS x FROM k) WHERE x.value IS NOT NULL UNION ALL SELECT 'node:' || src, type, 'node:' || dst, true FROM e""")
def rdf_of_ontology(spark: SparkSession, sf: str) -> DataFrame:
    return files.rdf_triples(incidents(spark, sf), "sem-event-v1")


@query(r"""WITH d AS (SELECT DISTINCT id, content FROM rag_documents WHERE content IS NOT NULL), s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> '') AS l FROM d)
SELECT id, pos::INT AS pos, l[pos + 1] AS sentence FROM (SELECT id, l, unnest(range(0, len(l)::BIGINT)) AS pos FROM s)""")
def sentence_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "rag_documents").where("content is not null").select("id", "content").distinct()
    return d.select("id", F.posexplode(X.sentences(F.col("content"))).alias("pos", "sentence"))


# ---- scores that were stated by constants, over planted cases


_CLOSED = "{0}r AS (SELECT src, dst FROM {1} WHERE src <> dst UNION SELECT {0}r.src, x.dst FROM {0}r JOIN {1} x ON x.src = {0}r.dst WHERE x.src <> x.dst)"
_RING = """ri AS (SELECT n_nationkey::BIGINT AS src, ((2 * n_nationkey + 1) % 25)::BIGINT AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey % 5 = 0)"""
_TREE = "tr AS (SELECT ((n_nationkey - 1) // 2)::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation WHERE n_nationkey > 0)"
_TWINS = "(SELECT count(*) FROM (SELECT n_name FROM nation GROUP BY n_name HAVING count(*) > 1))"


@query(f"""WITH RECURSIVE {_RING}, {_TREE}, {_CLOSED.format('a', 'ri')}, {_CLOSED.format('b', 'tr')}
SELECT ((CASE WHEN EXISTS (SELECT 1 FROM ar WHERE src = dst) THEN 0 ELSE 1 END) + (CASE WHEN {_TWINS} = 0 THEN 1 ELSE 0 END)) / 2 AS ring, ((CASE WHEN EXISTS (SELECT 1 FROM br WHERE src = dst) THEN 0 ELSE 1 END) + (CASE WHEN {_TWINS} = 0 THEN 1 ELSE 0 END)) / 2 AS tree""")
def consistency_score(spark: SparkSession, sf: str) -> DataFrame:
    """The ring has cycles, the tree has none; both sides find that out from the relationships."""
    return spark.createDataFrame([(float(quality.consistency_score(ring(spark, sf), ("PRECEDES",))), float(quality.consistency_score(tree(spark, sf), ("MANAGES",))))], "ring double, tree double")


def _planted(spark: SparkSession, sf: str) -> Graph:
    """The incidents with two types of relationship taken for corroborations and contradictions."""
    g = incidents(spark, sf)
    type_ = F.when((F.col("type") == "USED") & (F.col("id") % 100 == 0), "CORROBORATED_BY").when((F.col("type") == "DROVE") & (F.col("id") % 100 == 1), "CONTRADICTS").otherwise(F.col("type"))
    return Graph(g.nodes, g.edges.withColumn("type", type_))


_PLANTED = f"{INCIDENTS}, pe AS (SELECT * REPLACE (CASE WHEN type = 'USED' AND id % 100 = 0 THEN 'CORROBORATED_BY' WHEN type = 'DROVE' AND id % 100 = 1 THEN 'CONTRADICTS' ELSE type END AS type) FROM e)"


@query(f"""WITH {_PLANTED}, c AS (SELECT count(*) FILTER (type = 'CORROBORATED_BY') AS k, count(*) FILTER (type = 'CONTRADICTS') AS x FROM pe)
SELECT (SELECT count(DISTINCT source) FROM n) AS sources, round(greatest(0, least(1, 0.7 + least(0.3, 0.05 * k) - least(0.5, 0.1 * x))), 6)::DOUBLE AS score FROM c""")
def cross_source_score(spark: SparkSession, sf: str) -> DataFrame:
    return quality.cross_source_score(_planted(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {_PLANTED}, k AS (SELECT (SELECT count(*) FROM n WHERE NOT list_has_any(labels, ['Observation', 'GraphVersion']) AND source IS NOT NULL) AS entities, (SELECT count(*) FROM pe WHERE type = 'CONTRADICTS') AS contradictions) SELECT contradictions, entities, round(contradictions / entities, 8) AS density FROM k")
def contradiction_density(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.contradiction_density(_planted(spark, sf)).withColumn("density", F.round("density", 8))


def _mixed(spark: SparkSession, sf: str) -> Graph:
    """The incidents with some times of events taken for places, which breaks a shape."""
    g = incidents(spark, sf)
    return Graph(g.nodes, g.edges.withColumn("type", F.when((F.col("type") == "OCCURRED_AT_TIME") & (F.col("id") % 50 == 0), "OCCURRED_AT").otherwise(F.col("type"))))


@query(f"""WITH {INCIDENTS}, m AS (SELECT * REPLACE (CASE WHEN type = 'OCCURRED_AT_TIME' AND id % 50 = 0 THEN 'OCCURRED_AT' ELSE type END AS type) FROM e)
SELECT 'EventShape' AS shape, 'OCCURRED_AT' AS path, 'class' AS kind, 'Violation' AS severity, m.src AS id FROM m JOIN n a ON a.id = m.src AND list_contains(a.labels, 'Event') JOIN n b ON b.id = m.dst AND NOT list_contains(b.labels, 'Location') WHERE m.type = 'OCCURRED_AT'""")
def shape_class(spark: SparkSession, sf: str) -> DataFrame:
    return violations(_mixed(spark, sf), [Shape("EventShape", ("Event",), "OCCURRED_AT", "class", end="Location")])


@query(f"WITH {INCIDENTS} SELECT 'TimeShape' AS shape, 'date' AS path, 'datatype' AS kind, 'Violation' AS severity, id FROM n WHERE list_contains(labels, 'Time') AND props['date'] IS NOT NULL AND NOT regexp_matches(trim(props['date']), '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$')")
def shape_datatype(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of Time nodes that cannot be read as dates; that strings are strings is never broken."""
    shapes = [Shape("TimeShape", ("Time",), "date", "datatype", ("date",)), Shape("TimeShape", ("Time",), "value", "datatype", ("string",))]
    return violations(incidents(spark, sf), shapes)


@query(f"""WITH {INCIDENTS}, k AS (SELECT *, list_has_any(labels, ['Event', 'Person', 'Vehicle', 'Location', 'Time', 'Object', 'PhysicalDescription']) AS told FROM n)
SELECT count(*) FILTER (list_contains(labels, 'Event') AND props['type'] IS NULL) + count(*) FILTER (list_contains(labels, 'Person') AND props['role'] IS NULL) AS errors, count(*) FILTER (told AND source IS NULL) AS warnings, count(*) FILTER (told AND confidence_raw IS NULL) AS infos FROM k""")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    every = ("Event", "Person", "Vehicle", "Location", "Time", "Object", "PhysicalDescription")
    shapes = [Shape("EventShape", ("Event",), "type", "min_count"), Shape("PersonShape", ("Person",), "role", "min_count"), Shape("ProvenanceShape", every, "source", "min_count", severity="Warning"), Shape("ProvenanceShape", every, "confidence", "min_count", severity="Info")]
    return quality.severities(violations(incidents(spark, sf), shapes))


@query("SELECT event_type AS dimension, count(*) AS runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, min(value) AS low, max(value) AS high, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events WHERE value >= 0 GROUP BY event_type")
def calibration_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.calibration(table(spark, sf, "events"), "event_type", "value").select(F.col("event_type").alias("dimension"), "runs", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "low", "high", "median")


@query("SELECT user_id, round(avg(value), 6) AS score FROM events WHERE value >= 0 GROUP BY user_id")
def composite_scores(spark: SparkSession, sf: str) -> DataFrame:
    return quality.composite(table(spark, sf, "events").withColumnRenamed("value", "score"), ("user_id",)).withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM d GROUP BY label, i),
q AS (SELECT vec_id, d.label, sqrt(sum((x - m) * (x - m))) AS dist FROM d JOIN c ON c.label = d.label AND c.i = d.i GROUP BY vec_id, d.label), s AS (SELECT label, avg(dist) AS a, stddev_pop(dist) AS sd, count(*) AS k FROM q GROUP BY label),
o AS (SELECT count(*) AS k FROM q JOIN s USING (label) WHERE s.k >= 2 AND sd >= 1e-8 AND dist > a + 2 * sd),
p AS (SELECT count(*) AS k FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) < 1.21)
SELECT (SELECT count(*) FROM embeddings) AS vectors, o.k AS outliers, p.k AS near, round(greatest(0, 1 - 0.15 * o.k), 6)::DOUBLE AS score FROM o, p""")
def clustering_score(spark: SparkSession, sf: str) -> DataFrame:
    return quality.entity_clustering(table(spark, sf, "embeddings"), limit=1.1).withColumn("score", F.round("score", 6))


@query()
def link_prediction_score(spark: SparkSession, sf: str) -> DataFrame:
    """Rotations trained on relationships between kinds of things; numpy's own numbers, so no SQL."""
    g = incidents(spark, sf)
    side = lambda k, n: g.nodes.select(F.col("id").alias(k), F.concat("label", F.lit(" "), F.coalesce(F.col("props")["type"], F.lit("?"))).alias(n))
    triples = g.edges.join(side("src", "head"), "src").join(side("dst", "tail"), "dst").select("head", F.col("type").alias("relation"), "tail")
    results = [quality.link_prediction(triples, epochs=20), quality.plausible(triples, epochs=20)]
    return spark.createDataFrame([(r.dimension, float(r.score)) for r in results], "dimension string, score double")


@query(f"""WITH {INCIDENTS}, k AS (SELECT e.id, a.label AS head, e.type AS relation, b.label AS tail FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst)
SELECT DISTINCT head, 'WITNESSED' AS relation, tail FROM k WHERE (head, tail) NOT IN (SELECT (head, tail) FROM k WHERE relation = 'WITNESSED')""")
def novel_triples(spark: SparkSession, sf: str) -> DataFrame:
    """What would be new if every relationship were one of witnessing."""
    g = incidents(spark, sf)
    side = lambda k, n: g.nodes.select(F.col("id").alias(k), F.col("label").alias(n))
    known = g.edges.join(side("src", "head"), "src").join(side("dst", "tail"), "dst").select("head", F.col("type").alias("relation"), "tail").distinct()
    return quality.novel(known.withColumn("relation", F.lit("WITNESSED")).distinct(), known)


# ---- fusion


def _described(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    """Every description of fusion_matches as a node of confidence 0.5, and the matches."""
    m = table(spark, sf, "fusion_matches").where(~F.isnan("confidence"))
    d = m.select(F.explode(F.array("entity_a_desc", "entity_b_desc")).alias("d")).where("d is not null and d <> ''").distinct()
    nodes = d.select(F.xxhash64("d").alias("id"), F.array(F.lit("Person")).alias("labels"), F.lit("Person").alias("label"), F.create_map(F.lit("description"), F.col("d")).alias("props"), F.lit("s").alias("source"), F.lit("statement").alias("source_type"), F.lit(0.5).alias("confidence"), F.lit("0.5").alias("confidence_raw"), F.lit(None).cast("string").alias("extracted_at"), F.lit(None).cast("string").alias("ontology_id"))
    edges = spark.createDataFrame([], "id bigint, src bigint, dst bigint, type string, props map<string,string>")
    return Graph(materialize(nodes, "described"), edges), m


_MATCHES = "m AS (SELECT * FROM fusion_matches WHERE confidence IS NULL OR NOT isnan(confidence)), g AS (SELECT * FROM m WHERE entity_a_desc <> '' AND entity_b_desc <> '' AND entity_a_desc <> entity_b_desc)"
_DESCS = "SELECT entity_a_desc AS d FROM m WHERE entity_a_desc <> '' UNION SELECT entity_b_desc FROM m WHERE entity_b_desc <> ''"


@query(f"""WITH RECURSIVE {_MATCHES}, h AS (SELECT d, count(*) AS k FROM (SELECT entity_a_desc AS d FROM g WHERE confidence >= 0.8 UNION ALL SELECT entity_b_desc FROM g WHERE confidence >= 0.8) GROUP BY d),
f AS (SELECT x.d, coalesce(h.k, 0) AS k, 0 AS i, 0.5::DOUBLE AS c FROM ({_DESCS}) x LEFT JOIN h ON h.d = x.d UNION ALL SELECT d, k, i + 1, CASE WHEN c < 0.95 THEN c + (1 - c) * 0.3 ELSE c END FROM f WHERE i < k)
SELECT d AS entity, round(c, 6) AS confidence FROM f WHERE i = k""")
def match_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of every described entity after all matches were applied."""
    graph, m = _described(spark, sf)
    return fusion.apply_matches(graph, m).nodes.select(F.col("props")["description"].alias("entity"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_MATCHES} SELECT entity_a_desc AS entity_a, entity_b_desc AS entity_b, 'POSSIBLY_SAME_AS' AS type, arg_max(reasoning, seq) FILTER (reasoning IS NOT NULL) AS reasoning FROM g GROUP BY 1, 2")
def match_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links that the matches leave, each with the last reasoning."""
    graph, m = _described(spark, sf)
    fused = fusion.apply_matches(graph, m)
    side = lambda k, n: graph.nodes.select(F.col("id").alias(k), F.col("props")["description"].alias(n))
    return fused.edges.join(side("src", "entity_a"), "src").join(side("dst", "entity_b"), "dst").select("entity_a", "entity_b", "type", F.try_element_at("props", F.lit("reasoning")).alias("reasoning"))


@query(f"""WITH RECURSIVE {_MATCHES}, z AS (SELECT * FROM g WHERE confidence < 0.3), h AS (SELECT d, count(*) AS k FROM (SELECT entity_a_desc AS d FROM z UNION ALL SELECT entity_b_desc FROM z) GROUP BY d),
f AS (SELECT x.d, coalesce(h.k, 0) AS k, 0 AS i, 0.5::DOUBLE AS c FROM ({_DESCS}) x LEFT JOIN h ON h.d = x.d UNION ALL SELECT d, k, i + 1, CASE WHEN c > 0.3 THEN c * 0.7 ELSE c END FROM f WHERE i < k)
SELECT d AS entity, round(c, 6) AS confidence FROM f WHERE i = k""")
def contradiction_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that hardly match, taken for contradictions."""
    graph, m = _described(spark, sf)
    against = m.where("confidence < 0.3 and entity_a_desc <> entity_b_desc").select("seq", "entity_a_desc", "entity_b_desc", F.lit("description").alias("field"))
    return fusion.apply_contradictions(graph, against).nodes.select(F.col("props")["description"].alias("entity"), F.round("confidence", 6).alias("confidence"))


_TOLD = f"k AS (SELECT id, label, source, source_type, {_FULL} AS d FROM n WHERE NOT list_has_any(labels, ['Observation', 'GraphVersion']) AND source IS NOT NULL)"
_PLAIN = "lower(trim(regexp_replace(trim(d), '^(?i:dr|mr|ms|mrs)\\.?\\s+', '')))"


@query(f"""WITH {INCIDENTS}, {_TOLD}, x AS (SELECT DISTINCT label, source, d, {_PLAIN} AS key FROM k WHERE d IS NOT NULL), m AS (SELECT DISTINCT a.d AS da, b.d AS db FROM x a JOIN x b ON a.label = b.label AND a.key = b.key AND a.source < b.source)
SELECT DISTINCT a.source AS source_a, b.source AS source_b FROM m JOIN x a ON a.d = m.da JOIN x b ON b.d = m.db WHERE a.source <> b.source""")
def corroborated_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of sources that tell of a strongly matched entity, by the default matcher."""
    g = incidents(spark, sf)
    return fusion.corroboration_groups(g, fusion.resolve(g))[0]


@query(f"""WITH {INCIDENTS}, {_TOLD}, w AS (SELECT id, unnest(regexp_split_to_array(coalesce(props['description'], ''), '[\\s,;()]+')) AS source FROM n WHERE list_contains(labels, 'Observation'))
SELECT DISTINCT source, id AS observation FROM w WHERE source IN (SELECT source FROM k)""")
def source_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The Observations that name each source."""
    g = incidents(spark, sf)
    return fusion.corroboration_groups(g, fusion.resolve(g))[1]


@query(f"WITH {INCIDENTS}, {_TOLD}, x AS (SELECT label, d, count(DISTINCT source) AS s FROM k WHERE d IS NOT NULL GROUP BY label, d) SELECT label, count(*) AS entities, count(*) FILTER (s > 1) AS corroborated, round(count(*) FILTER (s > 1) / count(*), 6) AS rate FROM x GROUP BY label")
def corroboration_rate(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.corroboration_rate(incidents(spark, sf)).withColumn("rate", F.round("rate", 6))


@query(f"WITH {INCIDENTS} SELECT id, coalesce(confidence, CASE source_type WHEN 'cctv' THEN 0.95 WHEN 'forensic_report' THEN 0.95 WHEN 'medical_report' THEN 0.9 WHEN 'police_report' THEN 0.85 WHEN 'statement' THEN 0.7 END, 0.5)::DOUBLE AS confidence FROM n")
def weighted_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.weighted_confidence(incidents(spark, sf))


@query(f"""WITH {INCIDENTS}, c AS (SELECT id, src, dst, type, CASE WHEN id % 4 = 0 THEN NULL ELSE (id % 100) / 100 END AS c FROM e)
SELECT a.src AS start_id, b.dst AS end_id, round(least(coalesce(a.c, 0.5), coalesce(b.c, 0.5)), 6)::DOUBLE AS confidence FROM c a JOIN c b ON a.dst = b.src AND a.id <> b.id WHERE a.type = 'INVOLVED_IN' AND b.type = 'OCCURRED_AT'""")
def path_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Chains from a person over an event to its place, as sure as their weaker link; relationships are given a confidence by id."""
    g = incidents(spark, sf)
    sure = F.when(F.col("id") % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("confidence"), ((F.col("id") % 100) / 100).cast("string")))
    edges = g.typed("INVOLVED_IN", "OCCURRED_AT").withColumn("props", sure)
    two = M.paths(Graph(g.nodes, edges), g.labelled("Person"), 2, 2)
    first = edges.select(F.col("id").alias("_f"), F.col("type").alias("_t"))
    two = two.join(first, F.get("edge_ids", F.lit(0)) == F.col("_f")).where("_t = 'INVOLVED_IN'").drop("_f", "_t")
    return fusion.path_confidence(two, edges).select("start_id", "end_id", F.round("confidence", 6).alias("confidence"))


# ---- provenance and retrieval


@query(f"""WITH {INCIDENTS}, o AS (SELECT id, source_type FROM n WHERE list_contains(labels, 'Observation')) SELECT id AS obs, 'MADE_BY' AS type, 'witnesses' AS "group" FROM o UNION ALL SELECT id, 'OBSERVED', CASE WHEN source_type = 'statement' THEN 'events' ELSE 'events of ' || coalesce(source_type, '') END FROM o""")
def provenance_of_observations(spark: SparkSession, sf: str) -> DataFrame:
    """What each Observation points at."""
    g = incidents(spark, sf)
    return ingest.provenance_groups(g, g.labelled("Observation").select(F.col("id").alias("obs"), "source_type", F.lit(None).cast("string").alias("witness")))[0]


@query(f"""WITH {INCIDENTS}, v AS (SELECT id, source_type FROM n WHERE list_contains(labels, 'Event')), b AS (SELECT src AS e, dst AS m FROM e UNION SELECT dst, src FROM e)
SELECT 'person ' || props['name_or_description'] AS "group", id FROM n WHERE list_contains(labels, 'Person') AND props['name_or_description'] IS NOT NULL UNION ALL SELECT 'witnesses', id FROM n WHERE list_contains(labels, 'Person') AND props['role'] = 'witness' UNION ALL SELECT 'events', id FROM v
UNION ALL SELECT 'events of ' || source_type, id FROM (SELECT id, source_type FROM v UNION SELECT v.id, n.source_type FROM v JOIN b ON b.e = v.id JOIN n ON n.id = b.m) WHERE source_type IS NOT NULL AND source_type <> 'statement'""")
def provenance_members(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes in each group that Observations point at."""
    g = incidents(spark, sf)
    return ingest.provenance_groups(g, g.labelled("Observation").select(F.col("id").alias("obs"), "source_type", F.lit(None).cast("string").alias("witness")))[1]


@query(f"""WITH {INCIDENTS}, t AS (SELECT DISTINCT {_FULL} AS term FROM n WHERE label = 'Location' AND props['address'] IS NULL AND {_FULL} IS NOT NULL) SELECT t.term, n.id FROM n JOIN t ON t.term = {_FULL}""")
def exact_seed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes described exactly as some place without an address."""
    g = incidents(spark, sf)
    from graphloom.model import desc_full

    terms = g.nodes.where("label = 'Location' and props['address'] is null").select(desc_full().alias("term")).where("term is not null").distinct()
    return retrieval.exact_seeds(g, terms)


@query(f"""WITH {INCIDENTS}, l AS (SELECT src, dst FROM e WHERE type IN ('OBSERVED', 'DERIVED_FROM', 'MADE_BY')), b AS (SELECT src AS id, dst AS o FROM l UNION ALL SELECT dst, src FROM l), d AS (SELECT b.id, list_sort(list(DISTINCT n.props['description'])) AS obs FROM b JOIN n ON n.id = b.o AND list_contains(n.labels, 'Observation') WHERE n.props['description'] IS NOT NULL GROUP BY b.id)
SELECT n.id, n.source, coalesce(array_to_string(d.obs, ' | '), '') AS observations FROM n LEFT JOIN d ON d.id = n.id WHERE list_contains(n.labels, 'Event')""")
def event_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Where each event comes from."""
    g = incidents(spark, sf)
    return retrieval.provenance(g, g.labelled("Event").select("id")).withColumn("observations", F.array_join("observations", " | "))


@query(f"""WITH {INCIDENTS}, s AS (SELECT min(id) AS id FROM n WHERE label = 'Event' AND id IN (SELECT src FROM e)), b AS (SELECT id, src AS u, dst AS v FROM e UNION SELECT id, dst, src FROM e),
r AS (SELECT b.id FROM b JOIN s ON b.u = s.id UNION SELECT c.id FROM b JOIN s ON b.u = s.id JOIN b c ON c.u = b.v AND c.id <> b.id),
t AS (SELECT id, coalesce(props['description'], props['name_or_description'], props['value'], props['summary'], id::VARCHAR) AS d, labels[1] AS l, source, source_type, confidence FROM n)
SELECT e.id AS edge_id, '(' || a.l || ': ' || a.d || ') -[' || e.type || ']-> (' || z.l || ': ' || z.d || ')' AS triple, a.source, a.source_type, a.confidence FROM e JOIN r ON r.id = e.id JOIN t a ON a.id = e.src JOIN t z ON z.id = e.dst""")
def subgraph_with_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two hops around the first event, as text with provenance."""
    g = incidents(spark, sf)
    first = g.labelled("Event").join(g.edges.select(F.col("src").alias("id")), "id", "left_semi").agg(F.min("id").alias("id")).select(F.lit("first").alias("term"), "id")
    return retrieval.subgraph(g, first, each=1_000_000).drop("term")


@query(f"WITH {INCIDENTS} SELECT source, source_type, count(*) AS n FROM n WHERE source IS NOT NULL GROUP BY source, source_type")
def command_sources(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.command(incidents(spark, sf), "/sources")


@query(f"WITH {INCIDENTS} SELECT id, labels[1] AS label, {_FULL} AS description FROM n WHERE source = 'cam-wesgate-000'")
def command_from(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.command(incidents(spark, sf), "/from cam-wesgate-000")


# ---- properties, alignment, names, age


def _known(ontology) -> str:
    return ", ".join(f"('{n.label}', '{p}')" for n in ontology.nodes.values() for p in (*n.required, *n.optional))


@query(f"""WITH {INCIDENTS}, w(label, property) AS (VALUES {_known(SCHEMA_ORG)}), t AS (SELECT label, count(*) AS nodes FROM n GROUP BY label), f AS (SELECT label, x.key AS property, count(*) AS filled FROM (SELECT label, unnest(map_entries(props)) AS x FROM n) WHERE x.value IS NOT NULL AND x.value <> '' GROUP BY 1, 2)
SELECT w.label, w.property, t.nodes, coalesce(f.filled, 0) AS filled, round(coalesce(f.filled, 0) / t.nodes, 6) AS share FROM w JOIN t USING (label) LEFT JOIN f USING (label, property)""")
def property_shares(spark: SparkSession, sf: str) -> DataFrame:
    return property_completeness(incidents(spark, sf), SCHEMA_ORG).withColumn("share", F.round("share", 6))


@query(f"""WITH {INCIDENTS} SELECT CASE label WHEN 'Person' THEN 'Agent' WHEN 'Event' THEN 'Process' WHEN 'Location' THEN 'Site' WHEN 'Time' THEN 'TemporalInterval' WHEN 'Vehicle' THEN 'MaterialEntity' WHEN 'Object' THEN 'MaterialEntity' WHEN 'PhysicalDescription' THEN 'DescriptiveICE' WHEN 'Observation' THEN 'InformationContentEntity' ELSE label END AS label, count(*) AS n FROM n GROUP BY 1""")
def aligned_labels(spark: SparkSession, sf: str) -> DataFrame:
    return aligned(incidents(spark, sf), "bfo").nodes.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT a.c_custkey AS a, a.c_custkey + 1 AS b FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE levenshtein(lower(trim(a.c_name)), lower(trim(b.c_name))) <= 1")
def fuzzy_names(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring customers whose names are one letter apart."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    b = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("other"))
    return c.join(b, "c_custkey").where(X.same_name(F.col("c_name"), F.col("other"), 1)).select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))


@query()
def stale_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes extracted more than a year before the end of 2025; instants are read by p3's operator, so there is no SQL."""
    read = node_instants(table(spark, sf, "graph_nodes"), table(spark, sf, "sources")).where("field = 'extracted_at'")
    return stale(read, "2026-01-01 00:00:00", days=365)


# ---- records: training rows and ingest


def _records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A statement and a record for each snapshot's full delivery: its nodes and relationships once, in order of id."""
    s = complete_deliveries(table(spark, sf, "graph_snapshots")).withColumn("source_id", F.concat(F.col("graph_id"), F.lit(" "), F.col("snapshot_id").cast("string")))
    props = lambda p: F.map_from_entries(F.array_sort(F.filter(F.map_entries(p), lambda e: e["value"].isNotNull())))
    ents = F.transform(F.array_sort(F.array_distinct(F.transform("nodes", lambda x: F.struct(x["id"].alias("n"), F.array_min(x["labels"]).alias("label"))))), lambda x: F.struct(x["n"].cast("string").alias("id"), x["label"].alias("label"), props(F.get(F.filter("nodes", lambda y: y["id"] == x["n"]), F.lit(0))["props"]).alias("properties")))
    rels = F.transform(F.array_sort(F.array_distinct(F.transform("relationships", lambda x: F.struct(x["id"].alias("n"), x["type"].alias("t"), x["start_id"].alias("a"), x["end_id"].alias("b"))))), lambda x: F.struct(x["a"].cast("string").alias("from_id"), x["t"].alias("rel_type"), x["b"].cast("string").alias("to_id")))
    s = materialize(s.select("source_id", "graph_id", ents.alias("entities"), rels.alias("relationships")), "records")
    return s.select("source_id", F.concat(F.lit("Graph "), "graph_id").alias("text")), s.select("source_id", "entities", "relationships")


_DELIVERIES = """dl AS (SELECT graph_id || ' ' || snapshot_id AS source_id, graph_id, coalesce(nodes, []) AS nodes, coalesce(relationships, []) AS rels FROM graph_snapshots WHERE graph_id IS NOT NULL AND snapshot_id IS NOT NULL AND "timestamp" IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY graph_id, snapshot_id ORDER BY (len(coalesce(nodes, [])) >= coalesce(node_count, 0) AND len(coalesce(relationships, [])) >= coalesce(rel_count, 0)) DESC, len(coalesce(nodes, [])) + len(coalesce(relationships, [])) DESC) = 1),
en AS (SELECT source_id, id, label, row_number() OVER (PARTITION BY source_id ORDER BY id, label) - 1 AS pos, count(*) OVER (PARTITION BY source_id) AS k FROM (SELECT DISTINCT source_id, n.id AS id, list_min(n.labels) AS label FROM (SELECT source_id, unnest(nodes) AS n FROM dl))),
re AS (SELECT source_id, id, type, a, b, row_number() OVER (PARTITION BY source_id ORDER BY id, type, a, b) - 1 AS pos FROM (SELECT DISTINCT source_id, r.id AS id, r.type AS type, r.start_id AS a, r.end_id AS b FROM (SELECT source_id, unnest(rels) AS r FROM dl)))"""
_ANSWER = "entities array<struct<id:string,label:string,properties:map<string,string>>>, relationships array<struct<from_id:string,rel_type:string,to_id:string>>"


@query(f"""WITH {_DELIVERIES} SELECT dl.source_id, 'Graph ' || dl.graph_id AS question, 'system,user,assistant' AS roles, en.pos::INT AS pos, en.id::VARCHAR AS id, en.label FROM dl JOIN en ON en.source_id = dl.source_id""")
def chat_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows, with the assistant's JSON read back entity by entity."""
    rows = training.chat_rows(*_records(spark, sf))
    answer = F.from_json(F.col("messages")[2]["content"], _ANSWER)
    return rows.select("source_id", F.col("messages")[1]["content"].alias("question"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.posexplode(answer["entities"]).alias("pos", "e")).select("source_id", "question", "roles", "pos", "e.id", "e.label")


@query(f"WITH {_DELIVERIES} SELECT source_id, pos::INT AS pos, a::VARCHAR AS from_id, type AS rel_type, b::VARCHAR AS to_id FROM re")
def chat_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows, with the assistant's JSON read back relationship by relationship."""
    answer = F.from_json(F.col("messages")[2]["content"], _ANSWER)
    return training.chat_rows(*_records(spark, sf)).select("source_id", F.posexplode(answer["relationships"]).alias("pos", "r")).select("source_id", "pos", "r.*")


_KEPT = f"{_DELIVERIES}, kp AS (SELECT source_id, id, label, pos, k FROM en WHERE pos < greatest(1, k * 3 // 5))"


@query(f"""WITH {_KEPT} SELECT source_id, 'incomplete' AS variant, pos::INT AS pos, id::VARCHAR AS id, label FROM kp
UNION ALL SELECT source_id, 'hallucinated', pos::INT, id::VARCHAR, CASE WHEN pos = 0 THEN 'Observation' ELSE label END FROM en UNION ALL SELECT dl.source_id, 'hallucinated', coalesce(c.k, 0)::INT, 'made_up', 'Person' FROM dl LEFT JOIN (SELECT source_id, any_value(k) AS k FROM en GROUP BY source_id) c USING (source_id)""")
def rejected_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Preference pairs, with the rejected answer read back entity by entity."""
    pairs = training.preference_pairs(*_records(spark, sf))
    return pairs.select("source_id", "variant", F.posexplode(F.from_json("rejected", _ANSWER)["entities"]).alias("pos", "e")).select("source_id", "variant", "pos", "e.id", "e.label")


@query(f"""WITH {_KEPT} SELECT r.source_id, 'incomplete' AS variant, r.a::VARCHAR AS from_id, r.type AS rel_type, r.b::VARCHAR AS to_id FROM re r WHERE EXISTS (SELECT 1 FROM kp WHERE kp.source_id = r.source_id AND kp.id = r.a) AND EXISTS (SELECT 1 FROM kp WHERE kp.source_id = r.source_id AND kp.id = r.b)
UNION ALL SELECT source_id, 'hallucinated', a::VARCHAR, type, b::VARCHAR FROM re UNION ALL SELECT dl.source_id, 'hallucinated', 'made_up', 'CAUSED_BY', coalesce(f.id, 'made_up') FROM dl LEFT JOIN (SELECT source_id, id::VARCHAR AS id FROM en WHERE pos = 0) f USING (source_id)""")
def rejected_relationships(spark: SparkSession, sf: str) -> DataFrame:
    """Preference pairs, with the rejected answer read back relationship by relationship."""
    pairs = training.preference_pairs(*_records(spark, sf))
    return pairs.select("source_id", "variant", F.explode(F.from_json("rejected", _ANSWER)["relationships"]).alias("r")).select("source_id", "variant", "r.*")


@query(f"""WITH {_KEPT} SELECT d.source_id, coalesce(e.n, 0) AS entities, coalesce(r.n, 0) AS relationships FROM dl d LEFT JOIN (SELECT source_id, count(*)::INT AS n FROM kp GROUP BY source_id) e USING (source_id)
LEFT JOIN (SELECT x.source_id, count(*)::INT AS n FROM re x WHERE EXISTS (SELECT 1 FROM kp WHERE kp.source_id = x.source_id AND kp.id = x.a) AND EXISTS (SELECT 1 FROM kp WHERE kp.source_id = x.source_id AND kp.id = x.b) GROUP BY x.source_id) r USING (source_id)""")
def incomplete_negatives(spark: SparkSession, sf: str) -> DataFrame:
    _, gold = _records(spark, sf)
    return gold.select("source_id", training.incomplete(F.col("entities"), F.col("relationships")).alias("x")).select("source_id", F.size("x.entities").alias("entities"), F.size("x.relationships").alias("relationships"))


_MERGE_KEYS = "CASE label " + " ".join(f"WHEN '{n.label}' THEN props['{n.merge_key}']" for n in SCHEMA_ORG.nodes.values()) + " END"
_INGESTED = f"""{_DELIVERIES}, sn AS (SELECT source_id, n.id AS id, list_min(n.labels) AS label, n.props AS props FROM (SELECT source_id, unnest(nodes) AS n FROM dl)),
kn AS (SELECT DISTINCT source_id, id, label, coalesce({_MERGE_KEYS}, {_TRUTHY}) AS k FROM sn WHERE label IN {tuple(SCHEMA_ORG.nodes)!r}), nk AS (SELECT * FROM kn WHERE k IS NOT NULL),
rl AS (SELECT DISTINCT a.label AS la, a.k AS ka, r.type, b.label AS lb, b.k AS kb FROM re r JOIN nk a ON a.source_id = r.source_id AND a.id = r.a JOIN nk b ON b.source_id = r.source_id AND b.id = r.b WHERE r.type IN {tuple(SCHEMA_ORG.rels)!r})"""


def _ingested(spark: SparkSession, sf: str) -> tuple[Graph, DataFrame]:
    """All records through ingest into an empty graph; the extractor answers with each record's JSON, at the first try for every other one only."""
    statements, gold = _records(spark, sf)
    answers = gold.select("source_id", F.to_json(F.struct("entities", "relationships")).alias("answer"))
    asked = []

    def extractor(rows: DataFrame) -> DataFrame:
        asked.append(1)
        told = rows.select("source_id").join(answers, "source_id")
        unreadable = F.when(F.crc32("source_id") % 2 == 0, F.lit("I am not sure.")).otherwise(F.col("answer"))
        return told.withColumn("answer", unreadable) if len(asked) == 1 else told

    empty = Graph(spark.createDataFrame([], "id bigint, labels array<string>, label string, props map<string,string>, source string, source_type string, confidence double, confidence_raw string, extracted_at string, ontology_id string"), spark.createDataFrame([], "id bigint, src bigint, dst bigint, type string, props map<string,string>"))
    given = statements.select("source_id", F.lit("police_report").alias("source_type"), "text", F.abs(F.xxhash64("source_id") % 1_000_000).alias("seq"), F.lit("nobody").alias("witness"))
    records = ingest.extract(given, extractor).where("x is not null").join(given.select("source_id", "seq"), "source_id")
    graph, _, _ = ingest.load(empty, materialize(records, "read"), SCHEMA_ORG, "2025-01-01T00:00:00Z")
    return graph, given


@query(f"WITH {_INGESTED} SELECT DISTINCT label, k AS merge_key FROM nk")
def ingested_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that ingest makes of all records, by label and what they are merged by."""
    keys = F.create_map(*[F.lit(v) for n in SCHEMA_ORG.nodes.values() for v in (n.label, n.merge_key)])
    from graphloom.model import desc_truthy

    return _ingested(spark, sf)[0].nodes.select("label", F.coalesce(F.try_element_at("props", F.try_element_at(keys, F.col("label"))), desc_truthy()).alias("merge_key"))


@query(f"WITH {_INGESTED} SELECT type, count(*) AS n FROM rl GROUP BY type")
def ingested_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf)[0].edges.groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT 'Graph ' || graph_id AS name, count(DISTINCT snapshot_id) AS snapshots FROM graph_snapshots WHERE graph_id IS NOT NULL AND snapshot_id IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY graph_id""")
def loaded_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Graphs and their snapshots loaded by exact name, counted over the relationships between them."""
    s = table(spark, sf, "graph_snapshots").where("graph_id is not null and snapshot_id is not null and timestamp is not null").select("graph_id", "snapshot_id").distinct()
    names = s.select(F.concat(F.lit("Graph "), "graph_id").alias("name"), F.concat_ws(" ", "graph_id", F.col("snapshot_id").cast("string")).alias("snapshot"))
    ents = names.select("name", F.lit("Graph").alias("type"), F.lit(None).cast("string").alias("description")).unionByName(names.select(F.col("snapshot").alias("name"), F.lit("Snapshot").alias("type"), F.lit(None).cast("string").alias("description"))).distinct()
    empty = Graph(spark.createDataFrame([], "id bigint, labels array<string>, label string, props map<string,string>"), spark.createDataFrame([], "id bigint, src bigint, dst bigint, type string, props map<string,string>"))
    g = ingest.load_by_name(empty, ents, names.select(F.col("snapshot").alias("source"), F.col("name").alias("target"), F.lit("taken of").alias("type")))
    name = g.nodes.select(F.col("id").alias("dst"), F.col("props")["name"].alias("name"))
    return g.edges.where("type = 'TAKEN_OF'").join(name, "dst").groupBy("name").agg(F.count("*").alias("snapshots"))


@query(f"""WITH {INCIDENTS}, {_TOLD}, t AS (SELECT DISTINCT a.d AS head, e.type AS relation, b.d AS tail FROM e JOIN (SELECT id, coalesce({_FULL}, 'unknown') AS d FROM n WHERE NOT list_contains(labels, 'GraphVersion')) a ON a.id = e.src JOIN (SELECT id, coalesce({_FULL}, 'unknown') AS d FROM n WHERE NOT list_contains(labels, 'GraphVersion')) b ON b.id = e.dst)
SELECT relation, count(*) AS n FROM t WHERE relation <> 'POSSIBLY_SAME_AS' GROUP BY relation""")
def triple_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Triples parted for training: every distinct one is in one part."""
    parts = training.triple_split(files.tsv_triples(incidents(spark, sf)))
    return parts.groupBy("relation").agg(F.count_if(F.col("part").isin("train", "valid", "test")).alias("n"))
