"""Queries of scans, patterns, paths, aggregates and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.store import table
from graphloom.functions.text import source_type
from graphloom.model import Graph, desc_full, desc_probe, has_label
from graphloom.operators import match as M
from graphloom.operators import write as W
from graphloom.plans.graphs import INCIDENTS, RING, TREE, incidents, ring, trade, tree

Q, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL that states the same."""
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query(f"WITH {INCIDENTS} SELECT l AS label, count(*) AS n FROM (SELECT unnest(list_distinct(labels)) AS l FROM n) GROUP BY l")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).nodes.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {INCIDENTS} SELECT source_type, count(*) AS n FROM n WHERE list_has_any(labels, ['Location', 'Place', 'SpatialRegion']) GROUP BY source_type")
def label_union_scan(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).labelled("Location", "Place", "SpatialRegion").groupBy("source_type").agg(F.count("*").alias("n"))


@query(f"WITH {INCIDENTS} SELECT label, count(*) AS n FROM n WHERE NOT list_has_any(labels, ['Observation', 'GraphVersion']) GROUP BY label")
def label_negation(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).nodes.where(~has_label("Observation", "GraphVersion")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {INCIDENTS} SELECT type, count(*) AS n FROM e GROUP BY type")
def edge_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).edges.groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT source, CASE WHEN lower(source) LIKE '%cctv%' OR lower(source) LIKE '%camera%' THEN 'cctv' WHEN lower(source) LIKE '%forensic%' OR lower(source) LIKE '%report%' THEN 'forensic_report'
WHEN lower(source) LIKE '%paramedic%' OR lower(source) LIKE '%medical%' THEN 'medical_report' WHEN lower(source) LIKE '%police%' OR lower(source) LIKE '%officer%' THEN 'police_report' ELSE 'statement' END AS kind, count(*) AS n
FROM (SELECT source || '_' || coalesce(source_type, '') AS source FROM documents WHERE source IS NOT NULL) GROUP BY 1, 2""")
def source_type_inference(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("source is not null").select(F.concat("source", F.lit("_"), F.coalesce("source_type", F.lit(""))).alias("source"))
    return d.groupBy("source", source_type(F.col("source")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {INCIDENTS} SELECT id, props['colour'] AS colour FROM n WHERE list_contains(labels, 'Vehicle')")
def nodes_ordered_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).labelled("Vehicle").select("id", F.col("props")["colour"].alias("colour")).orderBy(F.asc_nulls_last("colour"), "id")


@query("SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def one_hop_lookup(spark: SparkSession, sf: str) -> DataFrame:
    g = trade(spark, sf)
    found = M.hop(g, g.labelled("Customer").where(F.col("props")["segment"] == "BUILDING"), ("LOCATED_IN",), end=g.labelled("Nation"))
    name = lambda k, a: g.nodes.select(F.col("id").alias(k), F.col("props")["name"].alias(a))
    return found.join(name("start_id", "name"), "start_id").join(name("end_id", "nation"), "end_id").select("name", "nation")


@query("SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def two_hop_chain(spark: SparkSession, sf: str) -> DataFrame:
    g = trade(spark, sf)
    p = M.paths(g, g.labelled("Customer"), 2, 2)
    name = lambda k, a: g.nodes.select(F.col("id").alias(k), F.col("props")["name"].alias(a))
    return p.join(g.labelled("Region").select(F.col("id").alias("end_id")), "end_id", "left_semi").join(name("start_id", "name"), "start_id").join(name("end_id", "region"), "end_id").select("name", "region")


@query(f"""WITH {INCIDENTS}, h AS (SELECT e.src, e.dst FROM e JOIN n t ON t.id = e.dst AND list_contains(t.labels, 'Time') WHERE e.type = 'OCCURRED_AT_TIME')
SELECT v.id AS start_id, h.dst AS end_id FROM n v LEFT JOIN h ON h.src = v.id WHERE list_contains(v.labels, 'Event')""")
def optional_hop(spark: SparkSession, sf: str) -> DataFrame:
    g = incidents(spark, sf)
    return M.optional_hop(g, g.labelled("Event"), ("OCCURRED_AT_TIME",), end=g.labelled("Time")).select("start_id", "end_id")


@query(f"WITH {INCIDENTS} SELECT id FROM n WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")
def isolated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return M.isolated(incidents(spark, sf)).select("id")


@query(f"""WITH {INCIDENTS} SELECT v.id FROM n v WHERE list_contains(v.labels, 'Event') AND NOT EXISTS (
SELECT 1 FROM e JOIN n t ON t.id = e.dst WHERE e.src = v.id AND e.type = 'OCCURRED_AT' AND list_contains(t.labels, 'Location'))""")
def missing_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    g = incidents(spark, sf)
    return M.without_hop(g, g.labelled("Event"), ("OCCURRED_AT",), end=g.labelled("Location")).select("id")


@query(f"WITH {INCIDENTS} SELECT v.id FROM n v WHERE list_contains(v.labels, 'Person') AND EXISTS (SELECT 1 FROM e WHERE e.src = v.id AND e.type = 'DROVE')")
def exists_semi(spark: SparkSession, sf: str) -> DataFrame:
    g = incidents(spark, sf)
    return M.with_hop(g, g.labelled("Person"), ("DROVE",)).select("id")


@query(f"""WITH {INCIDENTS} SELECT v.id FROM n v WHERE list_contains(v.labels, 'Event') AND v.id NOT IN (SELECT src FROM e WHERE type = 'DERIVED_FROM') AND v.id NOT IN (SELECT dst FROM e WHERE type = 'WITNESSED')""")
def two_way_missing(spark: SparkSession, sf: str) -> DataFrame:
    g = incidents(spark, sf)
    return M.condition_hops(g, g.labelled("Event"), [(("DERIVED_FROM",), "out", None), (("WITNESSED",), "in", None)]).select("id")


@query("SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def implicit_group_count(spark: SparkSession, sf: str) -> DataFrame:
    """How many customers each nation has: (c:Customer)-[:LOCATED_IN]->(n:Nation)."""
    g = trade(spark, sf)
    found = M.hop(g, g.labelled("Customer"), ("LOCATED_IN",), end=g.labelled("Nation"))
    return found.join(g.labelled("Nation").select(F.col("id").alias("end_id"), F.col("props")["name"].alias("nation")), "end_id").groupBy("nation").agg(F.count("*").alias("n")).orderBy(F.desc_nulls_first("n"), "nation")


@query(f"WITH {INCIDENTS}, s AS (SELECT n.source, n.id, e.id AS rel FROM n JOIN e ON e.src = n.id UNION ALL SELECT n.source, n.id, e.id FROM n JOIN e ON e.dst = n.id UNION ALL SELECT source, id, NULL FROM n) SELECT source, count(DISTINCT id) AS nodes, count(DISTINCT rel) AS rels FROM s GROUP BY source")
def distinct_endpoint_count(spark: SparkSession, sf: str) -> DataFrame:
    return _endpoint_counts(incidents(spark, sf))


def _endpoint_counts(g: Graph) -> DataFrame:
    steps = M.oriented(g.edges, "both").select(F.col("u").alias("id"), "edge_id")
    return g.nodes.select("id", "source").join(steps, "id", "left").groupBy("source").agg(F.count_distinct("id").alias("nodes"), F.count_distinct("edge_id").alias("rels"))


@query(f"WITH {INCIDENTS} SELECT e.src AS id, array_to_string(list_sort(list(DISTINCT e.type)), ',') AS types FROM e GROUP BY e.src")
def collect_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).edges.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


@query(f"WITH {INCIDENTS} SELECT source, source_type, count(*) AS n FROM n WHERE NOT list_contains(labels, 'GraphVersion') GROUP BY source, source_type")
def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).nodes.where(~has_label("GraphVersion")).groupBy("source", "source_type").agg(F.count("*").alias("n"))


@query(f"""WITH {INCIDENTS}, k AS (SELECT id, labels, coalesce(props['description'], props['name_or_description'], props['value']) AS key FROM n), c AS (SELECT labels, key, min(id) AS first_id FROM k WHERE key IS NOT NULL GROUP BY labels, key HAVING count(*) > 1)
SELECT k.id, c.first_id, k.key FROM k JOIN c ON c.labels = k.labels AND c.key = k.key""")
def duplicate_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that equal others, each with the first of its class."""
    return M.equal_classes(incidents(spark, sf).nodes, desc_probe())


@query('SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE "text" IS NOT NULL GROUP BY "text" HAVING count(*) > 1')
def duplicate_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


@query(f"WITH {INCIDENTS}, h AS (SELECT src, dst FROM e WHERE type = 'OCCURRED_AT_TIME') SELECT a.src AS id, a.dst AS time_a, b.dst AS time_b FROM h a JOIN h b ON a.src = b.src AND a.dst <> b.dst JOIN n x ON x.id = a.dst AND list_contains(x.labels, 'Time') JOIN n y ON y.id = b.dst AND list_contains(y.labels, 'Time')")
def conflicting_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from graphloom.operators.temporal import two_times

    return two_times(incidents(spark, sf))


_BOTH = "s AS (SELECT id, src AS u, dst AS v FROM e UNION SELECT id, dst, src FROM e)"


@query(f"""WITH {INCIDENTS}, {_BOTH}, v AS (SELECT id FROM n WHERE list_contains(labels, 'Vehicle'))
SELECT s.u AS start_id, s.v AS end_id, 1 AS length FROM s JOIN v ON v.id = s.u
UNION ALL SELECT a.u, b.v, 2 FROM s a JOIN v ON v.id = a.u JOIN s b ON b.u = a.v AND b.id <> a.id""")
def undirected_1_2_hops(spark: SparkSession, sf: str) -> DataFrame:
    g = incidents(spark, sf)
    return M.paths(g, g.labelled("Vehicle"), 1, 2, direction="both").select("start_id", "end_id", "length")


@query(f"WITH {TREE} SELECT a.src AS start_id, b.dst AS end_id, 2 AS length FROM t a JOIN t b ON a.dst = b.src UNION ALL SELECT a.src, c.dst, 3 FROM t a JOIN t b ON a.dst = b.src JOIN t c ON b.dst = c.src")
def bounded_2_3(spark: SparkSession, sf: str) -> DataFrame:
    g = tree(spark, sf)
    return M.paths(g, g.nodes, 2, 3, ("MANAGES",)).select("start_id", "end_id", "length")


@query(f"""WITH RECURSIVE {TREE}, p AS (SELECT src, dst, [src, dst] AS path FROM t UNION ALL SELECT p.src, t.dst, list_append(p.path, t.dst) FROM p JOIN t ON t.src = p.dst)
SELECT src AS start_id, dst AS end_id, array_to_string(path, '>') AS path FROM p""")
def unbounded_path(spark: SparkSession, sf: str) -> DataFrame:
    g = tree(spark, sf)
    return M.all_paths(g, g.nodes, ("MANAGES",)).select("start_id", "end_id", F.array_join("node_ids", ">").alias("path"))


@query(f"""WITH RECURSIVE {RING}, p AS (SELECT src, dst, [id] AS es, 1 AS length FROM r UNION ALL SELECT p.src, r.dst, list_append(p.es, r.id), p.length + 1 FROM p JOIN r ON r.src = p.dst AND NOT list_contains(p.es, r.id) WHERE p.length < 5)
SELECT src AS start_id, length, array_to_string(es, '>') AS edges FROM p WHERE src = dst AND length >= 2""")
def cycles_2_5(spark: SparkSession, sf: str) -> DataFrame:
    g = ring(spark, sf)
    return M.paths(g, g.nodes, 2, 5, ("PRECEDES",)).where("start_id = end_id").select("start_id", "length", F.array_join("edge_ids", ">").alias("edges"))


@query(f"""WITH RECURSIVE {RING}, {TREE}, a AS (SELECT src, dst FROM r WHERE src <> dst UNION SELECT a.src, r.dst FROM a JOIN r ON r.src = a.dst WHERE r.src <> r.dst), b AS (SELECT src, dst FROM t UNION SELECT b.src, t.dst FROM b JOIN t ON t.src = b.dst)
SELECT EXISTS (SELECT 1 FROM a WHERE src = dst) AS cyclic UNION ALL SELECT EXISTS (SELECT 1 FROM b WHERE src = dst)""")
def cycle_exists(spark: SparkSession, sf: str) -> DataFrame:
    found = [(not M.on_cycles(ring(spark, sf), ("PRECEDES",)).isEmpty(),), (not M.on_cycles(tree(spark, sf), ("MANAGES",)).isEmpty(),)]
    return spark.createDataFrame(found, "cyclic boolean")


@query(f"""WITH RECURSIVE {INCIDENTS}, {_BOTH}, reach AS (SELECT id AS v, id AS w FROM n UNION SELECT reach.v, s.v FROM reach JOIN s ON s.u = reach.w)
SELECT v AS id, min(w) AS component FROM reach GROUP BY v""")
def wcc_components(spark: SparkSession, sf: str) -> DataFrame:
    return M.components(incidents(spark, sf))


@query(f"WITH {INCIDENTS}, {_BOTH} SELECT u AS id, count(*) AS degree FROM s GROUP BY u HAVING count(*) > 5")
def hub_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return M.degree(incidents(spark, sf)).where("degree > 5")


def _vehicle_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Upserts for vehicles by description: colour from every row, a mark for each description, in order of id."""
    g = incidents(spark, sf)
    return g.labelled("Vehicle").where("label = 'Vehicle' and props['description'] is not null").select(
        "label", F.upper(F.col("props")["description"]).alias("merge_key"), F.map_from_arrays(F.array(F.lit("description"), F.lit("colour")), F.array(F.upper(F.col("props")["description"]), F.nullif(F.col("props")["colour"], F.lit("")))).alias("props"), F.col("id").alias("seq"))


@query(f"""WITH {INCIDENTS}, r AS (SELECT upper(props['description']) AS k, nullif(props['colour'], '') AS c, id FROM n WHERE label = 'Vehicle' AND props['description'] IS NOT NULL),
i AS (SELECT k, arg_max(c, id) FILTER (c IS NOT NULL) AS c FROM r GROUP BY k),
kept AS (SELECT v.id, v.props['description'] AS d, coalesce(i.c, v.props['colour']) AS colour FROM n v LEFT JOIN i ON i.k = v.props['description'] WHERE v.label = 'Vehicle')
SELECT d AS description, colour, count(*) AS n FROM (SELECT d, colour FROM kept UNION ALL SELECT k, c FROM i WHERE k NOT IN (SELECT d FROM kept WHERE d IS NOT NULL)) GROUP BY 1, 2""")
def merge_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Upsert vehicles under upper-case descriptions: a few are there already, the rest are created."""
    merged, _ = W.merge_nodes(incidents(spark, sf), _vehicle_rows(spark, sf), F.col("props")["description"])
    v = merged.nodes.where("label = 'Vehicle'")
    return v.groupBy(F.col("props")["description"].alias("description"), F.col("props")["colour"].alias("colour")).agg(F.count("*").alias("n"))


@query(f"""WITH {INCIDENTS}, w AS (SELECT DISTINCT src, dst FROM e WHERE type = 'WITNESSED')
SELECT type, count(*) AS n FROM (SELECT type FROM e UNION ALL SELECT 'PARTICIPATED_IN' FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.type = 'PARTICIPATED_IN' AND e.src = w.src AND e.dst = w.dst)) GROUP BY type""")
def merge_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every witness takes part as well, unless that is known."""
    g = incidents(spark, sf)
    rows = g.typed("WITNESSED").select("src", F.lit("PARTICIPATED_IN").alias("type"), "dst", F.create_map().cast("map<string,string>").alias("props"), F.col("id").alias("seq"))
    merged, _ = W.merge_edges(g, rows)
    return merged.edges.groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {INCIDENTS} SELECT id, CASE WHEN props['type'] = 'road' THEN 'street' ELSE props['type'] END AS type FROM n WHERE label = 'Location'")
def set_props(spark: SparkSession, sf: str) -> DataFrame:
    g = W.set_props(incidents(spark, sf), F.col("props")["type"] == "road", {"type": "street"})
    return g.nodes.where("label = 'Location'").select("id", F.col("props")["type"].alias("type"))


@query(f"""WITH {INCIDENTS}, gone AS (SELECT id FROM n WHERE label = 'Time')
SELECT type, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone) GROUP BY type
UNION ALL SELECT 'nodes', count(*) FROM n WHERE label <> 'Time'""")
def detach_delete(spark: SparkSession, sf: str) -> DataFrame:
    g = W.detach_delete(incidents(spark, sf), F.col("label") == "Time")
    return g.edges.groupBy("type").agg(F.count("*").alias("n")).unionByName(g.nodes.agg(F.lit("nodes").alias("type"), F.count("*").alias("n")).select("type", "n"))


@query(f"WITH {INCIDENTS} SELECT props['description'] AS merge_key, count(*) AS n FROM n WHERE list_contains(labels, 'Location') AND props['description'] IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return W.duplicate_keys(incidents(spark, sf).nodes, "Location", F.col("props")["description"])


@query(f"WITH {INCIDENTS}, d AS (SELECT id, coalesce(props['description'], props['name_or_description'], props['name'], props['value'], props['summary']) AS d FROM n) SELECT id FROM d WHERE lower(d) LIKE '%norwick%'")
def contains_ignoring_case(spark: SparkSession, sf: str) -> DataFrame:
    return incidents(spark, sf).nodes.where(F.lower(desc_full()).contains("norwick")).select("id")
