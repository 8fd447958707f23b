"""Reading statements and records, and writing graphs in public formats.

Writers make one text line or block per node or relationship where it lies and write them in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.store import small_enough
from graphloom.functions.text import source_type
from graphloom.model import Graph, desc_full, desc_truthy, has_label

# RDF classes, predicates and colours of the exports.
CLASSES = {"Event": "schema:Event", "Person": "schema:Person", "Vehicle": "evt:Vehicle", "Location": "schema:Place", "Place": "schema:Place", "Time": "schema:DateTime", "Object": "evt:PhysicalObject", "Observation": "sosa:Observation", "PhysicalDescription": "evt:PhysicalDescription", "Role": "evt:Role"}
PREDICATES = {
    "AT_TIME": "schema:startDate", "OCCURRED_AT_TIME": "schema:startDate", "HAS_TIME": "schema:startDate", "AT_LOCATION": "schema:location", "OCCURRED_AT": "schema:location", "HAS_PARTICIPANT": "schema:participant", "INVOLVED_IN": "evt:involvedIn",
    "PRECEDED_BY": "evt:precededBy", "OBSERVED": "sosa:observedProperty", "MADE_BY": "sosa:madeBySensor", "DERIVED_FROM": "prov:wasDerivedFrom", "POSSIBLY_SAME_AS": "evt:possiblySameAs", "CORROBORATED_BY": "evt:corroboratedBy", "CONTRADICTS": "evt:contradicts"}
COLOURS = {"Event": "#e74c3c", "Person": "#3498db", "Vehicle": "#f39c12", "Location": "#2ecc71", "Place": "#2ecc71", "Time": "#9b59b6", "Object": "#95a5a6", "Observation": "#1abc9c", "PhysicalDescription": "#e67e22", "Role": "#34495e"}
EDGE_STYLES = {"CONTRADICTS": ', color="red", style="dashed"', "POSSIBLY_SAME_AS": ', color="blue", style="dotted"', "CORROBORATED_BY": ', color="green"', "PRECEDED_BY": ', color="purple"'}
PREFIXES = ("@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", "@prefix prov: <http://www.w3.org/ns/prov#> .", "@prefix schema: <http://schema.org/> .", "@prefix sosa: <http://www.w3.org/ns/sosa/> .", "@prefix evt: <urn:event-twin:vocab:> .", "@prefix node: <urn:event-twin:node:> .")


def _pick(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), default)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, source_type, text) of text files; the file's name without ending is the source."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source_id"), F.trim("value").alias("text"))
    return rows.select("source_id", source_type(F.col("source_id")).alias("source_type"), "text")


def without_versions(graph: Graph) -> Graph:
    """Without GraphVersion nodes and what hangs on them."""
    nodes = graph.nodes.where(~has_label("GraphVersion"))
    gone = graph.labelled("GraphVersion").select("id")
    edges = graph.edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(nodes, edges.select(*graph.edges.columns))


def turtle_text(value: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def rdf_triples(graph: Graph, ontology_id: str | None = None) -> DataFrame:
    """(s, p, o, is_iri): all properties as literals, labels as types, relationships as links; ``ontology_id`` keeps the nodes of one ontology, all relationships stay."""
    if ontology_id is not None:
        graph = Graph(graph.nodes.where(F.col("ontology_id") == ontology_id), graph.edges)
    iri = lambda c: F.concat(F.lit("node:"), c.cast("string"))
    types = graph.nodes.select(iri(F.col("id")).alias("s"), F.lit("rdf:type").alias("p"), F.explode("labels").alias("o"), F.lit(True).alias("is_iri"))
    props = graph.nodes.select(iri(F.col("id")).alias("s"), F.explode("props").alias("p", "o")).where("o is not null").select("s", "p", "o", F.lit(False).alias("is_iri"))
    links = graph.edges.select(iri(F.col("src")).alias("s"), F.col("type").alias("p"), iri(F.col("dst")).alias("o"), F.lit(True).alias("is_iri"))
    return types.unionByName(props).unionByName(links)


def turtle_lines(graph: Graph) -> DataFrame:
    """(kind, id, line): a block per node with properties in order of name, and a line per relationship."""
    def literal(k: Column, v: Column) -> Column:
        quoted = F.concat(F.lit('"'), turtle_text(v), F.lit('"'))
        return (F.when(k == "confidence", F.concat(F.lit("    evt:confidence "), quoted, F.lit("^^xsd:float"))).when(k == "extracted_at", F.concat(F.lit("    prov:generatedAtTime "), quoted, F.lit("^^xsd:dateTime")))
                .when(k == "source", F.concat(F.lit("    prov:wasAttributedTo "), quoted)).when(k.isin("description", "name_or_description", "name"), F.concat(F.lit("    rdfs:label "), quoted)).otherwise(F.concat(F.lit("    evt:"), k, F.lit(" "), quoted)))

    label = F.coalesce(F.get("labels", F.lit(0)), F.lit("Thing"))
    entries = F.array_sort(F.map_entries(F.map_filter("props", lambda k, v: v.isNotNull())))
    lines = F.concat(F.array(F.concat(F.lit("    a "), _pick(CLASSES, label, F.concat(F.lit("evt:"), label)))), F.transform(entries, lambda e: literal(e["key"], e["value"])))
    nodes = graph.nodes.select(F.lit("node").alias("kind"), "id", F.concat(F.lit("node:"), F.col("id").cast("string"), F.lit("\n"), F.array_join(lines, " ;\n"), F.lit(" .")).alias("line"))
    rels = graph.edges.select(F.lit("relationship").alias("kind"), "id", F.concat(F.lit("node:"), F.col("src").cast("string"), F.lit(" "), _pick(PREDICATES, F.col("type"), F.concat(F.lit("evt:"), F.col("type"))), F.lit(" node:"), F.col("dst").cast("string"), F.lit(" .")).alias("line"))
    return nodes.unionByName(rels)


def jsonld_nodes(graph: Graph) -> DataFrame:
    """(id, json): a node with its properties, and for each relationship type a reference or a list of them."""
    links = graph.edges.groupBy(F.col("src").alias("id"), F.lower("type").alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("urn:event-twin:node:"), F.col("dst").cast("string")).alias("@id")))).alias("refs"))
    one = links.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.when(F.size("refs") == 1, F.to_json(F.get("refs", F.lit(0)))).otherwise(F.to_json("refs")).alias("v"))))).alias("links"))
    rows = graph.nodes.join(one, "id", "left")
    pair = lambda k, v: F.concat(F.to_json(F.array(k)), F.lit(":"), v)
    strip = lambda c: F.regexp_replace(c, r"^\[|\](?=:)", "")
    props = F.transform(F.array_sort(F.map_entries(F.map_filter("props", lambda k, v: v.isNotNull()))), lambda e: strip(pair(e["key"], F.regexp_replace(F.to_json(F.array(e["value"])), r"^\[|\]$", ""))))
    refs = F.coalesce(F.transform(F.map_entries("links"), lambda e: strip(pair(e["key"], e["value"]))), F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit('"@id":"urn:event-twin:node:'), F.col("id").cast("string"), F.lit('"')), F.concat(F.lit('"@type":'), F.to_json("labels")))
    return rows.select("id", F.concat(F.lit("{"), F.array_join(F.concat(head, props, refs), ","), F.lit("}")).alias("json"))


def dot_lines(graph: Graph) -> DataFrame:
    """(kind, id, line) of a Graphviz file, without its frame."""
    desc = F.coalesce(desc_truthy(), F.concat(F.lit("node_"), F.col("id").cast("string")))
    short = F.replace(F.when(F.length(desc) > 40, F.concat(F.substring(desc, 1, 37), F.lit("..."))).otherwise(desc), F.lit('"'), F.lit('\\"'))
    label = F.coalesce(F.get("labels", F.lit(0)), F.lit("Node"))
    source, conf = F.coalesce("source", F.lit("")), F.coalesce("confidence_raw", F.lit(""))
    text = F.concat(label, F.lit("\\n"), short, F.when(source != "", F.concat(F.lit("\\n["), source, F.lit("]"))).otherwise(F.lit("")), F.when(conf != "", F.concat(F.lit(" ("), conf, F.lit(")"))).otherwise(F.lit("")))
    nodes = graph.nodes.select(F.lit("node").alias("kind"), "id", F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(' [label="'), text, F.lit('", fillcolor="'), _pick(COLOURS, label, F.lit("#bdc3c7")), F.lit('", fontcolor="white"];')).alias("line"))
    rels = graph.edges.select(F.lit("relationship").alias("kind"), "id", F.concat(F.lit("n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), F.lit(' [label="'), F.col("type"), F.lit('"'), _pick(EDGE_STYLES, F.col("type"), F.lit("")), F.lit("];")).alias("line"))
    return nodes.unionByName(rels)


def cypher_lines(graph: Graph) -> DataFrame:
    """(kind, id, line): statements that would create the graph again; both ends found by two joins."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    entries = F.array_sort(F.map_entries(F.map_filter("props", lambda k, v: v.isNotNull())))
    props = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"]))), ", ")
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))
    nodes = graph.nodes.select(F.lit("node").alias("kind"), "id", F.concat(F.lit("CREATE ("), name(F.col("id")), F.array_join(F.transform("labels", lambda x: F.concat(F.lit(":"), x)), ""), F.lit(" {"), props, F.lit("});")).alias("line"))
    ends = graph.nodes.select("id")
    kept = graph.edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.unionByName(kept.select(F.lit("relationship").alias("kind"), "id", F.concat(F.lit("CREATE ("), name(F.col("src")), F.lit(")-[:"), F.col("type"), F.lit("]->("), name(F.col("dst")), F.lit(");")).alias("line")))


def tsv_triples(graph: Graph) -> DataFrame:
    """(head, relation, tail) by description, versions aside."""
    g = without_versions(graph)
    side = lambda k, n: g.nodes.select(F.col("id").alias(k), desc_full(default="unknown").alias(n))
    return g.edges.join(side("src", "head"), "src").join(side("dst", "tail"), "dst").select("head", F.col("type").alias("relation"), "tail")


def vis_html(graph: Graph, title: str = "Graph") -> str:
    """A page that draws a graph small enough to look at: 20,000 nodes and relationships at most."""
    import json

    if not small_enough(graph.nodes, 20_000) or not small_enough(graph.edges, 20_000):
        raise ValueError("too large to draw")
    nodes = [{"id": r["id"], "label": f"{r['label']}\n{(r['d'] or '')[:30]}", "color": COLOURS.get(r["label"], "#bdc3c7")} for r in graph.nodes.select("id", F.get("labels", F.lit(0)).alias("label"), desc_truthy().alias("d")).toLocalIterator()]
    edges = [{"from": r["src"], "to": r["dst"], "label": r["type"], "dashes": r["type"] in ("CONTRADICTS", "POSSIBLY_SAME_AS")} for r in graph.edges.select("src", "dst", "type").toLocalIterator()]
    return f"<html><head><title>{title}</title><script src='https://unpkg.com/vis-network/standalone/umd/vis-network.min.js'></script></head><body><div id='g' style='height:95vh'></div><script>new vis.Network(document.getElementById('g'),{{nodes:{json.dumps(nodes)},edges:{json.dumps(edges)}}},{{}})</script></body></html>"


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, sep="\t", quote="", escape="")


def write_by_source(rows: DataFrame, path: str, source: str = "source_id") -> None:
    """JSON records in a folder for each source."""
    rows.write.partitionBy(source).json(path)
