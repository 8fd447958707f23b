"""Extraction records into the graph: coreference, vocabulary, upserts and provenance. Extractors are functions the caller passes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.store import materialize
from graphloom.functions.text import plain_name, tolerant_json
from graphloom.model import Graph, desc_truthy
from graphloom.ontology import SAFE_PROPERTY, Ontology
from graphloom.operators.write import first_by, latest_props, merge_edges, merge_nodes

EXTRACTION = "entities array<struct<id:string,label:string,properties:map<string,string>>>, relationships array<struct<from_id:string,rel_type:string,to_id:string>>"
LEAST_KEPT = 0.4


def extract(statements: DataFrame, extractor: Callable[[DataFrame], DataFrame], tries: int = 2) -> DataFrame:
    """(source_id, source_type, x): the extractor's answers (source_id, answer) parsed. What cannot be read is asked again, ``tries`` times in all; then it is empty."""
    read = lambda rows: rows.select("source_id", tolerant_json(F.col("answer"), EXTRACTION).alias("x")).where("x is not null")
    good = materialize(read(extractor(statements)), "answers")
    for _ in range(tries - 1):
        again = statements.join(good.select("source_id"), "source_id", "left_anti")
        if again.isEmpty():
            break
        good = good.unionByName(materialize(read(extractor(again)), "answers"))
    return statements.select("source_id", "source_type").join(good, "source_id", "left")


def remap(records: DataFrame, id_map: DataFrame) -> DataFrame:
    """Coreference: ids replaced by (source_id, id, canonical), the first entity of an id kept. A source that would lose more than six tenths of its entities stays as it was."""
    n = records.select("source_id", F.size("x.entities").alias("n"))
    maps = id_map.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "canonical"))).alias("m"))
    rows = records.join(maps, "source_id", "left").join(n, "source_id")
    to = lambda i: F.coalesce(F.try_element_at("m", i), i)
    ids = F.transform("x.entities", lambda e: to(e["id"]))
    kept = F.filter("x.entities", lambda e, i: F.array_position(ids, to(e["id"])) == i + 1)
    changed = F.struct(
        F.transform(kept, lambda e: F.struct(to(e["id"]).alias("id"), e["label"].alias("label"), e["properties"].alias("properties"))).alias("entities"),
        F.transform("x.relationships", lambda r: F.struct(to(r["from_id"]).alias("from_id"), r["rel_type"].alias("rel_type"), to(r["to_id"]).alias("to_id"))).alias("relationships"))
    apply_ = F.col("m").isNotNull() & (F.col("n") > 1) & (F.size(F.array_distinct(ids)) >= LEAST_KEPT * F.col("n"))
    return rows.select(*[c for c in records.columns if c != "x"], F.when(apply_, changed).otherwise(F.col("x")).alias("x"))


def load(graph: Graph, records: DataFrame, ontology: Ontology, at: str, confidence: str = "0.8") -> tuple[Graph, DataFrame, DataFrame]:
    """The graph with all records upserted, the nodes and the created relationships. ``records``: source_id, source_type, x, and seq for the input order."""
    keys = F.create_map(*[F.lit(v) for n in ontology.nodes.values() for v in (n.label, n.merge_key)])
    ents = records.select("source_id", "source_type", "seq", F.posexplode("x.entities").alias("pos", "e")).select("source_id", "source_type", "seq", "pos", "e.*").where(F.col("label").isin(*ontology.nodes))
    props = F.map_filter("properties", lambda k, v: v.isNotNull() & k.rlike(SAFE_PROPERTY))
    given = F.create_map(F.lit("source"), F.col("source_id"), F.lit("source_type"), F.coalesce("source_type", F.lit("")), F.lit("extracted_at"), F.lit(at), F.lit("confidence"), F.lit(confidence), F.lit("ontology_id"), F.lit(ontology.spec_id))
    own = F.map_filter(props, lambda k, v: ~k.isin("source", "source_type", "extracted_at", "confidence", "ontology_id"))
    # the merge key, else the first property that describes the entity
    key = F.coalesce(F.try_element_at("props", F.try_element_at(keys, F.col("label"))), desc_truthy())
    rows = ents.withColumn("props", F.map_concat(own, given)).withColumn("merge_key", key).where("merge_key is not null").withColumn("order", F.col("seq") * 1_000_000 + F.col("pos"))
    merged, ids = merge_nodes(graph, rows.select("label", "merge_key", "props", F.col("order").alias("seq")), F.coalesce(F.try_element_at("props", F.try_element_at(keys, F.col("label"))), desc_truthy()))
    # of repeated ids in a record the last counts
    where = rows.groupBy("source_id", F.col("id").alias("eid")).agg(F.max_by(F.struct("label", "merge_key"), "order").alias("k")).select("source_id", "eid", "k.*").join(ids.select("label", "merge_key", F.col("id").alias("node")), ["label", "merge_key"]).select("source_id", "eid", "node")
    rels = records.select("source_id", "seq", F.posexplode("x.relationships").alias("pos", "r")).select("source_id", F.col("r.from_id").alias("f"), F.col("r.rel_type").alias("type"), F.col("r.to_id").alias("t"), (F.col("seq") * 1_000_000 + F.col("pos")).alias("seq")).where(F.col("type").isin(*ontology.rels))
    a, b = where.select("source_id", F.col("eid").alias("f"), F.col("node").alias("src")), where.select("source_id", F.col("eid").alias("t"), F.col("node").alias("dst"))
    edges = rels.join(a, ["source_id", "f"]).join(b, ["source_id", "t"]).select("src", "type", "dst", F.create_map().cast("map<string,string>").alias("props"), "seq")
    final, created = merge_edges(merged, edges)
    lifted = final.nodes
    for c in ("source", "source_type", "extracted_at", "ontology_id"):
        lifted = lifted.withColumn(c, F.coalesce(F.try_element_at("props", F.lit(c)), F.col(c)))
    lifted = lifted.withColumn("confidence_raw", F.coalesce(F.try_element_at("props", F.lit("confidence")), F.col("confidence_raw"))).withColumn("confidence", F.coalesce(F.try_element_at("props", F.lit("confidence")).try_cast("double"), F.col("confidence")))
    return Graph(lifted, final.edges), ids, created


def first_values(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """(key, props): entity resolution across documents, the first value of each property counts."""
    flat = rows.select(key, F.col(seq).alias("_seq"), F.explode("props").alias("k", "v")).where("v is not null")
    first = flat.groupBy(key, "k").agg(F.min_by("v", "_seq").alias("v"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))


def resolve_names(rows: DataFrame) -> DataFrame:
    """(key, name, props) over (name, props, seq): entities whose names are equal without title and case; the first spelling stays."""
    keyed = rows.withColumn("key", plain_name(F.col("name")))
    return first_values(keyed, "key").join(first_by(keyed.select("key", "name", "seq"), ["key"], ["seq"]).select("key", "name"), "key")


def relationship_name(name):
    return F.replace(F.upper(name), F.lit(" "), F.lit("_"))


def provenance_links(graph: Graph, observation_of: DataFrame) -> DataFrame:
    """(src, type, dst): MADE_BY, OBSERVED and DERIVED_FROM for Observations (obs, source_type, witness).

    MADE_BY goes to the named person, or to every witness where none is named; OBSERVED and DERIVED_FROM to all events for statements, else to events of the same kind of source or next to a node of it.
    What goes to all by definition is as many rows as that; no side of these joins is larger than the result. ``provenance_groups`` says the same in rows for each group.
    """
    groups, members = provenance_groups(graph, observation_of)
    ends = members.select("group", F.col("id").alias("dst"))
    made = groups.where("type = 'MADE_BY'").join(ends, "group").select(F.col("obs").alias("src"), "type", "dst")
    seen = groups.where("type = 'OBSERVED'").join(ends, "group").select("obs", "dst").distinct()
    return made.unionByName(seen.select(F.col("obs").alias("src"), F.lit("OBSERVED").alias("type"), "dst")).unionByName(seen.select(F.col("dst").alias("src"), F.lit("DERIVED_FROM").alias("type"), F.col("obs").alias("dst")))


def provenance_groups(graph: Graph, observation_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(obs, type, group) and (group, id): each Observation points at groups of nodes, such as all witnesses, all events or the events of a kind of source; nothing is multiplied out."""
    persons = graph.labelled("Person").select("id", F.col("props")["name_or_description"].alias("name"), F.col("props")["role"].alias("role"))
    events = graph.labelled("Event").select("id", "source_type")
    ends = F.array(F.struct(F.col("src").alias("e"), F.col("dst").alias("n")), F.struct(F.col("dst").alias("e"), F.col("src").alias("n")))
    beside = graph.edges.select(F.explode(ends).alias("s")).select("s.*").join(graph.nodes.select(F.col("id").alias("n"), "source_type"), "n").select(F.col("e").alias("id"), "source_type")
    near = events.unionByName(beside.join(events.select("id"), "id", "left_semi")).where("source_type is not null and source_type <> 'statement'").distinct()
    members = (persons.where("name is not null").select(F.concat(F.lit("person "), "name").alias("group"), "id").unionByName(persons.where("role = 'witness'").select(F.lit("witnesses").alias("group"), "id"))
               .unionByName(events.select(F.lit("events").alias("group"), "id")).unionByName(near.select(F.concat(F.lit("events of "), "source_type").alias("group"), "id")))
    made = F.struct(F.lit("MADE_BY").alias("type"), F.when(F.col("witness").isNull(), "witnesses").otherwise(F.concat(F.lit("person "), F.col("witness"))).alias("group"))
    seen = F.struct(F.lit("OBSERVED").alias("type"), F.when(F.col("source_type") == "statement", "events").otherwise(F.concat(F.lit("events of "), F.coalesce("source_type", F.lit("")))).alias("group"))
    return observation_of.select("obs", F.explode(F.array(made, seen)).alias("g")).select("obs", "g.*"), members


def observe(graph: Graph, statements: DataFrame, at: str, named: str = "Statement from ") -> tuple[Graph, DataFrame]:
    """An Observation for each statement (source_id, source_type, witness), upserted by its description, with its provenance links; gives the graph and (obs, source_id)."""
    rows = statements.select("source_id", "source_type", "witness").distinct().withColumn("merge_key", F.concat(F.lit(named), "source_id"))
    props = F.create_map(F.lit("description"), F.col("merge_key"), F.lit("observation_type"), F.coalesce("source_type", F.lit("statement")), F.lit("source"), F.col("source_id"), F.lit("extracted_at"), F.lit(at))
    merged, ids = merge_nodes(graph, rows.select(F.lit("Observation").alias("label"), "merge_key", props.alias("props"), F.lit(0).alias("seq")), desc_truthy())
    told = materialize(rows.join(ids.select("merge_key", F.col("id").alias("obs")), "merge_key").select("obs", "source_id", "source_type", "witness"), "observations")
    links = provenance_links(merged, told).select("src", "type", "dst", F.create_map().cast("map<string,string>").alias("props"), F.lit(0).alias("seq"))
    final, _ = merge_edges(merged, links)
    return final, told.select("obs", "source_id")


def ingest(graph: Graph, statements: DataFrame, extractor: Callable[[DataFrame], DataFrame], ontology: Ontology, at: str, id_map: DataFrame | None = None, confidence: str = "0.8") -> tuple[Graph, DataFrame]:
    """Statements (source_id, source_type, text, seq, and witness or none) into the graph: extraction with a retry, coreference, upserts and provenance.

    Gives the graph and (step, n): statements, read, nodes and relationships that were created, observations.
    """
    spark = statements.sparkSession
    records = materialize(extract(statements, extractor).where("x is not null").join(statements.select("source_id", "seq"), "source_id"), "records")
    if id_map is not None:
        records = materialize(remap(records, id_map), "records")
    loaded, ids, links = load(graph, records, ontology, at, confidence)
    witness = F.col("witness") if "witness" in statements.columns else F.lit(None).cast("string")
    final, told = observe(loaded, statements.withColumn("witness", witness), at)
    steps = [("statements", statements.count()), ("read", records.count()), ("nodes created", ids.where("created").count()), ("relationships created", links.count()), ("observations", told.count())]
    return final, spark.createDataFrame(steps, "step string, n bigint")


def merge_facts(graph: Graph, facts: DataFrame, ontology: Ontology, at: str) -> Graph:
    """What an interview adds: records (x, seq) upserted as those of no source and of medium confidence."""
    before = graph.nodes.select("id", F.lit(True).alias("_known"))
    rows = facts.select(F.concat(F.lit("interview "), F.col("seq").cast("string")).alias("source_id"), F.lit(None).cast("string").alias("source_type"), "seq", "x")
    loaded, _, _ = load(graph, rows, ontology, at, "medium")
    # nodes that the interview made have no source; those that were there keep theirs
    old = graph.nodes.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("props")["source"].alias("_told"))
    joined = loaded.nodes.join(old, F.col("id") == F.col("_id"), "left").join(before, "id", "left")
    own = F.map_filter("props", lambda k, v: k != "source")
    props = F.when(F.col("_told").isNull(), own).otherwise(F.map_concat(own, F.create_map(F.lit("source"), F.col("_told"))))
    return Graph(joined.withColumn("source", F.col("_source")).withColumn("props", props).select(*graph.nodes.columns), loaded.edges)


def load_by_name(graph: Graph, entities: DataFrame, relationships: DataFrame) -> Graph:
    """Entities (name, type, description) upserted by exact name, relationships (source, target, type) between names, types in capitals."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = entities.where("name is not null and name <> ''").select(F.coalesce("type", F.lit("Entity")).alias("label"), F.col("name").alias("merge_key"), F.create_map(F.lit("name"), F.col("name"), F.lit("description"), text(F.col("description"))).alias("props"), F.monotonically_increasing_id().alias("seq"))
    merged, _ = merge_nodes(graph, rows, F.col("props")["name"])
    ids = materialize(merged.nodes.select(F.col("props")["name"].alias("n"), "id").where("n is not null").groupBy("n").agg(F.min("id").alias("id")), "names")
    a, b = ids.select(F.col("n").alias("source"), F.col("id").alias("src")), ids.select(F.col("n").alias("target"), F.col("id").alias("dst"))
    links = relationships.join(a, "source").join(b, "target").select("src", relationship_name(F.col("type")).alias("type"), "dst", F.create_map().cast("map<string,string>").alias("props"), F.lit(0).alias("seq"))
    return merge_edges(merged, links)[0]
