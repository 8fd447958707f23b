"""Fusion of sources: matching, confidence updates, corroboration and contradiction; what-if comparison of graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.store import materialize
from graphloom.functions.text import plain_name
from graphloom.model import Graph, desc_full, desc_truthy, has_label
from graphloom.operators.write import detach_delete, merge_edges

STRONG = 0.8


def boosted(confidence: Column) -> Column:
    """0.9 where there is none, else three tenths of the way to 1 below 0.95."""
    return F.when(confidence.isNull(), 0.9).when(confidence < 0.95, confidence + (1 - confidence) * 0.3).otherwise(confidence)


def decayed(confidence: Column) -> Column:
    """0.5 where there is none, else seven tenths above 0.3."""
    return F.when(confidence.isNull(), 0.5).when(confidence > 0.3, confidence * 0.7).otherwise(confidence)


def folded(start: Column, events: Column) -> Column:
    """Confidence after boosts (true) and decays (false) in the order of an array."""
    return F.aggregate(events, start.cast("double"), lambda c, up: F.when(up, boosted(c)).otherwise(decayed(c)))


def entities(graph: Graph) -> DataFrame:
    """(id, label, source, desc) of what sources tell, Observations and versions aside."""
    return graph.nodes.where(~has_label("Observation", "GraphVersion") & F.col("source").isNotNull()).select("id", "label", "source", desc_full().alias("desc"))


def source_pairs(graph: Graph) -> DataFrame:
    """(source_a, source_b), each pair of sources once, in order of name. The number of sources is small by nature."""
    s = entities(graph).select("source").distinct()
    return s.select(F.col("source").alias("source_a")).join(s.select(F.col("source").alias("source_b")), F.col("source_a") < F.col("source_b"))


def same_name_matches(graph: Graph) -> DataFrame:
    """(seq, entity_a_desc, entity_b_desc, confidence): the default matcher, entities of one label and normalised description in different sources."""
    e = entities(graph).where("desc is not null").select("label", "source", "desc", plain_name(F.col("desc")).alias("key")).distinct()
    a, b = e.select("label", "key", F.col("source").alias("sa"), F.col("desc").alias("entity_a_desc")), e.select("label", "key", F.col("source").alias("sb"), F.col("desc").alias("entity_b_desc"))
    return a.join(b, ["label", "key"]).where("sa < sb").select("entity_a_desc", "entity_b_desc", F.lit(0.9).alias("confidence")).distinct()


def resolve(graph: Graph, matcher: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Matches by an injected matcher over (entities, source pairs), else by the default one."""
    return matcher(entities(graph), source_pairs(graph)) if matcher else same_name_matches(graph)


def apply_matches(graph: Graph, matches: DataFrame) -> Graph:
    """POSSIBLY_SAME_AS between all nodes of the two descriptions; strong matches raise the confidence of both ends, in the order of seq. Empty and equal descriptions are passed over."""
    good = matches.where("entity_a_desc <> '' and entity_b_desc <> '' and entity_a_desc <> entity_b_desc")
    return _update(graph, good, "POSSIBLY_SAME_AS", True, STRONG)


def apply_contradictions(graph: Graph, contradictions: DataFrame) -> Graph:
    """CONTRADICTS between all nodes of the two descriptions; both ends lose confidence, in the order of seq."""
    return _update(graph, contradictions.where("entity_a_desc <> '' and entity_b_desc <> ''"), "CONTRADICTS", False, None)


def _update(graph: Graph, rows: DataFrame, type_: str, up: bool, strong: float | None) -> Graph:
    desc = graph.nodes.select("id", desc_full().alias("desc")).where("desc is not null")
    a, b = desc.select(F.col("id").alias("src"), F.col("desc").alias("entity_a_desc")), desc.select(F.col("id").alias("dst"), F.col("desc").alias("entity_b_desc"))
    extra = [c for c in rows.columns if c in ("field", "value_a", "value_b", "reasoning", "confidence")]
    props = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, extra)), F.array(*[F.col(c).cast("string") for c in extra])) if extra else F.create_map().cast("map<string,string>"), lambda k, v: v.isNotNull())
    links = rows.join(a, "entity_a_desc").join(b, "entity_b_desc").where("src <> dst")
    linked, _ = merge_edges(graph, links.select("src", F.lit(type_).alias("type"), "dst", props.alias("props"), "seq"))
    counted = links if strong is None else links.where(F.col("confidence") >= strong)
    hits = counted.select("seq", F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("hits"))
    events = F.array_repeat(F.lit(up), F.col("hits").cast("int"))
    nodes = linked.nodes.join(hits, "id", "left").withColumn("confidence", F.when(F.col("hits").isNull(), F.col("confidence")).otherwise(folded(F.col("confidence"), events))).select(*linked.nodes.columns)
    return Graph(nodes, linked.edges)


def corroborations(graph: Graph, matches: DataFrame) -> DataFrame:
    """(src, dst): Observations that tell of the sources of two strongly matched entities, by the source's name in the description.

    Source names are found as whole blank-parted words by an equi-join, the substring test follows.
    """
    pairs, told = corroboration_groups(graph, matches)
    a, b = told.select(F.col("observation").alias("src"), F.col("source").alias("source_a")), told.select(F.col("observation").alias("dst"), F.col("source").alias("source_b"))
    return pairs.join(a, "source_a").join(b, "source_b").where("src <> dst").select("src", "dst").distinct()


def corroboration_groups(graph: Graph, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_a, source_b) of strongly matched entities, and (source, observation) by the source's name in the description: ``corroborations`` without multiplying the members of two sources."""
    desc = entities(graph).where("desc is not null")
    strong = matches.where(F.col("confidence") >= STRONG).select("entity_a_desc", "entity_b_desc").distinct()
    a, b = desc.select(F.col("desc").alias("entity_a_desc"), F.col("source").alias("source_a")).distinct(), desc.select(F.col("desc").alias("entity_b_desc"), F.col("source").alias("source_b")).distinct()
    pairs = strong.join(a, "entity_a_desc").join(b, "entity_b_desc").where("source_a <> source_b").select("source_a", "source_b").distinct()
    told = graph.labelled("Observation").select(F.col("id").alias("observation"), F.explode(F.array_distinct(F.split(F.coalesce(F.col("props")["description"], F.lit("")), r"[\s,;()]+"))).alias("source"))
    return pairs, told.join(desc.select("source").distinct(), "source").select("source", "observation")


def corroborate(graph: Graph, matches: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph with CORROBORATED_BY between Observations that bear strong matches out, and the created relationships."""
    links = corroborations(graph, matches)
    return merge_edges(graph, links.select("src", F.lit("CORROBORATED_BY").alias("type"), "dst", F.create_map().cast("map<string,string>").alias("props"), F.lit(0).alias("seq")))


def run_fusion(graph: Graph, matcher: Callable[[DataFrame, DataFrame], DataFrame] | None = None, contradictor: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[Graph, DataFrame]:
    """All pairs of sources fused: matches linked and counted in order, strong ones corroborated, contradictions applied after them.

    Gives the graph and (step, n): matches, corroborations and contradictions.
    """
    spark = graph.nodes.sparkSession
    matches = resolve(graph, matcher)
    if "seq" not in matches.columns:
        matches = matches.withColumn("seq", F.xxhash64("entity_a_desc", "entity_b_desc"))
    matches = materialize(matches, "matches")
    fused = apply_matches(graph, matches)
    fused, borne = corroborate(fused, matches)
    steps = [("matches", matches.count()), ("corroborations", borne.count())]
    if contradictor:
        against = materialize(contradictor(entities(graph), source_pairs(graph)), "contradictions")
        fused = apply_contradictions(fused, against)
        steps.append(("contradictions", against.count()))
    return fused, spark.createDataFrame(steps, "step string, n bigint")


#: How much a kind of source is believed, where nothing else is said.
SOURCE_WEIGHTS = {"cctv": 0.95, "forensic_report": 0.95, "medical_report": 0.9, "police_report": 0.85, "statement": 0.7}


def path_confidence(paths: DataFrame, edges: DataFrame, default: float = 0.5) -> DataFrame:
    """(start_id, end_id, edge_ids, confidence): a chain is as sure as its least sure relationship (property confidence)."""
    sure = edges.select(F.col("id").alias("edge_id"), F.coalesce(F.col("props")["confidence"].try_cast("double"), F.lit(default)).alias("c"))
    return paths.select("start_id", "end_id", "edge_ids", F.explode("edge_ids").alias("edge_id")).join(sure, "edge_id").groupBy("start_id", "end_id", "edge_ids").agg(F.min("c").alias("confidence"))


def weighted_confidence(graph: Graph, default: float = 0.5) -> DataFrame:
    """(id, confidence): a node's confidence, else the weight of its kind of source."""
    weights = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])
    return graph.nodes.select("id", F.coalesce("confidence", F.try_element_at(weights, F.col("source_type")), F.lit(default)).alias("confidence"))


def corroboration_rate(graph: Graph) -> DataFrame:
    """(label, entities, corroborated, rate): descriptions that more than one source tells of, by label."""
    by = entities(graph).where("desc is not null").groupBy("label", "desc").agg(F.count_distinct("source").alias("sources"))
    return by.groupBy("label").agg(F.count("*").alias("entities"), F.count_if(F.col("sources") > 1).alias("corroborated")).withColumn("rate", F.col("corroborated") / F.col("entities"))


def contradiction_density(graph: Graph, type_: str = "CONTRADICTS") -> DataFrame:
    """(contradictions, entities, density)."""
    n = entities(graph).agg(F.count("*").alias("entities"))
    return graph.typed(type_).agg(F.count("*").alias("contradictions")).join(n).withColumn("density", F.try_divide("contradictions", "entities"))


def remove_source(graph: Graph, source: str) -> tuple[Graph, DataFrame]:
    """The graph without a source's nodes and the Observations that tell of it; (nodes, relationships) counts the former."""
    own = graph.nodes.where(F.col("source") == source).select("id")
    touched = graph.edges.select("id", F.explode(F.array("src", "dst")).alias("n")).join(own.select(F.col("id").alias("n")), "n", "left_semi")
    counts = own.agg(F.count_distinct("id").alias("nodes")).join(touched.agg(F.count_distinct("id").alias("relationships")))
    told = has_label("Observation") & F.coalesce(F.col("props")["description"].contains(source), F.lit(False))
    return detach_delete(graph, (F.coalesce(F.col("source") == source, F.lit(False))) | told), counts


def compare(before: Graph, after: Graph, ignored: tuple[str, ...] = ("extracted_at",)) -> DataFrame:
    """(labels, desc, status, changes): nodes by sorted labels and description, only_a, only_b, changed or common, with each changed property's two values."""
    def side(g: Graph, name: str) -> DataFrame:
        rows = g.nodes.select(F.array_join(F.array_sort("labels"), "+").alias("labels"), desc_truthy().alias("desc"), "id", F.map_filter("props", lambda k, v: v.isNotNull() & ~k.isin(*ignored)).alias("p")).where("desc is not null")
        return rows.groupBy("labels", "desc").agg(F.max_by("p", "id").alias(name))

    both = side(before, "a").join(side(after, "b"), ["labels", "desc"], "full")
    keys = F.array_sort(F.array_union(F.map_keys("a"), F.map_keys("b")))
    diff = F.filter(F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at("a", k).alias("value_a"), F.try_element_at("b", k).alias("value_b"))), lambda s: ~s["value_a"].eqNullSafe(s["value_b"]))
    out = both.withColumn("changes", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), diff))
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.size("changes") > 0, "changed").otherwise("common")
    return out.select("labels", "desc", status.alias("status"), "changes")


def what_if(graph: Graph, change: Callable[[Graph], Graph]) -> DataFrame:
    """What a change would do; the graph itself stays as it is."""
    return compare(graph, change(graph))
