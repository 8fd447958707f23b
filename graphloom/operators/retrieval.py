"""Retrieval: vector top-k, neighbourhoods of named seeds, and merged context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.store import small_enough
from graphloom.functions.text import cosine
from graphloom.model import Graph, desc_full
from graphloom.operators.match import paths
from graphloom.operators.write import first_by


def top_k(vectors: DataFrame, query: list[float], k: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) of the k vectors nearest by cosine, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def seeds(graph: Graph, terms: DataFrame, each: int = 5, most: int = 1000) -> DataFrame:
    """(term, id): the first nodes whose description contains a term, case aside. The terms of a question are few; more than ``most`` are refused."""
    if not small_enough(terms, most):
        raise ValueError(f"more than {most} terms")
    nodes = graph.nodes.select("id", F.lower(desc_full()).alias("d")).where("d is not null")
    hit = nodes.join(F.broadcast(terms.select("term", F.lower("term").alias("t"))), F.col("d").contains(F.col("t")))
    w = Window.partitionBy("term").orderBy("id")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= each).select("term", "id")


def exact_seeds(graph: Graph, names: DataFrame) -> DataFrame:
    """(term, id): all nodes of exactly this name, description or value, by an equi-join; names may be many."""
    return graph.nodes.select("id", desc_full().alias("term")).where("term is not null").join(names.select("term").distinct(), "term").select("term", "id")


def subgraph(graph: Graph, seed: DataFrame, hops: int = 2, each: int = 30) -> DataFrame:
    """(term, edge_id, triple, source, source_type, confidence): the relationships around seeds as text, each with what its start node came from."""
    around = neighbourhood(graph, seed, hops, each).select("term", F.explode("edge_ids").alias("id")).distinct()
    from_ = graph.nodes.select(F.col("id").alias("src"), "source", "source_type", "confidence")
    told = triples(graph).join(graph.edges.select("id", "src"), "id").join(from_, "src")
    return around.join(told, "id").select("term", F.col("id").alias("edge_id"), "triple", "source", "source_type", "confidence")


def provenance(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, source, observations): nodes with their source and the descriptions of the Observations linked to them, in order."""
    links = graph.typed("OBSERVED", "DERIVED_FROM", "MADE_BY")
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("o")), F.struct(F.col("dst").alias("id"), F.col("src").alias("o")))).alias("e")).select("e.*")
    told = ends.join(graph.labelled("Observation").select(F.col("id").alias("o"), F.col("props")["description"].alias("d")), "o").groupBy("id").agg(F.array_sort(F.collect_set("d")).alias("observations"))
    return ids.select("id").distinct().join(graph.nodes.select("id", "source"), "id").join(told, "id", "left").select("id", "source", F.coalesce("observations", F.array().cast("array<string>")).alias("observations"))


def embed(rows: DataFrame, embedder, text: str = "text", vector: str = "embedding") -> DataFrame:
    """``rows`` with a vector by an injected function from a list of texts to a list of vectors, called once a batch."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else [float(x) for x in v] for v in embedder([t or "" for t in texts])])

    return rows.withColumn(vector, run(F.col(text)))


def detected(answer: str | None) -> list[str]:
    """The names in a model's JSON list; none where it cannot be read."""
    import json
    import re

    found = re.search(r"\[.*\]", answer or "", re.S)
    try:
        return [str(x) for x in json.loads(found.group())] if found else []
    except ValueError:
        return []


COMMANDS = ("sources", "from", "contradictions", "timeline", "export", "whatif remove")
FORMATS = ("dot", "html", "turtle", "jsonld")


def command(graph: Graph, line: str) -> DataFrame | str:
    """A named query: /sources, /from SOURCE, /contradictions, /timeline, /export FORMAT, /whatif remove SOURCE; other lines are an error."""
    from graphloom.operators import fusion, temporal
    from graphloom.sources import files

    words = line.strip().split()
    name, rest = (words[0].lstrip("/"), words[1:]) if words and words[0].startswith("/") else ("", [])
    if name == "sources":
        return graph.nodes.where("source is not null").groupBy("source", "source_type").agg(F.count("*").alias("n"))
    if name == "from" and rest:
        return graph.nodes.where(F.col("source") == rest[0]).select("id", F.get("labels", F.lit(0)).alias("label"), desc_full().alias("description"))
    if name == "contradictions":
        side = lambda k: graph.nodes.select(F.col("id").alias(k), desc_full().alias(f"{k}_description"))
        return graph.typed("CONTRADICTS").join(side("src"), "src").join(side("dst"), "dst").select("id", "src_description", "dst_description", F.col("props")["field"].alias("field"))
    if name == "timeline":
        return temporal.timeline(graph).drop("branch", "n")
    if name == "export" and rest:
        if rest[0] not in FORMATS:
            raise ValueError(f"formats: {', '.join(FORMATS)}")
        return {"dot": files.dot_lines, "turtle": files.turtle_lines, "jsonld": files.jsonld_nodes, "html": files.vis_html}[rest[0]](graph)
    if name == "whatif" and rest[:1] == ["remove"] and len(rest) > 1:
        return fusion.what_if(graph, lambda g: fusion.remove_source(g, rest[1])[0])
    raise ValueError(f"commands: {', '.join('/' + c for c in COMMANDS)}")


def neighbourhood(graph: Graph, seed: DataFrame, hops: int = 2, each: int = 30) -> DataFrame:
    """(term, start_id, end_id, rel_types, node_ids): undirected trails of 1 to ``hops`` from (term, id), the first ``each`` per term."""
    found = paths(graph, seed.select("id").distinct(), 1, hops, direction="both").join(seed.select("term", F.col("id").alias("start_id")), "start_id")
    w = Window.partitionBy("term").orderBy("length", "start_id", "edge_ids")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= each).select("term", "start_id", "end_id", "length", "node_ids", "edge_ids")


def triples(graph: Graph) -> DataFrame:
    """(id, triple): every relationship as text."""
    from graphloom.model import desc_linear

    side = lambda k: graph.nodes.select(F.col("id").alias(k), F.concat(F.get("labels", F.lit(0)), F.lit(": "), desc_linear()).alias(f"{k}_text"))
    e = graph.edges.select("id", "src", "dst", "type").join(side("src"), "src").join(side("dst"), "dst")
    return e.select("id", F.concat(F.lit("("), F.col("src_text"), F.lit(") -["), F.col("type"), F.lit("]-> ("), F.col("dst_text"), F.lit(")")).alias("triple"))


def linearised(graph: Graph) -> str:
    """All triples as lines by relationship id, for a prompt; a graph of more than 20,000 relationships fits into none and is refused."""
    if not small_enough(graph.edges, 20_000):
        raise ValueError("too many relationships for a prompt")
    lines = [r["triple"] for r in triples(graph).orderBy("id").toLocalIterator()]
    return "\n".join(lines) or "(empty graph)"


def merged_context(documents: DataFrame, paths_: DataFrame) -> DataFrame:
    """(part, seq, text): documents (seq, text) first, then each (source, entity) path once, in order."""
    docs = documents.select(F.lit(0).alias("part"), "seq", "text")
    return docs.unionByName(first_by(paths_, ["source", "entity"], ["seq"]).select(F.lit(1).alias("part"), "seq", "text"))


def relevance_route(verdict):
    """retry or answer by a judge's verdict, taken exactly: ``insufficient`` is not ``sufficient``."""
    return F.when(F.lower(F.trim(verdict)) == "sufficient", "answer").otherwise("retry")


def ask_sql(spark, question: str, to_sql, views: dict[str, DataFrame]) -> dict:
    """A question by an injected translator to SQL: fences taken off, checked by EXPLAIN, run; errors become part of the answer."""
    import re

    for name, df in views.items():
        df.createOrReplaceTempView(name)
    text = re.sub(r"```(?:sql)?", "", to_sql(question)).strip().rstrip(";")
    try:
        if not re.match(r"(?is)\s*(select|with)\b", text):
            raise ValueError("only queries are run")
        spark.sql(f"EXPLAIN {text}").collect()
        return {"question": question, "sql": text, "rows": spark.sql(text), "error": None}
    except Exception as error:  # noqa: BLE001
        return {"question": question, "sql": text, "rows": None, "error": str(error).split("\n")[0]}
