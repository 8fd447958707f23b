"""Queries against their SQL on the smallest tables, and the contract of the entry module."""

import math
import os
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"


def _stated() -> list[str]:
    """All queries of the core that SQL states."""
    from graphloom.plans import catalogue, core_problems

    return sorted(catalogue.SQL | core_problems.SQL)


needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not there")


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


@needs_data
@pytest.mark.parametrize("name", _stated())
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    at = [c[0] for c in rel.description]
    assert sorted(at) == cols
    want = Counter(repr(tuple(normal(r[at.index(c)]) for c in cols)) for r in rel.fetchall())
    assert Counter(repr(tuple(normal(r[c]) for c in cols)) for r in df.collect()) == want


def test_contract():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 80 and {"p3_found", "p5_found"} <= set(queries)


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["nation", "n"] and entry.entry(spark).count() > 0


def test_whole_graph_queries(spark, tmp_path):
    """turtle_graph, jsonld_graph and distinct_endpoint_count: all labels, properties, references and sources."""
    import json

    import __spark_entry__ as entry

    nodes = [(1, ["Person"], "Person", {"name": "Ann", "role": None, "gender": "f"}, "desk-1"), (1, ["Person"], "Person", {"name": "Ann", "role": None, "gender": "f"}, "desk-1"), (2, ["Vehicle"], "Vehicle", {"colour": "red"}, "cam-1"), (3, ["Location"], "Location", {"description": "Main St", "type": "road"}, None)]
    spark.createDataFrame(nodes, "id bigint, labels array<string>, label string, props map<string,string>, source string").write.parquet(str(tmp_path / "graph_nodes.parquet"))
    edges = [(7, 1, 2, "DROVE", {}), (8, 1, 3, "DROVE", {}), (8, 1, 3, "DROVE", {}), (9, 2, 2, "SELF", {}), (10, 1, 99, "DROVE", {})]
    spark.createDataFrame(edges, "id bigint, src bigint, dst bigint, type string, props map<string,string>").write.parquet(str(tmp_path / "graph_edges.parquet"))
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    lines = [(r["kind"], r["id"], r["line"]) for r in run("turtle_graph")]
    assert sorted(x[:2] for x in lines) == [("node", 1), ("node", 2), ("node", 3), ("relationship", 7), ("relationship", 8), ("relationship", 9)]
    one = next(x[2] for x in lines if x[:2] == ("node", 1))
    assert one.startswith("node:1\n    a ") and 'rdfs:label "Ann"' in one and 'evt:gender "f"' in one and "role" not in one
    ld = {r["id"]: json.loads(r["json"]) for r in run("jsonld_graph")}
    ref = lambda i: {"@id": f"urn:event-twin:node:{i}"}
    assert set(ld) == {1, 2, 3} and ld[1]["drove"] == [ref(2), ref(3)] and ld[2]["self"] == ref(2) and ld[1]["gender"] == "f" and "role" not in ld[1]
    assert {tuple(r) for r in run("distinct_endpoint_count")} == {("desk-1", 1, 2), ("cam-1", 1, 2), (None, 1, 1)}
