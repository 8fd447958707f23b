"""Patterns against brute force on small random graphs, and on a company graph with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.model import edge, from_rows, node
from graphloom.operators import match as M
from graphloom.operators import write as W

PEOPLE = {1: "Alice", 2: "Bob", 3: "Carol", 4: "Dave", 5: "Eve", 6: "Frank"}


@pytest.fixture(scope="module")
def company(spark):
    nodes = [node(i, "Person", name=n) for i, n in PEOPLE.items()] + [node(10, "Project", name="Atlas", status="active"), node(11, "Project", name="Beacon", status="active"), node(12, "Project", name="Cipher", status="planned"), node(20, "Product", name="Nova 7")]
    edges = [edge(1, 1, "MANAGES", 2), edge(2, 2, "MANAGES", 4), edge(3, 2, "MANAGES", 3), edge(4, 2, "WORKS_ON", 10), edge(5, 3, "WORKS_ON", 10), edge(6, 4, "WORKS_ON", 10), edge(7, 5, "WORKS_ON", 11), edge(8, 6, "WORKS_ON", 11), edge(9, 6, "WORKS_ON", 12), edge(10, 10, "USES", 20)]
    return from_rows(spark, nodes, edges)


def names(rows, key):
    return sorted(PEOPLE[r[key]] for r in rows.collect())


def test_company_answers(company):
    g = company
    name = F.col("props")["name"]
    active = g.labelled("Project").where(F.col("props")["status"] == "active")
    size = M.hop(g, g.labelled("Person"), ("WORKS_ON",), end=active).groupBy("end_id").count()
    assert {r["end_id"]: r["count"] for r in size.collect()} == {10: 3, 11: 2}
    assert names(M.paths(g, g.nodes.where(name == "Alice"), 2, 3, ("MANAGES",)), "end_id") == ["Carol", "Dave"]
    above = M.all_paths(g, g.labelled("Person"), ("MANAGES",)).where("end_id = 4")
    assert sorted(r["node_ids"] for r in above.collect()) == [[1, 2, 4], [2, 4]]
    product = M.paths(g, g.nodes.where(name == "Bob"), 2, 2).where("end_id = 20")
    assert product.count() == 1
    boss = M.optional_hop(g, g.labelled("Person"), ("MANAGES",), "in")
    assert {r["start_id"]: r["end_id"] for r in boss.collect()} == {1: None, 2: 1, 3: 2, 4: 2, 5: None, 6: None}
    assert M.isolated(g).count() == 0
    assert names(M.without_hop(g, g.labelled("Person"), ("MANAGES",), "both").select(F.col("id").alias("k")), "k") == ["Eve", "Frank"]


def trails(edges, start, lo, hi, direction):
    """Brute force: all trails as tuples of edge ids."""
    steps = []
    for i, (a, b) in edges.items():
        if direction in ("out", "both"):
            steps.append((i, a, b))
        if direction == "in" or direction == "both" and a != b:
            steps.append((i, b, a))
    out = []

    def go(at, used):
        if lo <= len(used) <= hi:
            out.append((start, at, tuple(used)))
        if len(used) < hi:
            for i, u, v in steps:
                if u == at and i not in used:
                    go(v, [*used, i])

    go(start, [])
    return [t for t in out if t[2]]


@pytest.mark.parametrize("direction", ["out", "in", "both"])
@pytest.mark.parametrize("seed", [1, 2])
def test_paths_against_brute_force(spark, seed, direction):
    rnd = random.Random(seed)
    edges = {i: (rnd.randrange(5), rnd.randrange(5)) for i in range(8)}  # parallel edges and loops included
    g = from_rows(spark, [node(i, "N") for i in range(5)], [edge(i, a, "R", b) for i, (a, b) in edges.items()])
    want = sorted(t for s in range(5) for t in trails(edges, s, 1, 3, direction))
    got = sorted((r["start_id"], r["end_id"], tuple(r["edge_ids"])) for r in M.paths(g, g.nodes, 1, 3, direction=direction).collect())
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_cycles_and_components(spark, seed):
    rnd = random.Random(seed)
    edges = {i: (rnd.randrange(12), rnd.randrange(12)) for i in range(9)}
    g = from_rows(spark, [node(i, "N") for i in range(12)], [edge(i, a, "R", b) for i, (a, b) in edges.items()])
    closed = any(t[1] == s for s in range(12) for t in trails({i: e for i, e in edges.items() if e[0] != e[1]}, s, 2, 9, "out"))
    assert (not M.on_cycles(g, ("R",)).isEmpty()) == closed
    root = {i: i for i in range(12)}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges.values():
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert {r["id"]: r["component"] for r in M.components(g).collect()} == {i: find(i) for i in range(12)}


def test_self_loop_is_no_cycle_and_counts_once(spark):
    g = from_rows(spark, [node(1, "N")], [edge(1, 1, "R", 1)])
    assert M.on_cycles(g, ("R",)).isEmpty()
    assert [r["degree"] for r in M.degree(g).collect()] == [1]


def test_empty_graph(spark):
    g = from_rows(spark, [], [])
    assert M.paths(g, g.nodes, 1, 2).count() == 0 and M.components(g).count() == 0 and M.all_paths(g, g.nodes).count() == 0 and M.isolated(g).count() == 0


def test_upserts_are_idempotent(company, spark):
    rows = spark.createDataFrame([("Person", "Bob", {"name": "Bob", "title": "Lead"}, 1), ("Person", "Bob", {"title": "Head", "age": None}, 2), ("Person", "Zed", {"name": "Zed"}, 3)], "label string, merge_key string, props map<string,string>, seq int")
    key = F.col("props")["name"]
    once, ids = W.merge_nodes(company, rows, key)
    twice, again = W.merge_nodes(once, rows, key)
    assert once.nodes.count() == company.nodes.count() + 1 == twice.nodes.count()
    bob = [r["props"] for r in once.nodes.collect() if r["props"].get("name") == "Bob"]
    assert bob == [{"name": "Bob", "title": "Head"}]
    assert sorted((r["merge_key"], r["id"]) for r in ids.collect()) == sorted((r["merge_key"], r["id"]) for r in again.collect())
    assert sum(r["created"] for r in ids.collect()) == 1 and not any(r["created"] for r in again.collect())
    links = spark.createDataFrame([(1, "MANAGES", 2, {"since": "2020"}, 1), (1, "MANAGES", 5, {}, 2), (1, "MANAGES", 5, {}, 3)], "src bigint, type string, dst bigint, props map<string,string>, seq int")
    merged, created = W.merge_edges(company, links)
    assert created.count() == 1 and merged.edges.count() == company.edges.count() + 1
    assert [r["props"] for r in merged.edges.where("src = 1 and dst = 2").collect()] == [{"since": "2020"}]


def test_delete_takes_relationships_along(company):
    g = W.detach_delete(company, F.col("props")["name"] == "Bob")
    assert g.nodes.count() == company.nodes.count() - 1
    assert g.edges.where("src = 2 or dst = 2").count() == 0
    assert W.set_props(company, F.col("id") == 1, {"x": "y"}).nodes.where("props['x'] = 'y'").count() == 1
