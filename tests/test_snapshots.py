"""Changes between snapshots against a pairwise comparison."""

import random

from graphloom.operators.snapshots import snapshot_changes

SCHEMA = ("snapshot_id bigint, graph_id string, timestamp string, nodes array<struct<id:bigint,labels:array<string>,props:map<string,string>>>, "
          "relationships array<struct<id:bigint,type:string,start_id:bigint,end_id:bigint,props:map<string,string>>>, node_count int, rel_count int, extra string")


def rows_of(spark, rows):
    return {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()}


def snap(i, t, nodes, rels=(), g="g", n=None, r=None):
    return (i, g, t, [(k, lab, p) for k, lab, p in nodes], list(rels), len(nodes) if n is None else n, len(rels) if r is None else r, "x")


def test_what_counts_as_a_change(spark):
    a = snap(7, "2024-01-01T10:00:00+02:00", [(1, ["A", "B"], {"x": "1", "extracted_at": "t"}), (2, ["A"], {}), (3, ["C"], {"y": None})], [(1, "R", 1, 2, {})])
    b = snap(3, "2024-01-01T09:00:00Z", [(3, ["C"], {}), (1, ["B", "A", "A"], {"extracted_at": "u", "x": "1"}), (4, ["A"], {}), (4, ["A"], {})], [(1, "R", 1, 3, {})])
    assert rows_of(spark, [b, a, a]) == {("g", 3, "node", 2, "removed"), ("g", 3, "node", 4, "added"), ("g", 3, "relationship", 1, "changed")}


def test_incomplete_deliveries_give_way(spark):
    full = snap(2, "2024-01-02T00:00:00Z", [(1, ["A"], {}), (2, ["A"], {})])
    part = snap(2, "2024-01-02T00:00:00Z", [(1, ["A"], {})], n=2)
    first = snap(1, "2024-01-01T00:00:00Z", [(1, ["A"], {}), (2, ["A"], {})])
    assert rows_of(spark, [part, full, first]) == set()
    assert rows_of(spark, [part, first]) == {("g", 2, "node", 2, "removed")}  # nothing better was delivered


def test_nulls_ties_and_empty(spark):
    rows = [(1, "g", "2024-01-01T00:00:00Z", None, None, None, None, None), (2, "g", "2024-01-01T00:00:00Z", [(None, None, None), (5, None, None)], None, 0, 0, None), (None, "g", "2024-01-03T00:00:00Z", None, None, 0, 0, None), (4, "g", "soon", None, None, 0, 0, None), (5, None, "2024-01-01T00:00:00Z", None, None, 0, 0, None)]
    assert rows_of(spark, rows) == {("g", 2, "node", 5, "added")}
    assert rows_of(spark, []) == set()


def test_against_pairwise_comparison(spark):
    rnd = random.Random(11)
    rows, want = [], set()
    for g in ("a", "b"):
        before = None
        for t in range(8):
            items = {k: (rnd.choice(["A", "B"]), rnd.choice("12")) for k in range(6) if rnd.random() < 0.6}
            sid = rnd.randrange(10 ** 9)
            rows.append(snap(sid, f"2024-01-{t + 1:02d}T00:00:00Z", [(k, [lab], {"v": v}) for k, (lab, v) in items.items()], g=g))
            if before is not None:
                for k in {*items, *before}:
                    if items.get(k) != before.get(k):
                        want.add((g, sid, "node", k, "added" if k not in before else "removed" if k not in items else "changed"))
            before = items
    rnd.shuffle(rows)
    assert rows_of(spark, rows) == want
