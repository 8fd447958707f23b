"""Match groups against union-find, and each defined case."""

import random

import pytest

from graphloom.llm.groups import match_groups

SCHEMA = "seq int, entity_a_desc string, entity_b_desc string, confidence double, reasoning string, group_desc string"


def groups(spark, rows):
    out = [tuple(r) for r in match_groups(spark.createDataFrame([(i, *r, None, "clash") for i, r in enumerate(rows)], SCHEMA)).collect()]
    assert len(out) == len(set(out))
    return {e: g for g, e in out}


def union_find(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, c in rows:
        if a and b and a != b and c is not None and c == c and c >= 0.7:
            x, y = sorted((find(a), find(b)), key=lambda s: s.encode())
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("n,m,seed", [(30, 18, 1), (60, 70, 2), (40, 30, 3)])
def test_random_graphs(spark, n, m, seed):
    rnd = random.Random(seed)
    rows = [(f"é{rnd.randrange(n)}", f"é{rnd.randrange(n)}", rnd.choice([0.7, 0.9, 0.69, None, float("nan")])) for _ in range(m)]
    assert groups(spark, rows) == union_find(rows)


def test_chain_star_and_hub(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}", 1.0) for i in range(40)]
    random.Random(4).shuffle(chain)
    star = [("s", f"s{i:03d}", 0.8) for i in range(200)]
    got = groups(spark, chain + star)
    assert {got[f"c{i:03d}"] for i in range(41)} == {"c000"} and {v for k, v in got.items() if k[0] == "s"} == {"s"}


def test_refused_rows(spark):
    rows = [(None, "a", 1.0), ("", "a", 1.0), ("a", "a", 1.0), ("a", "b", None), ("a", "b", float("nan")), ("a", "b", 0.6999), ("x", "X", 0.7), ("X", "x", 0.9), ("l" * 100_000, "x", 0.7)]
    assert groups(spark, rows) == {"x": "X", "X": "X", "l" * 100_000: "X"}
    assert groups(spark, []) == {}
