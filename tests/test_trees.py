"""Depth-first order against a walk, and trees that are deep, broken or circular."""

import random

from pyspark.sql import functions as F

from textloom.operators import threads
from textloom.plans import trees


def walk(nodes, roots):
    out = []
    for tree, counts in roots:
        kids = {}
        for t, i, parent, key in nodes:
            if t == tree:
                kids.setdefault(parent, []).append((key, i))
        position, stack = 0, [("", 0)]
        while stack:
            node, depth = stack.pop()
            out.append((tree, node, position, depth))
            position += 1 if node or counts else 0
            stack += [(i, depth + 1) for _, i in sorted(kids.get(node, []), reverse=True)]
    return sorted(out)


def found(spark, nodes, roots):
    d = spark.createDataFrame(nodes, "tree string, id string, parent string, key string").repartition(3)
    r = spark.createDataFrame(roots, "tree string, counts boolean")
    return sorted((x.tree, x.id, x.position, x.depth) for x in trees.depth_first(d, r).collect())


def test_against_a_walk(spark):
    rnd = random.Random(7)
    nodes, roots = [], [("a", True), ("b", False), ("c", True), ("empty", False)]
    for tree in "abc":
        for k in range(60):
            nodes.append((tree, f"n{k}", rnd.choice(["", f"n{rnd.randrange(60)}", f"n{max(0, k - 1)}" if k else "", "missing"]), str(rnd.randrange(5))))
    assert found(spark, nodes, roots) == walk(nodes, roots)


def test_circles_and_orphans_are_left_out(spark):
    nodes = [("t", "a", "b", "1"), ("t", "b", "a", "1"), ("t", "c", "a", "1"), ("t", "d", "gone", "1"), ("t", "e", "d", "1"), ("t", "f", "", "1"), ("t", "g", "g", "1")]
    assert found(spark, nodes, [("t", True)]) == [("t", "", 0, 0), ("t", "f", 1, 1)]


def test_a_chain_of_5000_in_few_rounds(spark, monkeypatch):
    tables = []
    real = trees.written
    monkeypatch.setattr(trees, "written", lambda d: tables.append(len(d._jdf.queryExecution().optimizedPlan().toString())) or real(d))
    nodes = [("t", f"n{k}", f"n{k - 1}" if k else "", "1") for k in range(5_000)]
    got = found(spark, nodes, [("t", True)])
    assert [x[2:] for x in sorted(got, key=lambda x: x[2])] == [(k, k) for k in range(5_001)]
    assert len(tables) < 20 and tables[-1] < 2 * tables[1]  # rounds, and plans that don't grow


def test_replies(spark):
    s = spark.createDataFrame([("s1", "ann", None, 10, "post"), ("s2", "bob", None, 11, "  ")], "id string, author string, author_fullname string, created_utc long, selftext string")
    c = spark.createDataFrame(
        [("c2", "t3_s1", "t3_s1", "x", None, 30, "second"), ("c1", "t3_s1", "t3_s1", "y", None, 20, "first"), ("c3", "t3_s1", "t1_c1", "z", None, 40, None), ("c4", "s2", "s2", "w", None, 5, "only"), ("c5", "t3_s9", "t3_s9", "v", None, 5, "orphan"), ("c6", "t3_s1", "t1_zz", "v", None, 5, "lost"), ("c1", "t3_s1", "t3_s1", "y", None, 25, "again")],
        "id string, link_id string, parent_id string, author string, author_fullname string, created_utc long, body string",
    )
    turns, orphans = threads.reply_turns(s, c)
    rows = turns.orderBy("item_id", "turn_index").select("item_id", "turn_index", "depth", "content").collect()
    assert [tuple(r) for r in rows] == [("s1", 0, 0, "post"), ("s1", 1, 1, "first"), ("s1", 2, 2, ""), ("s1", 3, 1, "second"), ("s2", 0, 1, "only")]
    assert [r.id for r in orphans.collect()] == ["c5"]
