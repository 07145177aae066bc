"""Small facts of the label algebra, retention and evaluation."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import labels, ranking

THEMES = "theme_id string, scheme_id string, parent_theme_id string, status string, created_at string"


def test_three_levels(spark):
    t = spark.createDataFrame([("market", "s", None, "active", "1"), ("pricing", "s", "market", "active", "1"), ("discounts", "s", "pricing", "archived", "1"), ("rivals", "s", None, "active", "1")], THEMES)
    codes = spark.createDataFrame([("a", "discounts", None), ("b", "pricing", "9"), ("c", "rivals", None)], "segment_id string, theme_id string, deleted_at string")
    negatives = spark.createDataFrame([("a", "market", None), ("d", "market", None)], "segment_id string, theme_id string, deleted_at string")
    tree = labels.closure(t)
    assert {tuple(r) for r in labels.positives(codes, tree).collect()} == {("discounts", "a"), ("pricing", "a"), ("market", "a"), ("rivals", "c")}
    # Rejections flow down, and a positive wins.
    assert {tuple(r) for r in labels.rejections(negatives, codes, tree).collect()} == {("market", "d"), ("pricing", "d"), ("discounts", "d")}


def test_cycle_ends(spark):
    t = spark.createDataFrame([("x", "s", "y", "active", "1"), ("y", "s", "x", "active", "1")], THEMES)
    assert labels.closure(t).count() == 4


def test_retention_rules(spark):
    runs = spark.createDataFrame([(f"tfidf_{k}", "t", str(k)) for k in range(4)] + [("odd", "t", "0")], "model_version string, theme_id string, trained_at string")
    pins = spark.createDataFrame([("tfidf_0", "t")], "model_version string, theme_id string")
    fate = {r.model_version: r.fate for r in ranking.retention(runs, pins).collect()}
    assert fate == {"tfidf_3": "latest", "tfidf_2": "recent", "tfidf_1": "prunable", "tfidf_0": "pinned", "odd": "latest"}
    with pytest.raises(ValueError):
        ranking.retention(runs, pins, keep=0)


def test_wilson_and_ap(spark):
    d = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int")
    low, high = ranking.wilson(F.col("k"), F.col("n"))
    rows = d.select(F.round(low, 3), F.round(high, 3)).collect()
    assert tuple(rows[0]) == (0.49, 0.943) and tuple(rows[1]) == (None, None)
    scored = spark.createDataFrame([("t", 0.9, 1), ("t", 0.8, 0), ("t", 0.7, 1), ("t", 0.1, 0), ("u", 0.5, 1), ("u", 0.5, 0)], "theme_id string, score double, y int")
    c = ranking.curve(scored)
    ap = {r[0]: r[1] for r in c.groupBy("theme_id").agg(F.sum(F.try_divide("pos", "all_pos") * F.col("tp") / F.col("k"))).collect()}
    assert abs(ap["t"] - 5 / 6) < 1e-9 and abs(ap["u"] - 0.5) < 1e-9


def test_tree_paths_follow_long_chains(spark):
    from textloom.operators.prepare import tree_paths

    c = spark.createDataFrame([(i, i - 1 if i else None) for i in range(60)], "id long, parent long")
    rows = {r.id: (r.depth, r.path) for r in tree_paths(c).collect()}
    assert len(rows) == 60 and rows[59] == (59, "/".join(f"{i:012d}" for i in range(60)))
