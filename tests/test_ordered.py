"""Running sums and first rows against windows, with one group that holds nearly all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.operators import corpus, more, prepare
from textloom.plans import ordered
from textloom.registry import canonical

SMALL = "/root/testdata/sf0.001"


def rows(spark, n=4_000):
    rnd = random.Random(3)
    made = [("hot" if rnd.random() < 0.99 else rnd.choice(["a", "b", None]), k, rnd.randint(-5, 9), rnd.random()) for k in range(n)]
    return spark.createDataFrame(made, "g string, k long, v long, w double").repartition(5)


@pytest.mark.parametrize("parts", (None, 1, 16))
def test_running_sums_equal_a_window(spark, parts):
    d = rows(spark)
    found = ordered.running_sums(d, ["g"], [F.desc("k")], ["v"], parts)
    w = Window.partitionBy("g").orderBy(F.desc("k"))
    wanted = d.select("*", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("v_upto"), F.sum("v").over(Window.partitionBy("g")).alias("v_all"))
    assert sorted(map(repr, found.collect())) == sorted(map(repr, wanted.select(found.columns).collect()))


def test_a_large_group_is_spread(spark):
    """No range has over a quarter of the rows, though one group has 99 % of them."""
    d = rows(spark)
    dealt = d.repartitionByRange(16, "g", F.desc("k")).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 12 and max(r["count"] for r in dealt) < d.count() / 4
    plan = ordered.running_sums(d, ["g"], [F.desc("k")], ["v"], 16)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and "part" in plan


@pytest.mark.parametrize("most", (1, 7, 1_500, 10_000))
def test_first_by_hash_equals_a_window(spark, most):
    d = rows(spark).na.fill("none")
    found = ordered.first_by_hash(d, ["g"], F.xxhash64("k"), most)
    w = Window.partitionBy("g").orderBy(F.xxhash64("k"), "k")
    wanted = d.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_empty(spark):
    d = rows(spark, 5).limit(0)
    assert ordered.running_sums(d, ["g"], [F.asc("k")], ["v"]).count() == 0 and ordered.first_by_hash(d, ["g"], F.xxhash64("k"), 3).count() == 0


def test_top_rows_are_cut_before_they_meet(spark):
    """The first few rows of a group are taken in every task, so the task of a group gets only those."""
    t = lambda *names: [canonical(spark, SMALL, n) for n in names]
    for d in (more.top_terms(*t("documents")), corpus.unique_terms(*t("items")), prepare.near_misses(*t("predictions", "segments"))):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit")[-1]


def test_candidate_counts_equal_the_pairs(spark):
    from textloom.operators import duplicates

    rnd = random.Random(4)
    made = [(k, "busy" if rnd.random() < 0.9 else rnd.choice(["", "b", "c", None]), rnd.choice([None, *(f"2024-01-{d:02d}" for d in range(1, 28))])) for k in range(600)]
    items = spark.createDataFrame(made, "doc_id long, person_name string, publish_date string").repartition(4)
    wanted = duplicates.candidate_pairs(items).groupBy("a").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, duplicates.candidate_counts(items).collect())) == sorted(map(tuple, wanted.collect()))
