"""Pairs of similar word sets, by rare words that both must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What rounding may add or take.
EPS = 1e-9


def _least_words(n: Column, share: float) -> Column:
    return F.ceil(n * share - EPS)


def _prefixes(sets: DataFrame, counts: DataFrame, least: float, side: str) -> DataFrame:
    """Of each set its rarest words, as many as two sets need so that they must share one: g, w, and the set's id, size and the word's place."""
    rows = sets.filter(F.size("words") > 0).select("g", "id", F.size("words").alias("n"), F.explode("words").alias("w")).join(counts, "w")
    d = rows.withColumn("at", F.row_number().over(Window.partitionBy("g", "id").orderBy("sets", "w")))
    d = d.filter(F.col("at") <= F.col("n") - _least_words(F.col("n"), least) + 1)
    return d.select("g", "w", F.col("id").alias(f"id_{side}"), F.col("n").alias(f"n_{side}"), F.col("at").alias(f"at_{side}"))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(g, a, b) of the pairs that may reach ``least``: a rare word is shared, the sizes allow it,
    and so do the words behind the shared one."""
    counts = left.select("words").unionByName(right.select("words")).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("sets"))
    j = _prefixes(left, counts, least, "a").join(_prefixes(right, counts, least, "b"), ["g", "w"])
    sizes = (F.col("n_b") >= _least_words(F.col("n_a"), least)) & (F.col("n_a") >= _least_words(F.col("n_b"), least))
    # At the first word that two sets share, no word before it is in both.
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + 1
    return j.filter(sizes & (rest >= _least_words(F.col("n_a") + F.col("n_b"), least / (1 + least)))).select("g", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def similar_sets(left: DataFrame, right: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(g, a, b, similarity) of sets of one group with a Jaccard similarity of ``least`` or more.

    ``left`` and ``right``: g, id (each id once a group), words (no word twice).  Without
    ``right`` the sets are compared with each other, a before b.  Sets meet at
    rare words, not in their group, so a large group costs no more than its
    similar sets; empty sets are like none.  Each pair that meets is computed
    over whole sets.
    """
    pairs = candidates(left, left, least).filter("a < b") if right is None else candidates(left, right, least)
    other = left if right is None else right
    x = left.select("g", F.col("id").alias("a"), F.col("words").alias("x"))
    y = other.select("g", F.col("id").alias("b"), F.col("words").alias("y"))
    d = pairs.distinct().join(x, ["g", "a"]).join(y, ["g", "b"])
    both = F.size(F.array_intersect("x", "y"))
    d = d.select("g", "a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
    return d.filter(F.col("similarity") >= least)
