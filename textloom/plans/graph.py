"""Connected components by large-star and small-star rounds over written tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are broadcast, at most, and edges that any node may have without being one of them.
HOT_KEYS, HOT_ROWS = 10_000, 200
#: Whether the files of an execution's shuffles are removed at its end, not when the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder: the one that
    ``spark.checkpoint.dir`` names; only a local session, whose executors see
    the driver's disk, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"/tmp/textloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"


def written(df: DataFrame, clean: bool = False) -> DataFrame:
    """``df`` in the shared checkpoint folder, read again: the lineage is cut and executors may be lost.  ``clean``: its shuffles' files go when it is written."""
    path = new_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO)
    if clean:
        conf.set(SHUFFLES_GO, "true")
    try:
        # A new plan, for it takes the setting when it is made.
        df.select("*").write.parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _least_beside(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours; nodes with very many edges are looked up in a broadcast of bounded size."""
    stars = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
    many = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)  # so at most HOT_KEYS nodes
    if stars.filter(many).isEmpty():
        return edges.join(stars.drop("n"), "u")
    hot = F.broadcast(stars.filter(many).drop("n"))
    return edges.join(hot, "u").unionByName(edges.join(hot.select("u"), "u", "left_anti").join(stars.filter(~many).drop("n"), "u"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v); root is the least node it can reach."""
    measure = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    edges = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = edges.agg(*measure).first()
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        large = written(_least_beside(both, 2 * before[0]).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _least_beside(large, large.count())
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m"))).filter("u <> v").distinct())
        now = edges.agg(*measure).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError("components did not settle")
