"""Helpers shared by the operators: table access, shared scratch tables, sizes."""

from __future__ import annotations

import re
import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``: other columns go, a null text becomes empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names in
    ``spark.checkpoint.dir``.  Where that is unset there is no folder that the
    driver and all executors are sure to share, so it's an error; a local
    session (tests) has a folder of its own machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"/tmp/textloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"


#: Characters of a plan's description that Spark keeps, where the session sets nothing else.
PLAN_TEXT = 8_192


def short_plans(spark: SparkSession) -> None:
    """Spark keeps the descriptions of the last 1,000 plans in the driver's
    memory; those of long expressions take hundreds of kilobytes each.  Shorter
    ones are enough, unless the session asks for more."""
    if spark.conf.get("spark.sql.maxPlanStringLength").startswith("2147483"):  # Spark's own
        spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and
    survives lost executors."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that join_hot broadcasts, at most; rows that any key may have without being one of them.
HOT_KEYS, HOT_ROWS = 10_000, 200


def join_hot(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``keys``, which has one row a key and ``n``, the key's number of rows.

    ``total`` is the number of all rows, so at most ``HOT_KEYS`` keys have over
    ``total / HOT_KEYS`` of them: those are broadcast, and their rows stay where
    they are.  The rest is shuffled, and no key of it is large.  Rows without a
    match go.  ``keys`` should be a written table: it's read twice.
    """
    many = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    if keys.filter(many).isEmpty():
        return rows.join(keys, key)
    hot = F.broadcast(keys.filter(many))
    rest = rows.join(hot.select(key), key, "left_anti").join(keys.filter(~many), key)
    return rows.join(hot, key).unionByName(rest)


def strings(column):
    """The values of an Arrow column, as Python objects a few hundred at a time."""
    for a in range(0, len(column), 256):
        yield from column.slice(a, 256).to_pylist()


def slices(batches, rows: int = 256):
    """Arrow batches of at most so many rows."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.slice(a, rows)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus`` is ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _steps(counted: DataFrame, n: str) -> list:
    """Rows by eighths of powers of two of ``n``, the largest first: some hundred (rows, least)."""
    steps = counted.groupBy(F.floor(F.log2(n) * 8).cast("int").alias("step")).agg(F.count("*").alias("rows"), F.min(n).alias("least")).collect()
    return sorted(steps, key=lambda r: -r.step)


def frequent(counted: DataFrame, limit: int, n: str = "n") -> int:
    """The least count that at most ``limit`` rows of ``counted`` reach."""
    least, total = 1 << 62, 0
    for r in _steps(counted, n):
        total += r.rows
        if total > limit:
            break
        least = r.least
    return least


def reached(counted: DataFrame, wanted: int, n: str = "n") -> float:
    """A value of ``n`` that ``wanted`` rows reach (all, if there are fewer) and not many more."""
    least, total = 0.0, 0
    for r in _steps(counted, n):
        least, total = r.least, total + r.rows
        if total >= wanted:
            break
    return least


def worker_cache(name, make):
    """What ``make()`` gave when this Python worker first asked for ``name``.

    A worker keeps one such thing: one of another name takes its place, so the
    caches of operators that ran before don't stay in memory.
    """
    kept = sys.modules.setdefault("_textloom_worker", types.ModuleType("_textloom_worker")).__dict__
    if kept.get("kept_name") != name:
        kept.update(kept_name=None, kept=None)
        kept.update(kept=make(), kept_name=name)
    return kept["kept"]
