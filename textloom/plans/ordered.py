"""Running sums and first rows of groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.graph import written

#: Buckets of a hash's histogram.
BUCKETS = 4_096


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``<name>_upto``, the sum of each of ``sums`` over the group's rows up to this one by ``order``, and ``<name>_all``, over all of them.

    Rows are dealt by ranges of (keys, order), so a large group spreads over
    many ranges; each range sums its own rows, and the totals of the ranges
    before it, one row a range and group, are added.  ``order`` must tell the
    rows of a group apart.  ``parts`` is the number of ranges (Spark's own, if
    not given).  No keys: all rows are one group.
    """
    by = [*(F.col(k) for k in keys), *order]
    dealt = written((rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "part").agg(*(F.sum(s).alias(f"{s}_part") for s in sums))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    totals = totals.select(*keys, "part", *(F.coalesce(F.sum(f"{s}_part").over(before), F.lit(0)).alias(f"{s}_before") for s in sums), *(F.sum(f"{s}_part").over(every).alias(f"{s}_all") for s in sums))
    here = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.select("*", *(F.sum(s).over(here).alias(f"{s}_here") for s in sums))
    same = [own[k].eqNullSafe(totals[k]) for k in keys] + [own["part"] == totals["part"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = own.join(totals, condition)
    return joined.select(*(own[c] for c in rows.columns), *((F.col(f"{s}_here") + F.col(f"{s}_before")).alias(f"{s}_upto") for s in sums), *(f"{s}_all" for s in sums))


def first_by_hash(rows: DataFrame, keys: list[str], hashed: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each group by a 64-bit hash (and the rest of the row, should hashes tie).

    A histogram of the hash by group tells in which bucket the last one lies;
    only rows up to that bucket are ranked, little more than ``most`` a group.
    """
    d = rows.withColumn("hash_", hashed).withColumn("bucket_", F.shiftrightunsigned(F.col("hash_").bitwiseXOR(F.lit(-(1 << 63))), 64 - (BUCKETS.bit_length() - 1)))
    sums = Window.partitionBy(*keys).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = d.groupBy(*keys, "bucket_").agg(F.count("*").alias("n_")).withColumn("upto_", F.sum("n_").over(sums))  # BUCKETS rows a group at most
    last = counted.filter(F.col("upto_") - F.col("n_") < most).groupBy(*keys).agg(F.max("bucket_").alias("last_"))
    near = d.join(last, keys).filter("bucket_ <= last_")
    rank = Window.partitionBy(*keys).orderBy("hash_", *(c for c in rows.columns if c not in keys))
    return near.withColumn("nth_", F.row_number().over(rank)).filter(F.col("nth_") <= most).select(*rows.columns)
