"""Structured Streaming over the activity log: an extra beyond the batch operators.

``windows`` counts actions per event-time window with a watermark; late rows
beyond it are dropped by Spark.  Labels from a stream are in ``label_state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(activity: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums of actions by window and type; works on a stream and on a table."""
    d = activity.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", late) if d.isStreaming else d
    g = d.groupBy(F.window("ts", size).alias("w"), "action_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "action_type", "n", "total")
