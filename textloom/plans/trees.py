"""Depth-first order of forests by list ranking: rounds grow with the logarithm of a tree's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.graph import written

#: Where a tour ends, and where one ends that doesn't begin at a root.
END, LOST = "", "\x18"


def depth_first(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, id, position, depth) of the nodes that hang from their tree's root.

    ``roots``: tree, counts (whether the root takes a position); a root's id is
    the empty string.  ``nodes``: tree, id, parent (an id, empty for the root),
    key (the order of siblings; ties by id); an id is there once a tree.
    Positions are 0-based, parents before children, siblings in order.  Nodes
    whose parent is missing, or that hang from each other in a circle, are left
    out with all below them.

    A walk around a tree enters and leaves each node; both steps know the next
    one from the first child, the next sibling or the parent.  Each round joins
    every step to the one it points to and doubles how far it sees, adding up
    the nodes entered and the depth gained on the way, until all see the end.
    A round is one join of a written table; the plan doesn't grow.
    """
    by = Window.partitionBy("tree", "parent").orderBy("key", "id")
    kids = nodes.select("tree", "id", "parent", F.lead("id").over(by).alias("next"), F.lit(1).alias("counts"))
    first = nodes.groupBy("tree", F.col("parent").alias("id")).agg(F.min_by("id", F.struct("key", "id")).alias("first"))
    tops = roots.select("tree", F.lit("").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("next"), F.col("counts").cast("int").alias("counts"))
    every = kids.unionByName(tops).join(first, ["tree", "id"], "left")

    def step(node, sign):
        return F.concat("tree", F.lit("\x1f"), F.col(node), F.lit(sign))

    enter = F.struct(F.lit(True).alias("enters"), step("id", "<").alias("step"), F.coalesce(step("first", "<"), step("id", ">")).alias("to"), F.col("counts").cast("long").alias("n"), F.lit(1).cast("long").alias("up"))
    out = F.coalesce(step("next", "<"), step("parent", ">"), F.lit(END))
    leave = F.struct(F.lit(False).alias("enters"), step("id", ">").alias("step"), out.alias("to"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("up"))
    now = written(every.select("tree", "id", F.explode(F.array(enter, leave)).alias("s")).select("tree", "id", "s.*"))
    longest = now.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    reach = 1
    while reach < longest:  # a circle never ends, but no walk is longer than this
        on = F.col("to").isin(END, LOST)
        seen = now.select(F.col("step").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("up").alias("up2"))
        far = now.filter(~on).join(seen, "to", "left")
        far = far.select("tree", "id", "enters", "step", F.coalesce("to2", F.lit(LOST)).alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("up") + F.coalesce("up2", F.lit(0))).alias("up"))
        now, reach = written(now.filter(on).unionByName(far)), 2 * reach
    ended = now.filter((F.col("to") == END) & F.col("enters"))
    all_of = ended.filter("id = ''").select("tree", F.col("n").alias("total"))
    return ended.join(all_of, "tree").select("tree", "id", (F.col("total") - F.col("n")).alias("position"), (-F.col("up")).alias("depth"))
