"""Transcript parsers as table functions of SQL.

    select * from stamped_turns(table(lines) partition by item_id order by line_no)
    select * from labelled_turns(table(lines_with_labels) partition by item_id order by line_no)

A function sees an item's lines one by one, in order, and keeps the open turn
only, so an item of any length passes through.  The rows are those of
``transcripts.stamped_turns`` and ``transcripts.labelled_turns``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from textloom.functions import text as T
from textloom.sources.transcripts import LABELLED

TURNS = "item_id string, turn_index long, speaker_name string, timestamp string, content string"


class _Turns:
    """The open turn of an item: a header begins a new one, other lines go on it."""

    def __init__(self):
        self.item, self.index, self.speaker, self.stamp, self.said = None, -1, None, None, []

    def head(self, item, speaker, stamp):
        yield from self.close()
        self.item, self.index, self.speaker, self.stamp, self.said = item, self.index + 1, speaker, stamp, []

    def say(self, line):
        if line and self.index >= 0:
            self.said.append(line)

    def close(self):
        if self.said:
            yield self.item, self.index, self.speaker, self.stamp, " ".join(self.said)
        self.said = []


class StampedTurns:
    """Lines (item_id, line_no, line) to turns: H:MM:SS and a label begin one."""

    def __init__(self):
        import re

        self.turns = _Turns()
        self.stamp = re.compile(r"([0-9]{1,2}:[0-9]{2}:[0-9]{2})(.*)\Z")

    def eval(self, row: Row):
        line = (row["line"] or "").strip()
        found = self.stamp.match(line)
        if found:
            yield from self.turns.head(row["item_id"], found.group(2).strip() or None, found.group(1))
        else:
            self.turns.say(line)

    def terminate(self):
        yield from self.turns.close()


class LabelledTurns:
    """Lines (item_id, line_no, line, label, said, known) to turns: a label that the item knows begins one."""

    def __init__(self):
        self.turns = _Turns()

    def eval(self, row: Row):
        if row["label"] is not None and row["label"] in row["known"]:
            yield from self.turns.head(row["item_id"], row["label"], None)
        self.turns.say(row["said"])

    def terminate(self):
        yield from self.turns.close()


def with_labels(lines: DataFrame, least: int = 2, most_words: int = 5) -> DataFrame:
    """Lines with their labels and those that their item knows, for ``labelled_turns``: seen ``least`` times, two at least."""
    d = lines.select("item_id", "line_no", T.strip("line").alias("line")).filter("line <> ''")
    label = T.strip(F.regexp_extract("line", LABELLED, 1))
    d = d.withColumn("label", F.when((label != "") & (T.word_count(label) <= most_words), label))
    d = d.withColumn("said", F.when(F.col("label").isNotNull(), T.strip(F.regexp_extract("line", LABELLED, 2))).otherwise(F.col("line")))
    known = d.filter("label is not null").groupBy("item_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return d.join(known.groupBy("item_id").agg(F.collect_list("label").alias("known")).filter("size(known) >= 2"), "item_id")


def register(spark: SparkSession) -> None:
    """Makes ``stamped_turns`` and ``labelled_turns`` known to the session's SQL."""
    spark.udtf.register("stamped_turns", udtf(StampedTurns, returnType=TURNS))
    spark.udtf.register("labelled_turns", udtf(LabelledTurns, returnType=TURNS))
