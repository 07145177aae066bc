"""Current labels from a stream of label events, by keyed state.

An event says that a coder put a code on a segment, took it off, rejected it or
took the rejection back.  Code and rejection of one coder exclude each other:
the last event by (at, seq) decides, in whatever order events come.  The state
of a label (segment, theme, coder) is its deciding event and the events seen, so
that repeated ones don't count twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEY = ["segment_id", "theme_id", "coder"]
EVENTS = "segment_id string, theme_id string, coder string, at timestamp, seq long, kind string"
#: What the fold returns; times are microseconds inside it.
CHANGES = "segment_id string, theme_id string, coder string, state string, micros long, seq long, n long"
#: Events that put a label on, and those that take it off.
ON, OFF = ("code", "reject"), ("uncode", "unreject")
#: The provider that keyed state of this kind needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def label_events(codes: DataFrame, negatives: DataFrame) -> DataFrame:
    """The events that the two label tables stand for: a row's making, and its deletion."""

    def events(rows, number, at, odd, kind):
        return rows.filter(F.col(at).isNotNull()).select(*KEY, F.col(at).cast("timestamp").alias("at"), (2 * F.col(number) + odd).alias("seq"), F.lit(kind).alias("kind"))

    d = events(codes, "code_id", "created_at", 0, "code").unionByName(events(codes, "code_id", "deleted_at", 1, "uncode"))
    return d.unionByName(events(negatives, "negative_id", "created_at", 0, "reject")).unionByName(events(negatives, "negative_id", "deleted_at", 1, "unreject"))


class LabelState(StatefulProcessor):
    """Folds a label's events.

    With event time, a label that was taken off is forgotten once the watermark
    has passed its last event: all that could change it comes too late and is
    dropped before it gets here.
    """

    def __init__(self, forget: bool):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "kind string, micros long, seq long")
        self.seen = handle.getMapState("seen", "kind string, seq long", "micros long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        n = self.count.get()[0] if self.count.exists() else 0
        before = n
        for r in rows:
            if self.seen.containsKey((r.kind, r.seq)):
                continue
            self.seen.updateValue((r.kind, r.seq), (r.micros,))
            n += 1
            if last is None or (r.micros, r.seq, r.kind) > (last[1], last[2], last[0]):
                last = (r.kind, r.micros, r.seq)
        if n == before:
            return
        self.last.update(tuple(last))
        self.count.update((n,))
        if self.forget:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if last[0] in OFF:
                self.handle.registerTimer(last[1] // 1000 + 1)
        yield Row(segment_id=key[0], theme_id=key[1], coder=key[2], state=last[0], micros=last[1], seq=last[2], n=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        self.count.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def label_changes(events: DataFrame, late: str | None = None) -> DataFrame:
    """A stream of a label's state, deciding event and number of events, whenever its events change it.

    ``events`` is a stream of ``EVENTS``; events without a key, a time, a number
    or a known kind go.  Repeated events (same kind and number) change nothing.
    Without ``late`` events may come in any order and the state of every label
    stays; with it (say "30 days") events older than the watermark are dropped,
    and labels that were taken off expire, after which ``n`` counts anew.
    """
    good = events.select(*(F.col(c.split()[0]) for c in EVENTS.split(", "))).na.drop().filter(F.col("kind").isin(*ON, *OFF))
    good = good.withColumn("micros", F.unix_micros("at"))
    if late:
        good = good.withWatermark("at", late)
    found = good.groupBy(*KEY).transformWithState(LabelState(late is not None), CHANGES, "Update", "EventTime" if late else "None")
    return found.select(*KEY, "state", F.timestamp_micros("micros").alias("at"), "seq", "n")


def write_changes(changes: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a query that appends each batch's changes under ``path``; a batch that is run again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_labels(written: DataFrame) -> DataFrame:
    """Of the changes that ``write_changes`` appended, each label's newest: its state and the events it comes from."""
    return written.groupBy(*KEY).agg(F.max_by(F.struct("state", "n"), "batch").alias("r")).select(*KEY, "r.*")
