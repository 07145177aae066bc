"""Labels from a stream: any order, repeats, restarts and expiry."""

import random
from datetime import datetime, timedelta

import pytest

from textloom import operators  # noqa: F401
from textloom.registry import QUERIES, canonical
from textloom.streaming import label_state as L

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stream_session(spark):
    """RocksDB state, and few partitions."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if old:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def drop(spark, rows, folder, k):
    spark.createDataFrame(rows, L.EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/part={k}")


def run(spark, folder, late=None):
    events = spark.readStream.schema(L.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    L.write_changes(L.label_changes(events, late), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return L.current_labels(spark.read.parquet(f"{folder}/out"))


def test_shuffled_batches_and_a_restart_equal_the_tables(stream_session, tmp_path):
    spark = stream_session
    codes, negatives = (canonical(spark, SMALL, t) for t in ("codes", "negatives"))
    events = [tuple(r) for r in L.label_events(codes, negatives).collect()]
    rnd = random.Random(1)
    rows = events + rnd.sample(events, len(events) // 3)  # repeats
    rnd.shuffle(rows)
    parts = [rows[k::4] for k in range(4)]
    for k in (0, 1):
        drop(spark, parts[k], tmp_path, k)
    run(spark, tmp_path)
    for k in (2, 3):
        drop(spark, parts[k] + [(None, "t", "c", datetime(2024, 1, 1), 1, "code"), ("s", "t", "c", datetime(2024, 1, 1), 1, "other")], tmp_path, k)
    found = run(spark, tmp_path)  # the query goes on from its checkpoint
    wanted = QUERIES["d8_label_state"](spark, SMALL)
    key = lambda r: (r.segment_id, r.theme_id, r.coder)
    assert sorted((*key(r), r.state, r.n) for r in found.collect()) == sorted((*key(r), r.state, r.n) for r in wanted.collect())


def test_late_events_are_dropped_and_removed_labels_expire(stream_session, tmp_path):
    spark, day = stream_session, lambda k: datetime(2024, 1, 1) + timedelta(days=k)
    batches = [
        [("a", "t", "c", day(0), 1, "code"), ("a", "t", "c", day(1), 2, "uncode"), ("b", "t", "c", day(0), 3, "code"), ("b", "t", "c", day(2), 4, "reject")],
        [("z", "t", "c", day(60), 5, "code")],
        [("z", "t", "c", day(61), 6, "uncode")],
        [("a", "t", "c", day(0), 7, "reject"), ("b", "t", "c", day(1), 8, "code")],  # far too late
        [("a", "t", "c", day(62), 9, "code"), ("b", "t", "c", day(62), 10, "code")],
    ]
    for k, rows in enumerate(batches):
        drop(spark, rows, tmp_path, k)
        found = run(spark, tmp_path, "10 days")
    found = {r.segment_id: (r.state, r.n) for r in found.collect()}
    # a was forgotten, so its count begins anew; b never was taken off, so it stayed.
    assert found == {"a": ("code", 1), "b": ("code", 3), "z": ("uncode", 2)}
