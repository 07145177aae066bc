"""Exports and registry under readers, rival writers and failures."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from textloom.sources import committed
from textloom.sources import registry_files as R

SCHEMA = "item_id string, item_title string, turns array<struct<speaker_name:string,content:string>>"


def items(spark, first, n, parts=3):
    return spark.range(first, first + n, 1, parts).select(F.col("id").cast("string").alias("item_id"), F.concat(F.lit('say "é",\n'), "id").alias("item_title"), F.array(F.struct(F.lit("A").alias("speaker_name"), F.lit(None).cast("string").alias("content"))).alias("turns"))


def ids(df):
    return sorted(int(r.item_id) for r in df.select("item_id").collect())


def test_a_pair_reads_back(spark, tmp_path):
    path = str(tmp_path / "one")
    assert R.read_export(spark, path) is None and R.read_export(spark, path, schema=SCHEMA).count() == 0
    R.write_export(items(spark, 0, 40), path)
    json, csv = R.read_export(spark, path, schema=SCHEMA), R.read_export(spark, path, "csv")
    assert ids(json) == ids(csv) == list(range(40))
    assert {r.item_title for r in json.collect()} == {r.item_title for r in csv.collect()} == {f'say "é",\n{k}' for k in range(40)}
    assert json.first().turns[0].speaker_name == "A" and "turns" not in csv.columns
    R.write_export(items(spark, 0, 0), path)
    assert R.read_export(spark, path, schema=SCHEMA).count() == 0


def test_a_reader_never_sees_half_a_pair(spark, tmp_path):
    path, seen, stop = str(tmp_path / "one"), [], threading.Event()
    R.write_export(items(spark, 0, 5), path)

    def read():
        while not stop.is_set():
            parts = committed.latest(f"{path}/_manifest")[1]["parts"]
            seen.append([ids(committed.read_pair(spark, path, kind, None if kind == "csv" else SCHEMA, parts)) for kind in ("json", "csv")])

    t = threading.Thread(target=read)
    t.start()
    for k in range(1, 5):
        R.write_export(items(spark, 100 * k, 5), path)
    stop.set()
    t.join()
    assert seen and all(a == b and len(a) == 5 for a, b in seen)


def test_two_writers_lose_no_entry(spark, tmp_path):
    root = str(tmp_path)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: R.register(spark, root, id=f"d{k}", label=f"D{k}", kind="x", count=k, json_file=f"d{k}", csv_file=f"d{k}"), range(40)))
    assert sorted(r.id for r in R.load_registry(spark, root).collect()) == sorted(f"d{k}" for k in range(40))


def test_rival_appends_all_arrive_once(spark, tmp_path):
    root = str(tmp_path)
    R.write_export(items(spark, 0, 3), f"{root}/one")
    R.register(spark, root, id="q", label="Q — 3 interview(s)", kind="x", count=3, json_file="one", csv_file="one")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: R.append_dataset(spark, root, "q", items(spark, 10 * k, 4)), range(1, 5)))
    assert ids(R.read_export(spark, f"{root}/one", schema=SCHEMA)) == [0, 1, 2, *(10 * k + i for k in range(1, 5) for i in range(4))]
    entry = R.load_registry(spark, root).first()
    assert entry["count"] == 19 and entry.label == "Q — 19 interview(s)"
    with pytest.raises(ValueError, match="stand already"):
        R.append_dataset(spark, root, "q", items(spark, 22, 4))


def test_an_older_version_cannot_be_published_over_a_newer(spark, tmp_path):
    root = str(tmp_path / "x")
    committed.publish(spark, root, 1, {"a": 1})
    with pytest.raises(committed.Conflict):
        committed.publish(spark, root, 1, {"a": 2})
    assert committed.latest(root) == (1, {"a": 1}) and [f.name for f in (tmp_path / "x").iterdir()] == ["0000000001.json"]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "one")
    R.write_export(items(spark, 0, 5), path)
    bad = items(spark, 10, 9).withColumn("item_title", F.when(F.col("item_id") == "17", F.raise_error(F.lit("no more"))).otherwise(F.col("item_title")))
    with pytest.raises(Exception, match="no more"):
        R.write_export(bad, path)
    assert ids(R.read_export(spark, path, schema=SCHEMA)) == list(range(5)) and committed.latest(f"{path}/_manifest")[0] == 1
