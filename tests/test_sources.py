"""Parsers, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import transcripts as S
from textloom.streaming import activity as A


def lines(spark, *rows):
    return spark.createDataFrame([("i", k, x) for k, x in enumerate(rows)], "item_id string, line_no long, line string")


def test_stamped(spark):
    d = S.stamped_turns(lines(spark, "preamble", "0:00:05 Ann", "hello", "", "there", "0:01:00", "no label", "0:02:00 Bob")).orderBy("turn_index")
    assert [(r.speaker_name, r.timestamp, r.content) for r in d.collect()] == [("Ann", "0:00:05", "hello there"), (None, "0:01:00", "no label")]


def test_labelled(spark):
    d = S.labelled_turns(lines(spark, "Ann: hi", "**Bob:** well", "once: more text", "Ann: so", "on it goes", "**Bob**: ok")).orderBy("turn_index")
    assert [(r.speaker_name, r.content) for r in d.collect()] == [("Ann", "hi"), ("Bob", "well more text"), ("Ann", "so on it goes"), ("Bob", "ok")]
    assert S.labelled_turns(lines(spark, "Plain prose here.", "Note: only once")).count() == 0
    long = "one two three four five six: x"
    assert {r.speaker_name for r in S.labelled_turns(lines(spark, long, "A: 1", long, "B:", "2", "A: 3", "B: 4")).collect()} == {"A", "B"}


def test_formats(spark):
    both = spark.createDataFrame(
        [("a", 0, "00:00:04 Speaker 1"), ("a", 1, "Ann: well"), ("a", 2, "00:00:08 Speaker 2"), ("a", 3, "Ann: yes"), ("b", 0, "L: one"), ("b", 1, "X: two"), ("b", 2, "L: three"), ("b", 3, "X: four"), ("c", 0, "prose")], "item_id string, line_no long, line string"
    )
    got = {(r.item_id, r.format) for r in S.transcript_turns(both).collect()}
    assert got == {("a", "timestamped"), ("b", "labeled")}


def bridged_model(turns, most=8):
    """The rules walked over a list, block by block."""

    def joined(rows):
        out = []
        for speaker, text in rows:
            if out and out[-1][0] == speaker:
                out[-1][1] += " " + text
            else:
                out.append([speaker, text])
        return out

    blocks = joined([(s, (t or "").strip()) for s, t in turns if (t or "").strip()])
    short = [len(t.split()) <= most and not t.endswith("?") for _, t in blocks]
    done, i = [], 0
    while i < len(blocks):
        j = i
        while j < len(blocks) and short[j]:
            j += 1
        if i < j < len(blocks) and done and done[-1][0] == blocks[j][0]:
            done[-1][1] += " " + blocks[j][1]
            done += blocks[i:j]
            i = j + 1
        elif i < j:
            done += blocks[i:j]
            i = j
        else:
            done.append(blocks[i])
            i += 1
    return [tuple(x) for x in joined(done)]


def test_bridging(spark):
    import random

    say = "this is a long answer with more than eight words in it"
    cases = {
        "relief": [("L", "And was that a relief or was it kind of unsettling?"), ("X", say), ("L", "Right, right."), ("X", say), ("L", "Can you say more?")],
        "run": [("A", say), ("B", "yes"), ("C", "hm"), ("A", say)],
        "chain": [("A", say), ("B", "yes"), ("A", say), ("C", "no"), ("B", say), ("A", "so"), ("C", say)],
        "question": [("A", say), ("B", "why?"), ("A", say)],
        "ends": [("B", "yes"), ("A", say), ("B", "no")],
        "blank": [("A", None), ("A", " \n\t"), (None, "x")],
        "nulls": [(None, say), ("B", "yes"), (None, say)],
    }
    rng = random.Random(4)
    for k in range(150):
        cases[f"r{k}"] = [(rng.choice(["A", "B", "C", None]), rng.choice([say + str(i), "short one", "ok", "what?", "", None, say])) for i in range(rng.randint(1, 40))]
    rows = [(item, i, s, t, f"t{i}") for item, turns in cases.items() for i, (s, t) in enumerate(turns)]
    rng.shuffle(rows)
    found = {}
    for r in S.bridge_backchannels(spark.createDataFrame(rows, "item_id string, turn_index long, speaker_name string, content string, timestamp string")).orderBy("item_id", "turn_index").collect():
        own = found.setdefault(r.item_id, [])
        assert r.turn_index == len(own) and r.timestamp
        own.append((r.speaker_name, r.content))
    for item, turns in cases.items():
        assert found.get(item, []) == bridged_model(turns), item
    assert found["relief"][1] == ("X", say + " " + say) and found["run"] == [("A", say + " " + say), ("B", "yes"), ("C", "hm")]


def docx(path, *paragraphs):
    import zipfile

    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in p)}</w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}<w:sectPr/></w:body></w:document>')


def test_files_to_records(spark, tmp_path):
    docx(tmp_path / "a.docx", ["00:00:01 ", "Ann"], ["Well &amp; good"], [], ["00:00:05"], ["hm"])
    (tmp_path / "b.txt").write_bytes("L: one\r\nX: two\x0bL: three\nX: four é\n".encode())
    (tmp_path / "c.pdf").write_text("no transcript")
    rows = S.read_lines(spark, str(tmp_path))
    own = {i: [r.line for r in rows.filter(F.col("item_id").endswith(i)).orderBy("line_no").collect()] for i in ("a.docx", "b.txt")}
    assert own == {"a.docx": ["00:00:01 Ann", "Well & good", "", "00:00:05", "hm"], "b.txt": ["L: one", "X: two", "L: three", "X: four é"]}
    turns = S.assign_roles(S.transcript_turns(rows), {"Ann": "subject", "L": "interviewer"}, "interviewer")
    about = rows.select("item_id").distinct().select("item_id", F.lit("g").alias("group_name"), F.lit(None).cast("string").alias("person_name"), F.lit(None).cast("string").alias("person_title"), F.lit("t").alias("item_title"), F.lit("2024-01-02").alias("publish_date"), F.when(F.col("item_id").endswith(".txt"), "own").alias("record_id"))
    records = {r.item_id: r for r in S.transcript_records(turns, about).collect()}
    import hashlib

    made = hashlib.sha1(b"g||t|2024-01-02").hexdigest()[:10]
    assert set(records) == {"own", made}
    assert records[made].transcript_text == "[Ann] Well & good\n[Unknown] hm" and [t.speaker_role for t in records[made].turns] == ["subject", "interviewer"]
    assert records["own"].transcript_text.splitlines() == ["[L] one", "[X] two", "[L] three", "[X] four é"] and records["own"].turns[1].speaker_role == "other"


def test_items_and_pair(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"item_id": "1", "turns": [{"content": "x"}], "extra": 3}, {"item_title": "t"}]))
    items = S.read_items(spark, str(tmp_path / "d.json"))
    assert items.count() == 2 and S.missing_ids(items).count() == 1
    S.write_pair(items, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/csv")).count() == 2
    (tmp_path / "bad.json").write_text("[{]")
    with pytest.raises(Exception):  # noqa: B017
        S.read_items(spark, str(tmp_path / "bad.json")).collect()


def test_renamed_is_idempotent(spark):
    d = spark.createDataFrame([(1, "x")], "item_id long, company string")
    once = S.renamed(d, {"company": "group_name"})
    assert once.columns == S.renamed(once, {"company": "group_name"}).columns == ["item_id", "group_name"] and dict(once.dtypes)["item_id"] == "string"


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("action_type"), "value")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = A.windows(stream, late="10000 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, A.windows(e).collect()))
