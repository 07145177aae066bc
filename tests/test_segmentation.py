"""The merge and split folds against a plain model, on random turns."""

import random
import re

from pyspark.sql import types as X

from textloom.operators.corpus import LONG, SHORT, TARGET, segment_all, segmented

SCHEMA = X.StructType([X.StructField("item_id", X.StringType()), X.StructField("turn_index", X.LongType()), X.StructField("speaker_name", X.StringType()), X.StructField("content", X.StringType()), X.StructField("speaker_role", X.StringType()), X.StructField("depth", X.IntegerType()), X.StructField("timestamp", X.StringType())])


def model(turns):
    blocks = []
    for i, speaker, text, *meta in turns:
        text = (text or "").strip()
        if not text:
            continue
        if blocks and blocks[-1]["speaker"] == speaker and len(blocks[-1]["text"].split()) < SHORT:
            blocks[-1]["text"] += " " + text
            blocks[-1]["turns"].append(i)
        else:
            blocks.append({"speaker": speaker, "text": text, "turns": [i], "meta": tuple(meta)})
    out = []
    for b in blocks:
        parts = [b["text"]]
        if len(b["text"].split()) > LONG:
            parts, now, size = [], [], 0
            for s in filter(None, re.split(r"(?<=[.!?])\s+", b["text"])):
                k = len(s.split())
                if now and size + k > TARGET:
                    parts.append(" ".join(now))
                    now, size = [], 0
                now.append(s)
                size += k
            parts.append(" ".join(now))
        out += [(b["speaker"], *b["meta"], p, len(p.split()), b["turns"]) for p in parts]
    return out


def check(spark, items):
    rows = [(item, *t) for item, turns in items.items() for t in turns]
    random.Random(2).shuffle(rows)
    found = {}
    for r in segmented(spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("item_id", "seg_index").collect():
        own = found.setdefault(r.item_id, [])
        assert r.segment_id == f"{r.item_id}:{len(own):04d}"
        own.append((r.speaker, r.speaker_role, r.depth, r.timestamp, r.text, r.word_count, list(r.turns)))
    for item, turns in items.items():
        assert found.get(item, []) == model(turns)


def test_random_turns(spark):
    """Items of 0 to 150 turns; a tenth blank in every way, words, sentences and long texts; speakers with and without a name."""
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "beta", "gamma.", "delta!", "écoute", "end?", "a b", "x\ny"])
    sentence = lambda: " ".join(word() for _ in range(rng.randint(3, 18))) + rng.choice([".", "!", "?", ".　", "."])
    items = {}
    for size in (0, 1, 2, 5, 20, 60, 150):
        for k in range(5):
            turns = []
            for i in range(size):
                kind = rng.random()
                if kind < 0.1:
                    text = rng.choice(["", "   ", None, "\n\t", "  \x1f"])
                elif kind < 0.5:
                    text = " ".join(word() for _ in range(rng.randint(1, 25)))
                else:
                    text = rng.choice(["", "\t", " "]) + " ".join(sentence() for _ in range(rng.randint(1, 8) if kind < 0.85 else rng.randint(15, 40)))
                turns.append((i, rng.choice(["Q", "A", "B", None]), text, rng.choice(["r", None]), rng.choice([0, 2, None]), f"0:{i}"))
            items[f"{size}_{k}"] = turns
    check(spark, items)


def test_many_turns_of_one_item(spark):
    """4,000 turns in one item, in runs of one speaker."""
    check(spark, {"long": [(i, "AB"[i // 7 % 2], f"w{i} and more." if i % 5 else "x " * 30, None, None, None) for i in range(4_000)]})


def test_segment_all(spark):
    turn = X.StructType([X.StructField(n, X.IntegerType() if n == "depth" else X.StringType()) for n in ("speaker_name", "speaker_id", "speaker_role", "depth", "timestamp", "content")])
    schema = X.StructType([*(X.StructField(n, X.StringType()) for n in ("item_id", "dataset_id", "group_name", "person_name")), X.StructField("turns", X.ArrayType(turn))])
    said = [("Q", "7", "interviewer", 0, "0:01", "well then"), ("Q", "8", "other", 1, "0:02", "go on"), ("A", None, "subject", 0, "0:03", " ")]
    (row,) = segment_all(spark.createDataFrame([("1", "d", "g", "p", said), ("2", "d", "g", "p", None), ("3", "d", "g", "p", [])], schema)).collect()
    assert (row.segment_id, row.text, row.speaker_id, row.speaker_role, row.depth, row.timestamp, row.turns, row.dataset_id, row.person_name) == ("1:0000", "well then go on", "7", "interviewer", 0, "0:01", [0, 1], "d", "p")
