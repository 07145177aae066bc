"""Substring dedup against a window-by-window comparison, and its edges."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import substring_dedup

SMALL = "/root/testdata/sf0.001"
CLASHES = ("key", "n", "start", "length", "b1", "least", "anchors", "known", "wanted", "at", "w1", "spans", "kept", "lang")


def made(seed):
    """Documents that share passages, edits and repeats in many ways."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "bé", "see", "x1", "end.", "Über"]) + str(rnd.randint(0, 900))
    prose = lambda n: [word() for _ in range(n)]
    base, common, rows = prose(700), prose(60), []
    for i in range(40):
        kind = i % 8
        if kind == 0:
            words = list(base)
            for _ in range(rnd.randint(0, 5)):
                words[rnd.randrange(len(words))] = word()
        elif kind == 1:
            words = prose(rnd.randint(0, 90)) + common + prose(rnd.randint(0, 90))
        elif kind == 2:
            words = common[: rnd.randint(45, 60)]
        elif kind == 3:
            words = prose(120) * 3
        elif kind == 4:
            a = rnd.randrange(600)
            words = prose(40) + base[a : a + rnd.randint(40, 100)] + prose(30) + base[100:160]
        elif kind == 5:
            words = ["la"] * rnd.randint(40, 200)
        else:
            words = prose(rnd.choice((0, 1, 49, 50, 51, 300)))
        rows.append((i * 3, rnd.choice((" ", "\n", "\t ")).join(words)))
    return rows


EDGES = [(None, None), (5, None), (6, ""), (7, " \x0b\x0c\r\n"), (8, "one")]


@pytest.mark.parametrize("seed", (1, 2))
def test_against_brute_force(spark, seed):
    rows = made(seed)
    long = " ".join(t for _, t in rows[:20])
    # Repeated rows, rows of one id with other texts, rows without id, a long text.
    rows += [rows[0], rows[8], (24, rows[1][1] + " and more"), (3, rows[9][1]), (None, rows[0][1]), (200, long), (201, "x " + long), *EDGES]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASHES)).repartition(5)
    found = substring_dedup.dedup(docs).collect()
    order = lambda x: sorted(x, key=repr)
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == order(substring_dedup.brute_force(rows))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(tuple(w.decode() for w in substring_dedup.words_of(t)))
    for r in found:
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed
        assert all(b < a for b, a in zip(r.spans[1::2], r.spans[2::2]))  # maximal: spans don't touch

        def without(words):
            gone = {p for a, b in zip(r.spans[::2], r.spans[1::2]) for p in range(a, b)}
            return " ".join(w for p, w in enumerate(words) if p not in gone)

        assert r.kept in {without(w) for w in texts[r.doc_id] if len(w) == r.n_words}


def test_one_text_of_a_single_word(spark):
    """Windows that are all equal, in a very long text too."""
    rows = [(1, "na " * 20_000), (2, "na " * 55), (3, "na " * 49)]
    found = {r.doc_id: r.n_removed for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 55, 3: 0}


def test_a_passage_in_most_documents(spark):
    """A group that holds most rows: the passage stays in the first only."""
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(str(rnd.random()) for _ in range(20))} {passage} {' '.join(str(rnd.random()) for _ in range(20))}") for i in range(1, 900)]
    found = {r.doc_id: r.n_removed for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert found == {i: 60 * (i > 1) for i in range(1, 900)}


def test_no_rows(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    from textloom.llm.queries import op11_substring_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op11_substring_dedup(spark, SMALL).collect()) == sorted(substring_dedup.brute_force(rows))
