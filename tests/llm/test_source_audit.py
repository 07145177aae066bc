"""The source audit against every pair over every kept term, and its edges."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import source_audit

SMALL = "/root/testdata/sf0.001"
CLASHES = ("term", "n", "docs", "p", "q", "base", "kept", "item", "value", "rank", "part", "total")


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def made(seed):
    rnd = random.Random(seed)
    words = ["the", "The", "a-b", "éa", "ÉA", "zz9zz", "x"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = []
    for _ in range(300):
        lang, source = rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["s1", "s1", "s1", "s2", "s3", "é", None])
        own = rnd.sample(words, 20)
        rows.append((" ".join(rnd.choice(own) for _ in range(rnd.randint(0, 30))), lang, source))
    return rows + [(None, "en", "only null"), ("", "fr", "s1"), ("1 2 3 !", "fr", "s2"), ("rare words here", "it", "s1"), ("same " * 5_000, "en", "s2"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", (1, 2))
def test_against_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").select("*", *(F.lit("x").alias(c) for c in CLASHES)).repartition(5)
    assert order(source_audit.audit(docs).collect()) == order(source_audit.brute_force(rows))


@pytest.mark.parametrize("top", (1, 7))
def test_ties_refine_by_bytes(spark, top):
    """Many equal values: the first by UTF-8 bytes are found without sorting a group."""
    rnd = random.Random(top)
    items = sorted({"".join(rnd.choice("aébz\U0001f600") for _ in range(rnd.randint(1, 9))) for _ in range(900)})
    rows = [(g, s, x, v) for g, s, v in (("en", "s", 5), ("en", "t", 1 << 58), ("", "", 0)) for x in items] + [("en", "t", "above", (1 << 58) + 1), ("one", "row", "x", 3)]
    found = source_audit.first_rows(spark.createDataFrame(rows, "lang string, source string, item string, value long"), top).collect()
    wanted = []
    for g in {r[:2] for r in rows}:
        mine = sorted((r for r in rows if r[:2] == g), key=lambda r: (-r[3], r[2].encode()))
        wanted += [(*r, k) for k, r in enumerate(mine[:top], 1)]
    assert order((r.lang, r.source, r.item, r.value, r["rank"]) for r in found) == order(wanted)


def test_tiles_and_matrices_add_up(monkeypatch):
    """Posting lists longer than a tile, and more sources than a matrix holds."""
    rnd = random.Random(3)
    lists = []
    for _ in range(40):
        found = rnd.sample(range(50), rnd.randint(2, 40))
        lists.append(("en", [f"s{i}" for i in found], [rnd.randint(1, 10**9) for _ in found], [rnd.randint(1, 50) for _ in found]))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lists)], names=["lang", "source", "p", "base"])

    def sums():
        out: dict = {}
        for b in source_audit._meet([batch]):
            for lang, s, i, v in zip(*b.to_pydict().values()):
                out[lang, s, i] = out.get((lang, s, i), 0) + v
        return {k: v for k, v in out.items() if v}

    whole = sums()
    monkeypatch.setattr(source_audit, "TILE", 7)
    monkeypatch.setattr(source_audit, "PAIRED", 20)
    assert sums() == whole


def test_no_rows(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_whole_table(spark):
    from textloom.llm.queries import op13_source_audit

    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert order(op13_source_audit(spark, SMALL).select("lang", "source", "part", "item", "value", "rank").collect()) == order(source_audit.brute_force(rows))
