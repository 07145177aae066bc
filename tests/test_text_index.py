"""The inverted index against searches that read every text."""

import re

import pytest
from pyspark.sql import functions as F

from textloom.operators.corpus import search
from textloom.registry import canonical
from textloom.sources import text_index

SMALL = "/root/testdata/sf0.001"
ODD = [("x1", "Don't stop — the  the end. the end"), ("x2", "The\nend; é́a ÉA_b don t"), ("x3", None), ("x4", ""), ("x5", "THE END the end, the end"), ("x6", "mother-in-law mother in law a.b.c"), ("x7", "the the the end the")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    items = canonical(spark, SMALL, "items").select("item_id", "transcript_text").unionByName(spark.createDataFrame(ODD, "item_id string, transcript_text string"))
    path = str(tmp_path_factory.mktemp("index"))
    text_index.build(items, path)
    return items.cache(), path


@pytest.mark.parametrize("term", ("que", "The end", "the the", "don't", "mother-in-law", "in", "the the end", "a.b.c", "ÉA_b", "of the", "nowhere at all", "the", "de la"))
def test_whole_words(spark, index, term):
    items, path = index
    assert sorted(r.key for r in text_index.whole_words(spark, path, term).collect()) == sorted(r.item_id for r in search(items, term, whole_word=True).collect())


def test_counts(spark, index):
    items, path = index
    found = {r.key: r.n for r in text_index.whole_words(spark, path, "the end").collect()}
    texts = {r.item_id: r.transcript_text for r in items.collect()}
    assert found == {k: n for k, t in texts.items() if (n := len(re.findall(r"(?<!\w)the end(?!\w)", (t or "").lower())))}
    found = {r.key: r.n for r in text_index.inside_words(spark, path, "th").collect()}
    assert found == {k: n for k, t in texts.items() if (n := (t or "").lower().count("th"))}


def test_only_the_words_buckets_are_read(spark, index):
    _, path = index
    rows = text_index.places(spark, path, ["que", "the"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters: [In(word" in plan
    read = {re.search(r"bucket=(\d+)", r[0])[1] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert len(read) <= 2


def test_terms_that_the_index_cannot_answer(spark, index):
    for term in ("", "(the", "the.", "a" + " " * 40 + "b"):
        with pytest.raises(ValueError):
            text_index.whole_words(spark, index[1], term)
    with pytest.raises(ValueError):
        text_index.inside_words(spark, index[1], "the end")
