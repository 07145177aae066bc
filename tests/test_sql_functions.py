"""SQL functions against their Column forms, and the parsers as table functions."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import sql
from textloom.functions import text as T
from textloom.operators.ranking import wilson
from textloom.registry import canonical
from textloom.sources import transcripts as S
from textloom.sources import turn_functions

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    turn_functions.register(spark)
    return spark


def test_functions_equal_their_columns(session):
    docs = session.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(session.createDataFrame([(-1, None), (-2, ""), (-3, "  a b?\x85 Éa!  c_d  ")], "doc_id long, text string"))
    docs.createOrReplaceTempView("some_docs")
    ours = session.sql("select doc_id, strip_text(text) a, word_count(text) b, text_tokens(text) c, content_tokens(text) d, text_sentences(text) e, text_words(text) f from some_docs")
    forms = docs.select("doc_id", T.strip("text").alias("a"), T.word_count("text").alias("b"), T.tokens("text").alias("c"), T.content_tokens("text").alias("d"), T.sentences(F.col("text")).alias("e"), T.words("text").alias("f"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, forms.collect()))


def test_wilson(session):
    rows = session.range(30).select((F.col("id") % 6).alias("k"), (F.col("id") % 6 + F.col("id") % 5).alias("n"))
    rows.createOrReplaceTempView("trials")
    low, high = wilson(F.col("k"), F.col("n"))
    near = lambda r: tuple(None if x is None else round(x, 9) for x in r)
    ours = session.sql("select wilson_low(k, n) low, wilson_high(k, n) high from trials")
    assert sorted(map(near, ours.collect()), key=repr) == sorted(map(near, rows.select(low, high).collect()), key=repr)
    assert session.sql("select round(wilson_low(8, 10), 2), round(wilson_high(8, 10), 3), wilson_low(0, 0), f1_score(2, 1, 1), jaccard(array('a', 'b'), array('b', 'c', 'd'))").first()[:] == (0.49, 0.943, None, 4 / 6, 0.25)


def test_no_call_is_left_in_the_plan(session):
    session.read.parquet(f"{SMALL}/documents.parquet").createOrReplaceTempView("some_docs")
    plan = session.sql("select word_count(text) n, size(content_tokens(text)) c, wilson_low(doc_id, 1000) w from some_docs")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "python" not in plan and not any(f"{name}(" in plan for name in sql.FUNCTIONS if name != "jaccard")


def ordered(rows):
    return sorted((r.item_id, r.turn_index, r.speaker_name or "", r.timestamp or "", r.content) for r in rows)


def test_table_functions_equal_the_parsers(session):
    rnd = random.Random(2)
    parts = ["0:00:05 Ann", "1:02:03", "12:00:00\tBob Ray ", "hello there", "", "  ", "Ann: hi", "**Bob:** well", "**Bob**: ok", "once: more", "Ann:", "a: b: c", "0:0:05 no", "x "]
    rows = [(f"i{k}", n, rnd.choice(parts)) for k in range(60) for n in range(rnd.randint(0, 25))]
    rnd.shuffle(rows)
    lines = session.createDataFrame(rows, "item_id string, line_no long, line string").repartition(3)
    lines.createOrReplaceTempView("lines")
    turn_functions.with_labels(lines).createOrReplaceTempView("lines_with_labels")
    found = session.sql("select * from stamped_turns(table(lines) partition by item_id order by line_no)")
    assert ordered(found.collect()) == ordered(S.stamped_turns(lines).collect()) and found.count() > 100
    found = session.sql("select * from labelled_turns(table(lines_with_labels) partition by item_id order by line_no)")
    assert ordered(found.collect()) == ordered(S.labelled_turns(lines).collect()) and found.count() > 100


def test_table_functions_on_the_conversations(session):
    from textloom.operators.sources_queries import _lines

    turns = canonical(session, SMALL, "turns")
    lines, labelled = _lines(turns, True), _lines(turns, False)
    lines.createOrReplaceTempView("lines")
    turn_functions.with_labels(labelled).createOrReplaceTempView("lines_with_labels")
    assert ordered(session.sql("select * from stamped_turns(table(lines) partition by item_id order by line_no)").collect()) == ordered(S.stamped_turns(lines).collect())
    assert ordered(session.sql("select * from labelled_turns(table(lines_with_labels) partition by item_id order by line_no)").collect()) == ordered(S.labelled_turns(labelled).collect())
