"""Queries on tables that the smallest ones don't show: large ids, long texts, many rows."""

import duckdb
from conftest import plain
from pyspark.sql import functions as F

from textloom import operators, registry  # noqa: F401
from textloom.functions import text as T


def documents(spark, folder, rows):
    """A folder with a documents table of (doc_id, text, lang, source)."""
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    d.withColumn("n_chars", F.length("text").cast("long")).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def against_sql(spark, folder, name):
    """A query's rows and its SQL's over the tables of ``folder``, sorted."""
    df = registry.QUERIES[name](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    cursor = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cursor.description]
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    return ours, sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)


def test_sizes_of_large_ids(spark, tmp_path):
    ids = [0, 1, 9, 98, 99, 100, 99_930, 99_931, 100_000, 500_000, 1_500_000, 3_000_000]
    ours, theirs = against_sql(spark, documents(spark, tmp_path, [(i, "a b", "en", "src1") for i in ids]), "x20_display")
    assert ours == theirs


def test_clipped_texts_are_not_split_whole(spark):
    texts = ["", " ", "a", " a b", "a b ", "\ta b\n", "a b c", "  a b c", "a b c ", " a b c d e  f ", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.clip_words(F.col("t"), 2).alias("c"))
    for r in d.collect():
        w = (r.t or "").split()
        assert r.c == (" ".join(w[:2]) + " [...]" if len(w) > 2 else r.t)
    assert "regexp_extract_all" not in d._jdf.queryExecution().toString()


def test_counts_of_terms_stay_with_their_text(spark):
    """With a bounded vocabulary, texts are shuffled once by key, and no row of a text and term is."""
    from textloom.operators.duplicates import tfidf

    d = spark.createDataFrame([(k, f"alpha beta{k % 7} gamma{k}") for k in range(60)], "id long, t string")
    made = tfidf(d, "id", "t", max_features=20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = tfidf(d, "id", "t", max_features=20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "hashpartitioning(id" in plan and not any("term" in x and "id#" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert made.select("term").distinct().count() == 15 and abs(made.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).agg(F.max("s")).first()[0] - 1) < 1e-9


def test_codebook_examples_do_not_look_through_all_twins(spark, monkeypatch):
    """10,000 flagged passages in 5,000 pairs of twins."""
    import time

    from textloom.operators import codebook as C

    n = 10_000
    f = spark.range(n).select(F.lit("s__a").alias("theme_id"), F.format_string("d:%06d", "id").alias("segment_id"), F.col("id").alias("flag_id"), F.lit("x").alias("text"))
    groups = spark.range(n).select(F.lit("s__a").alias("theme_id"), F.format_string("d:%06d", "id").alias("segment_id"), F.format_string("d:%06d", F.col("id") - F.col("id") % 2).alias("kept"))
    themes = spark.createDataFrame([("s__a", None, "A", 0, "active")], "theme_id string, parent_theme_id string, name string, depth int, status string")
    monkeypatch.setattr(C, "flagged_rows", lambda *a: f)
    monkeypatch.setattr(C, "twin_pairs", lambda *a: None)
    monkeypatch.setattr(C, "twin_groups", lambda *a: groups)
    monkeypatch.setattr(C, "theme_counts", lambda *a: themes.select("theme_id"))
    monkeypatch.setattr(C, "theme_completeness", lambda *a: themes.select("theme_id", *(F.lit(True).alias(c) for c in C.CHECKS)))
    start = time.time()
    topic = C.codebook_topics(None, None, None, None, themes, None)[0]
    assert time.time() - start < 12
    assert len(topic["exemplars"]) == n // 2 and topic["exemplars"][1]["twin_segment_ids"] == ["d:000003"]


def test_sql_functions_on_odd_texts(spark, tmp_path):
    """Null and empty texts, ends of sentences at a text's end, white space and letters of all kinds."""
    texts = [None, "", " ", "a", "A. B. ", "a.\n", "a. b.  \t", "..  ..  ", "x.\x01 y", "a\x01b", "\f.\fx", "\u0130stanbul ab\u0130cd a\u0130b", "\u0870\u0871 \u08c8\u1d2b", "\U0001e2c0\U0001e2c1 \U00031350\U00031351"]
    texts += [f"x{c}y z.{c}w" for c in map(chr, [*range(1, 0x21), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xA7C0, 0xA7CB, 0xA7DC, 0x10570, 0x10FFFF])]
    ours, theirs = against_sql(spark, documents(spark, tmp_path, [(i, t, "en", "src1") for i, t in enumerate(texts)]), "x2_sql_functions")
    assert ours == theirs
