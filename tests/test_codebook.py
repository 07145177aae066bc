"""Theme events, marks, decisions, codebook documents, status, exemplars and training."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textloom import registry
from textloom.operators import codebook as C
from textloom.operators import labels, pilot, threads, training

SMALL = "/root/testdata/sf0.001"
THEMES = "theme_id string, scheme_id string, parent_theme_id string, name string, depth int, status string, created_at string"


@pytest.fixture(scope="module")
def themes(spark):
    return spark.createDataFrame([("s__a", "s", None, "A", 0, "active", "1"), ("s__b", "s", "s__a", "B", 1, "active", "1"), ("s__c", "s", "s__b", "C", 2, "active", "1"), ("t__x", "t", None, "X", 0, "active", "1")], THEMES)


def test_theme_rules(themes):
    for call in (
        lambda: C.create_theme(themes, "s", "  ", "2"), lambda: C.create_theme(themes, "s", "N", "2", "none"), lambda: C.create_theme(themes, "s", "N", "2", "t__x"), lambda: C.update_theme(themes, "none", name="x"),
        lambda: C.update_theme(themes, "s__a", parent_theme_id="s__a"), lambda: C.update_theme(themes, "s__a", parent_theme_id="s__c"), lambda: C.update_theme(themes, "s__a", parent_theme_id="t__x"),
    ):
        with pytest.raises(ValueError):
            call()
    moved = {r.theme_id: r.depth for r in C.update_theme(themes, "s__b", parent_theme_id=None).collect()}
    assert moved == {"s__a": 0, "s__b": 0, "s__c": 1, "t__x": 0}


def test_deep_closure_and_cycles(spark):
    t = spark.createDataFrame([(f"t{i}", f"t{i - 1}" if i else None) for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z")], "theme_id string, parent_theme_id string")
    rows = labels.closure(t).collect()
    assert len(rows) == 60 * 61 // 2 + 4 + 1
    assert max(r.dist for r in rows) == 59


def test_undo_only_the_newest(spark):
    d = spark.createDataFrame([(1, "a", "t", "c", "accept", "none"), (2, "a", "t", "c", "reject", "coded"), (3, "b", "t", "c", "skip", "rejected")], "decision_id long, segment_id string, theme_id string, coder string, decision string, prev_state string")
    got = {r.segment_id: r.state for r in C.label_after(d, d.filter("decision_id = 2")).collect()}
    assert got == {"a": "coded", "b": "rejected"}
    with pytest.raises(ValueError):
        C.label_after(d, d.filter("decision_id = 1"))


def test_codebook_version():
    topics = [{"topic_id": "a", "counts": {"n": 1}, "completeness": {}, "exemplars": [{"text": "é", "turn_indices": [1]}], "near_misses": []}]
    canonical = '[{"exemplars":[{"text":"é"}],"near_misses":[],"topic_id":"a"}]'
    assert C.codebook_version(topics) == "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()
    assert C.codebook_version([topics[0] | {"counts": {"n": 2}}]) == C.codebook_version(topics)


def test_codebook_files(spark, tmp_path):
    t = {n: registry.canonical(spark, SMALL, n) for n in ("codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", "auto_duplicates")}
    clusters = t["auto_duplicates"].select("dataset_id", "item_id", F.col("canonical_id").alias("cluster_id"))
    topics = C.codebook_topics(t["codes"], t["negatives"], t["item_reviews"], t["segments"], t["themes"], clusters)
    rows = C.codebook_labels(*(t[n] for n in ("codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes")), clusters)
    version = C.write_codebook(str(tmp_path / "x"), topics, rows, {"scheme_id": "s"})
    text = "".join(r[0] for r in spark.read.text(str(tmp_path / "x/codebook_topic_themes"), wholetext=True).collect())
    assert json.loads(text)["codebook_version"] == version and len(json.loads(text)["topics"]) == t["themes"].count()
    assert sum(x["topic_id"].startswith("s__") for x in json.loads(text)["topics"]) == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "x/codebook_labels")).count() == rows.count()


def test_log_page(spark, tmp_path):
    feed = C.activity_feed(*(registry.canonical(spark, SMALL, n) for n in ("log", "themes", "schemes", "run_params"))).limit(30)
    C.render_log(feed, str(tmp_path / "log"))
    page = "".join(r[0] for r in spark.read.text(str(tmp_path / "log"), wholetext=True).collect())
    assert page.count("<tr>") == 31 and "&quot;" in page


def test_close_round(spark):
    runs = spark.createDataFrame([("r1", "a", "2024-01-01"), ("r2", "a", "2024-02-01"), ("r3", "b", "2024-03-01")], "model_version string, theme_id string, trained_at string")
    ledger = spark.createDataFrame([(1, "2024-01-15", "retrain", "r1")], "decision_id int, created_at string, decision string, run_ref string")
    own = spark.createDataFrame([("a",)], "theme_id string")
    closed, of_round = C.close_round(ledger, runs, own, "accept", "r2", "2024-04-01")
    assert closed.count() == 2 and [(r.round_no, r.model_version) for r in of_round.collect()] == [(2, "r2")]
    assert C.withdraw_round(closed).count() == 1
    for kind, ref in (("odd", "r2"), ("accept", "r3")):
        with pytest.raises(ValueError):
            C.close_round(ledger, runs, own, kind, ref, "2024-04-01")


def test_status_machine():
    s = lambda *a, **k: threads.iteration_status(*a, **k)
    codes = lambda x: [c for c, _ in x["reasons"]]
    assert codes(s(None, "v", {}, 0)) == ["no_run"]
    accepted = s(None, "v", {}, 0, 2, {"decision": "accept"})
    assert codes(accepted) == ["accepted"] and accepted["round"] == 2 and set(accepted["steps"].values()) == {"done"}
    assert codes(s(None, "v", {}, 0, 1, {"decision": "refine_codebook", "codebook_version": "v"})) == ["refine_codebook"]
    assert codes(s(None, "w", {}, 0, 1, {"decision": "refine_codebook", "codebook_version": "v"})) == ["train_again"]
    assert codes(s(None, "v", {}, 0, 1, {"decision": "more_labels"})) == ["more_labels"] and codes(s(None, "v", {"codes_added": 1}, 0, 1, {"decision": "more_labels"})) == ["train_again"]
    run = {"model_version": "r", "codebook_version": "v"}
    fresh = s(run, "v", {}, 0)
    assert codes(fresh) == ["not_reviewed", "undecided"] and fresh["steps"]["review"] == "current"
    stale = s(run, "w", {"codes_added": 3, "marks_removed": 1}, 5)
    assert codes(stale) == ["codebook_changed", "labels_changed", "undecided"] and stale["changes"] == "3 codes added, 1 interview unmarked" and stale["steps"] == {"codebook": "done", "train": "stale", "review": "done", "decide": "todo"}
    assert s(run, "v", {}, 2)["steps"]["decide"] == "current"


def test_exemplars_one_after_another(spark):
    rows = [
        ("t", "a", "c1", "i1", True, 1, 50, True, 0.9, "alpha beta gamma"), ("t", "b", "c1", "i2", True, 1, 50, False, 0.8, "delta epsilon zeta"), ("t", "c", "c2", "i3", True, 1, 50, False, 0.3, "eta theta iota"), ("t", "d", "c1", "i2", True, 1, 50, False, 0.7, "kappa lambda mu"),
        ("t", "e", "c3", "i5", True, 1, 50, False, 0.2, "delta epsilon zeta more"), ("t", "f", "c4", "i6", False, 1, 50, False, 1.0, "not an answer"), ("t", "g", "c4", "i7", True, 2, 50, False, 1.0, "two themes"), ("t", "h", "c4", "i8", True, 1, 5, False, 1.0, "short"), ("u", "a", "c1", "i1", True, 1, 50, False, 0.1, "x y z"),
    ]
    d = spark.createDataFrame(rows, "theme_id string, segment_id string, company string, item_id string, answer_only boolean, n_themes int, words int, read_in_full boolean, oof double, text string")
    got = [(r.theme_id, r.segment_id) for r in pilot.choose_exemplars(d).orderBy("theme_id", "place").collect()]
    # Clean items first: b, then the new company c, then d; e is like b; a was read in full.
    assert got == [("t", "b"), ("t", "c"), ("t", "d"), ("t", "a"), ("u", "a")]


def test_recorded_answers(spark):
    asked = spark.createDataFrame([("k1", "one"), ("k2", "two")], "key string, text string")
    stored = spark.createDataFrame([("k1", "ONE")], "key string, answer string")
    assert {r.key: (r.answer, r.recorded) for r in pilot.replayed(asked, stored, lambda t: t + "!").collect()} == {"k1": ("ONE", True), "k2": ("two!", False)}
    assert {r.key: r.answer for r in pilot.replayed(asked, stored).collect()} == {"k1": "ONE", "k2": None}


def test_codebook_prompt(spark):
    rows = [{"topic_id": "a", "name": "A", "origin": "seed", "description": "d", "include": "", "exclude": "x", "boundary_notes": "", "examples": ["w " * 100]}]
    text = pilot.render_codebook(rows)
    assert text.startswith('<topic id="a" name="A" kind="researcher theme">\n<definition>d</definition>\n<exclude>x</exclude>\n<example>') and "[...]" in text and text.endswith("</topic>")
    twice = spark.createDataFrame([("a", "A", "seed", "d", "", "", "", 0), ("a", "B", "seed", "d", "", "", "", 1)], "topic_id string, name string, origin string, description string, include string, exclude string, boundary_notes string, position int")
    with pytest.raises(ValueError):
        pilot.load_codebook(twice)


def test_request_text(spark):
    turns = spark.createDataFrame([("i", 0, "Q", "why " * 80, 80, False), ("i", 1, "A", "so", 1, True), ("i", 2, "Q", "and", 1, False), ("i", 3, "A", "yes", 1, True)], "item_id string, turn_index long, speaker_name string, content string, word_count long, target boolean")
    chunks = pilot.request_chunks(turns, targets=1, context=0)
    assert [(r.first, r["last"], r.targets) for r in chunks.orderBy("chunk").collect()] == [(0, 1, [1]), (3, 3, [3])]
    texts = [r.text for r in pilot.render_chunks(chunks, turns).orderBy("chunk").collect()]
    assert "[...]" in texts[0] and '<turn id="1" speaker="A" code="yes">so</turn>' in texts[0] and texts[1].startswith("[... earlier turns omitted ...]") and texts[1].endswith("Code these 1 turns, each exactly once: 3")


def test_training_pass_on_three_sentences(spark):
    """30 positives, 60 judged negatives and 40 unread segments: all are scored, only judged ones out of fold; without marks the theme is skipped."""
    say = {"p": "growth revenue margin outlook strong quarter", "n": "weather holiday family travel garden music", "u": "weather growth table chair window door"}
    rows = [(f"{k}{i:02d}", f"{t} extra{i % 3}") for k, t, n in (("p", say["p"], 30), ("n", say["n"], 60), ("u", say["u"], 40)) for i in range(n)]
    segments = spark.createDataFrame(rows, "segment_id string, text string")
    themes = spark.createDataFrame([("t", "active"), ("empty", "active"), ("old", "archived")], "theme_id string, status string")
    y = segments.filter("segment_id not like 'u%'").select(F.lit("t").alias("theme_id"), "segment_id", F.when(F.col("segment_id").startswith("p"), 1).otherwise(0).alias("y"))
    runs, scores, terms = training.training_pass(segments, y, themes)
    run = {r.theme_id: r for r in runs.collect()}
    assert set(run) == {"t", "empty"} and run["empty"].status == "skipped_insufficient_positives"
    assert (run["t"].status, run["t"].n_pos, run["t"].n_neg) == ("trained", 30, 60) and run["t"].pr_auc > 0.99 and run["t"].f1 > 0.99
    got = {r.segment_id: r for r in scores.collect()}
    assert len(got) == 130 and all((r.oof_score is None) == i.startswith("u") for i, r in got.items())
    assert min(r.score for i, r in got.items() if i[0] == "p") > max(r.score for i, r in got.items() if i[0] == "n")
    best = {r.term for r in terms.filter("direction = 'positive' and rank <= 6").collect()}
    assert best & {"growth revenue", "revenue margin", "revenue", "margin"} and terms.filter("direction = 'negative'").count() == 20
    few = training.training_pass(segments, y.filter("y = 1 or segment_id < 'n20'"), themes)[0]
    assert {r.theme_id: r.status for r in few.collect()}["t"] == "skipped_insufficient_negatives"


def test_calibration_has_not_seen_its_rows(spark):
    """Labels without any pattern: scores out of fold stay about the base rate and rank no better than chance."""
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"s{i}", " ".join(rng.choice(words) for _ in range(12)), i % 2) for i in range(240)]
    segments = spark.createDataFrame(rows, "segment_id string, text string, y int")
    x, terms = training.vectors(segments)
    held, _ = training.fitted(x, segments.select(F.lit("t").alias("theme_id"), "segment_id", "y"), len(terms))
    assert held.count() == 240 and training.metrics(held).first().pr_auc < 0.65
    assert 0.3 < held.agg(F.avg("oof_score")).first()[0] < 0.7


def test_every_labelled_row_is_fitted(spark):
    """More than 10,000 rows of a class: each has a score out of fold, and the last ones count."""
    x = spark.range(12_000).select(F.format_string("s%05d", "id").alias("segment_id"), F.array((F.col("id") % 3).cast("int")).alias("at"), F.array(F.lit(1.0)).alias("value"))
    held, models = training.fitted(x, x.select(F.lit("t").alias("theme_id"), "segment_id", (F.substring("segment_id", 2, 9).cast("int") % 12 > 0).cast("int").alias("y")), 3)
    assert held.count() == 12_000 and held.filter("y = 1").count() == 11_000 and len(models["t"]) == training.INNER


def test_large_themes_are_fitted_over_tasks(spark, monkeypatch):
    """The steps over many tasks give what a task gives; a theme with one class has no models either way."""
    import random

    rng = random.Random(4)
    rows = [(f"s{i:03d}", sorted(rng.sample(range(30), 6)), [rng.random() for _ in range(6)]) for i in range(240)]
    x = spark.createDataFrame([*rows, ("s240", [], [])], "segment_id string, at array<int>, value array<double>").repartition(3)
    y = {i: int(sum(v for a, v in zip(at, value) if a < 10) + rng.random() > 1.3) for i, at, value in rows} | {"s240": 0}
    labels = spark.createDataFrame([(t, i, 1 if t == "one" else k) for t in ("one", "two") for i, k in y.items()], "theme_id string, segment_id string, y int")

    def made():
        held, models = training.fitted(x, labels, 30)
        return {(r.theme_id, r.segment_id): (r.y, r.oof_score) for r in held.collect()}, models

    held, models = made()
    monkeypatch.setattr(training, "TASK", 0)
    monkeypatch.setattr(training, "PIECE", 7)
    over_tasks, other = made()
    assert held.keys() == over_tasks.keys() and len(held) == 2 * 241 and models["one"] == other["one"] == [] and len(models["two"]) == len(other["two"]) == training.INNER
    assert all(held[k][0] == over_tasks[k][0] and abs(held[k][1] - over_tasks[k][1]) < 1e-4 for k in held)
    assert len({round(s, 3) for _, s in over_tasks.values()}) > 50


def test_embedding_cache(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "segment_id string, embedding array<float>")
    training.append_embeddings(str(tmp_path / "e"), "m", v)
    training.append_embeddings(str(tmp_path / "e"), "other", v.limit(1))
    training.append_embeddings(str(tmp_path / "e"), "m", v.filter("segment_id = 'a'").withColumn("segment_id", F.lit("c")))
    assert {r.segment_id for r in training.cached_embeddings(spark, str(tmp_path / "e"), "m").collect()} == {"a", "b", "c"}
