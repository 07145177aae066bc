"""Review queues, model runs and retention, decisions, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.labels import _J, _JS, _NEG, _POS, _REJ, _UP, closure, positives, rejections, reviewed_negatives, with_flags
from textloom.plans.graph import written
from textloom.plans.ordered import running_sums
from textloom.registry import query

# ------------------------------------------------------------------ runs


def engine_of(version: str = "model_version") -> Column:
    """The engine that a version name begins with; null for unknown ones."""
    v = F.col(version)
    return F.when(v.startswith("tfidf_"), "tfidf").when(v.startswith("emb_"), "embedding")


_ENGINE = "case when starts_with(model_version, 'tfidf_') then 'tfidf' when starts_with(model_version, 'emb_') then 'embedding' end"


def latest_runs(model_runs: DataFrame) -> DataFrame:
    """The newest run of each theme and engine; of equal times the later version."""
    w = Window.partitionBy("theme_id", "engine").orderBy(F.desc("trained_at"), F.desc("model_version"))
    return model_runs.withColumn("engine", engine_of()).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


_LATEST = f"latest as (select *, {_ENGINE} as engine from model_runs qualify row_number() over (partition by theme_id, {_ENGINE} order by trained_at desc, model_version desc) = 1)"


@query("j5_latest_runs", "model_runs", oracle=f"with {_LATEST} select theme_id, engine, model_version from latest")
def q_latest(model_runs):
    return latest_runs(model_runs).select("theme_id", "engine", "model_version")


@query("j4_runs_with_params", "model_runs", "run_params", oracle="""select model_version, theme_id, coalesce(json_extract_string(try_cast(params_json as json), '$.negative_mode'), 'all_uncoded') as negative_mode from model_runs left join run_params using (model_version)""")
def runs_with_params(model_runs, run_params):
    mode = F.coalesce(F.get_json_object("params_json", "$.negative_mode"), F.lit("all_uncoded"))
    return model_runs.join(F.broadcast(run_params), "model_version", "left").select("model_version", "theme_id", mode.alias("negative_mode"))


def retention(model_runs: DataFrame, pins: DataFrame, keep: int = 2) -> DataFrame:
    """Fate of every run: pinned, latest, recent or prunable, by theme and engine."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    w = Window.partitionBy("theme_id", "engine").orderBy(F.desc("trained_at"), F.desc("model_version"))
    d = model_runs.withColumn("engine", engine_of()).withColumn("rank", F.row_number().over(w) - 1)
    d = d.join(F.broadcast(pins.withColumn("pinned", F.lit(True))), ["model_version", "theme_id"], "left")
    fate = F.when(F.col("pinned"), "pinned").when(F.col("rank") == 0, "latest").when(F.col("rank") < keep, "recent").otherwise("prunable")
    return d.select("model_version", "theme_id", "engine", fate.alias("fate"))


@query("w3_retention", "model_runs", "pins", oracle=f"""select model_version, theme_id, {_ENGINE} as engine, case when (model_version, theme_id) in (select model_version, theme_id from pins) then 'pinned'
    else (case when row_number() over w = 1 then 'latest' when row_number() over w <= 2 then 'recent' else 'prunable' end) end as fate from model_runs window w as (partition by theme_id, {_ENGINE} order by trained_at desc, model_version desc)""")
def q_retention(model_runs, pins):
    return retention(model_runs, pins)


@query("j11_rounds", "model_runs", "round_decisions", oracle="select model_version, theme_id, 1 + (select count(*) from round_decisions d where d.created_at < r.trained_at)::bigint as round from model_runs r")
def rounds(model_runs, round_decisions):
    """1 + decisions before the run: one ordered pass over both, no range join."""
    both = model_runs.select("model_version", "theme_id", F.col("trained_at").alias("at"), F.lit(0).alias("d")).unionByName(round_decisions.select(F.lit(None).cast("string").alias("model_version"), F.lit(None).cast("string").alias("theme_id"), F.col("created_at").alias("at"), F.lit(1).alias("d")))
    # Runs of equal time come before the decision: only earlier decisions count.
    w = Window.orderBy("at", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a ledger of runs and rounds
    return both.withColumn("round", 1 + F.sum("d").over(w)).filter("d = 0").select("model_version", "theme_id", "round")


@query("a17_run_means", "model_runs", oracle="select model_version, count(*)::bigint as n_themes, round(avg(prec), 6) as prec, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, round(avg(pr_auc), 6) as pr_auc from model_runs group by 1")
def run_means(model_runs):
    return model_runs.groupBy("model_version").agg(F.count("*").alias("n_themes"), *(F.round(F.avg(c), 6).alias(c) for c in ("prec", "recall", "f1", "pr_auc")))


@query("a18_prediction_counts", "predictions", "model_runs", oracle="select model_version, theme_id, count(*)::bigint as n, (model_version, theme_id) not in (select model_version, theme_id from model_runs) as orphan from predictions group by 1, 2")
def prediction_counts(predictions, model_runs):
    n = predictions.groupBy("model_version", "theme_id").agg(F.count("*").alias("n"))
    runs = F.broadcast(model_runs.select("model_version", "theme_id", F.lit(True).alias("known")))
    return n.join(runs, ["model_version", "theme_id"], "left").select("model_version", "theme_id", "n", F.col("known").isNull().alias("orphan"))


@query("a20_storage_report", "predictions", "model_runs", "pins", oracle=f"""with f as (select model_version, theme_id, case when (model_version, theme_id) in (select model_version, theme_id from pins) then 'pinned' else (case when row_number() over w = 1 then 'latest' when row_number() over w <= 2 then 'recent' else 'prunable' end) end as fate
      from model_runs window w as (partition by theme_id, {_ENGINE} order by trained_at desc, model_version desc)), b as (select avg(length(segment_id) + length(theme_id) + length(model_version) + 16) * 1.15 as bytes from predictions)
    select coalesce(fate, 'orphan') as fate, count(*)::bigint as n, round(count(*) * any_value(bytes), 6) as bytes from predictions left join f using (model_version, theme_id), b group by 1""")
def storage_report(predictions, model_runs, pins, overhead: float = 1.15):
    each = predictions.agg((F.avg(F.length("segment_id") + F.length("theme_id") + F.length("model_version") + 16) * overhead).alias("bytes"))
    n = predictions.groupBy("model_version", "theme_id").agg(F.count("*").alias("n")).join(F.broadcast(retention(model_runs, pins)), ["model_version", "theme_id"], "left")
    return n.groupBy(F.coalesce("fate", F.lit("orphan")).alias("fate")).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(each)).select("fate", "n", F.round(F.col("n") * F.col("bytes"), 6).alias("bytes"))


@query("f15_prune", "predictions", "model_runs", "pins", oracle=f"""with f as (select model_version, theme_id, (model_version, theme_id) not in (select model_version, theme_id from pins) and row_number() over (partition by theme_id, {_ENGINE} order by trained_at desc, model_version desc) > 1 as gone from model_runs)
    select model_version, theme_id, segment_id from predictions anti join (select * from f where gone) using (model_version, theme_id)""")
def prune(predictions, model_runs, pins, keep: int = 1):
    gone = retention(model_runs, pins, keep).filter("fate = 'prunable'").select("model_version", "theme_id")
    return predictions.join(F.broadcast(gone), ["model_version", "theme_id"], "left_anti").select("model_version", "theme_id", "segment_id")


# ------------------------------------------------------------------ queues


def _own(predictions, version, theme):
    return predictions.filter((F.col("model_version") == version) & (F.col("theme_id") == theme))


MODES = ("top", "uncertain", "audit", "suspect", "boundary")


def queue_rows(mode: str, predictions, codes, negatives, item_reviews, none_confirmations, segments, themes, theme: str, version: str, threshold: float, seed: str = "7") -> tuple[DataFrame, Column]:
    """Rows of a theme's queue (segment_id, sort_key, score, oof_score), not sorted yet, and their order; ties by segment id.

    top, uncertain and audit show undecided segments (neither coded nor a
    reviewed negative); suspect shows labels that the out-of-fold score
    contradicts; boundary shows negatives known to be read in full that score
    high and are not flagged near misses.
    """
    if mode not in MODES:
        raise ValueError(f"unknown queue mode {mode}")
    p = _own(predictions, version, theme).select("segment_id", "score", "oof_score")
    tree = closure(themes)
    pos = positives(codes, tree).filter(F.col("theme_id") == theme).select("segment_id")
    if mode in ("suspect", "boundary"):
        strict = mode == "boundary"
        neg = reviewed_negatives(codes, negatives, item_reviews, none_confirmations, segments, themes, strict=strict, tree=tree).filter(F.col("theme_id") == theme).select("segment_id")
        if mode == "suspect":
            p = p.filter("oof_score is not null")
            d = p.join(pos, "segment_id", "left_semi").withColumn("sort_key", 1 - F.col("oof_score")).unionByName(p.join(neg, "segment_id", "left_semi").withColumn("sort_key", F.col("oof_score")))
        else:
            near = negatives.filter("deleted_at is null and is_near_miss").filter(F.col("theme_id") == theme).select("segment_id")
            d = p.join(neg, "segment_id", "left_semi").join(near, "segment_id", "left_anti").withColumn("sort_key", F.coalesce("oof_score", "score"))
        order = F.desc("sort_key")
    else:
        neg = reviewed_negatives(codes, negatives, item_reviews, none_confirmations, segments, themes, tree=tree).filter(F.col("theme_id") == theme).select("segment_id")
        d = p.join(pos, "segment_id", "left_anti").join(neg, "segment_id", "left_anti")
        if mode == "top":
            d, order = d.withColumn("sort_key", F.col("score")), F.desc("sort_key")
        elif mode == "uncertain":
            d, order = d.withColumn("sort_key", F.round(F.abs(F.col("score") - threshold), 6)), F.asc("sort_key")
        else:
            d, order = d.filter(F.col("score") >= threshold).withColumn("sort_key", F.md5(F.concat(F.lit(seed), F.lit("|"), "segment_id"))), F.asc("sort_key")
    return d.select("segment_id", "sort_key", "score", "oof_score"), order


def review_queue(mode: str, *tables, **which) -> DataFrame:
    """``queue_rows`` in order."""
    rows, order = queue_rows(mode, *tables, **which)
    return rows.orderBy(order, "segment_id")


#: Rows of a page: as asked for, and at most.
PAGE, MOST = 25, 200


def page_of(queue: tuple[DataFrame, Column], offset: int = 0, limit: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """One page of a queue (a top-k, not a sort of all rows), and a row with the queue's total.

    The queue's rows are written once, unsorted; page and total read them.
    """
    limit = max(1, min(MOST, limit))
    rows = written(queue[0])
    return rows.orderBy(queue[1], "segment_id").offset(max(0, offset)).limit(limit), rows.agg(F.count("*").alias("total"))


def queue_page(queue: tuple[DataFrame, Column], segments, codes, negatives, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of a queue (``queue_rows``) with each segment's text, codes, rejections and exemplar flags, and the total.

    What is joined is joined after the limit, so it's read for the page's rows
    only; segments that are gone drop out of the page.
    """
    page, total = page_of(queue, offset, limit)
    page = F.broadcast(page)  # MOST rows at most
    lists = lambda d, name: d.join(page.select("segment_id"), "segment_id", "left_semi").groupBy("segment_id").agg(F.array_join(F.sort_array(F.collect_set("theme_id")), ",").alias(name))
    own = segments.select("segment_id", "item_id", "text", "word_count").join(page, "segment_id")
    out = own.join(lists(codes.filter("deleted_at is null"), "codes"), "segment_id", "left").join(lists(negatives.filter("deleted_at is null"), "rejected"), "segment_id", "left")
    out = out.join(lists(codes.filter("deleted_at is null and is_exemplar"), "exemplar"), "segment_id", "left").na.fill("", ["codes", "rejected", "exemplar"])
    return out.crossJoin(F.broadcast(total))


_PQ = "p as (select * from predictions where model_version = 'tfidf_v2' and theme_id = 's__toxic')"
_UND = "und as (select * from p where segment_id not in (select segment_id from pos where theme_id = 's__toxic') and segment_id not in (select segment_id from neg where theme_id = 's__toxic'))"
_QUEUES = {
    "top": f"with recursive {_UP}, {_POS}, {_REJ}, {_J}, {_NEG}, {_PQ}, {_UND} select segment_id, score as sort_key from und",
    "uncertain": f"with recursive {_UP}, {_POS}, {_REJ}, {_J}, {_NEG}, {_PQ}, {_UND} select segment_id, round(abs(score - 0.6), 6) as sort_key from und",
    "audit": f"with recursive {_UP}, {_POS}, {_REJ}, {_J}, {_NEG}, {_PQ}, {_UND} select segment_id, md5('7|' || segment_id) as sort_key from und where score >= 0.6",
    "suspect": f"with recursive {_UP}, {_POS}, {_REJ}, {_J}, {_NEG}, {_PQ} select segment_id, 1 - oof_score as sort_key from p where oof_score is not null and segment_id in (select segment_id from pos where theme_id = 's__toxic') union all select segment_id, oof_score from p where oof_score is not null and segment_id in (select segment_id from neg where theme_id = 's__toxic')",
    "boundary": f"with recursive {_UP}, {_POS}, {_REJ}, {_JS}, {_NEG}, {_PQ} select segment_id, coalesce(oof_score, score) as sort_key from p where segment_id in (select segment_id from neg where theme_id = 's__toxic') and segment_id not in (select segment_id from negatives where deleted_at is null and is_near_miss and theme_id = 's__toxic')",
}
for _m, _sql in _QUEUES.items():

    def _queue(*t, mode=_m):
        return review_queue(mode, *t, theme="s__toxic", version="tfidf_v2", threshold=0.6).select("segment_id", "sort_key")

    query(f"f_queue_{_m}", "predictions", "codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", oracle=_sql)(_queue)


@query("f7_queue_page", "predictions", "codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", oracle=f"""with recursive {_UP}, {_POS}, {_REJ}, {_J}, {_NEG}, {_PQ}, {_UND}, pg as (select segment_id, score as sort_key, score, oof_score from und order by score desc, segment_id limit 25 offset 5)
    select pg.*, item_id, text, word_count, coalesce((select string_agg(distinct theme_id, ',' order by theme_id) from codes c where c.segment_id = pg.segment_id and deleted_at is null), '') as codes, coalesce((select string_agg(distinct theme_id, ',' order by theme_id) from negatives n where n.segment_id = pg.segment_id and deleted_at is null), '') as rejected,
      coalesce((select string_agg(distinct theme_id, ',' order by theme_id) from codes c where c.segment_id = pg.segment_id and deleted_at is null and is_exemplar), '') as exemplar, (select count(*) from und)::bigint as total from pg join segments using (segment_id)""")
def q_queue_page(*t):
    """A page of the top queue from its sixth row on."""
    predictions, codes, negatives, _, _, segments, _ = t
    return queue_page(queue_rows("top", *t, theme="s__toxic", version="tfidf_v2", threshold=0.6), segments, codes, negatives, offset=5)


@query("f6_queue_confusion", "predictions", "model_runs", "codes", "negatives", "themes", oracle=f"""with recursive {_UP}, {_POS}, {_REJ}, {_LATEST},
    near as (select ancestor as t from up where descendant = 's__quality' union select descendant from up where ancestor = 's__quality'),
    o as (select p.segment_id, p.theme_id, p.score from predictions p join latest l using (model_version, theme_id) join themes t on t.theme_id = p.theme_id where engine = 'tfidf' and status = 'active' and p.theme_id not in (select t from near) and score >= threshold
      and (p.theme_id, p.segment_id) not in (select theme_id, segment_id from pos) and (p.theme_id, p.segment_id) not in (select theme_id, segment_id from rej) and p.segment_id in (select segment_id from pos where theme_id = 's__quality'))
    select segment_id, theme_id as other, score from o qualify row_number() over (partition by segment_id order by score desc, theme_id) = 1""")
def confusion_queue(predictions, model_runs, codes, negatives, themes, theme: str = "s__quality", engine: str = "tfidf"):
    """Segments coded with the theme that another theme's model claims; the best other theme of each."""
    tree, key = closure(themes), ["theme_id", "segment_id"]
    related = tree.filter(F.col("descendant") == theme).select(F.col("ancestor").alias("theme_id")).union(tree.filter(F.col("ancestor") == theme).select("descendant"))
    runs = latest_runs(model_runs).filter(F.col("engine") == engine).join(themes.filter("status = 'active'").select("theme_id"), "theme_id", "left_semi").join(related, "theme_id", "left_anti")
    p = predictions.join(F.broadcast(runs.select("model_version", "theme_id", "threshold")), ["model_version", "theme_id"]).filter("score >= threshold")
    pos = positives(codes, tree)
    p = p.join(pos.filter(F.col("theme_id") == theme).select("segment_id"), "segment_id", "left_semi")
    p = p.join(pos, key, "left_anti").join(rejections(negatives, codes, tree), key, "left_anti")
    w = Window.partitionBy("segment_id").orderBy(F.desc("score"), "theme_id")
    return p.withColumn("k", F.row_number().over(w)).filter("k = 1").select("segment_id", F.col("theme_id").alias("other"), "score")


@query("f8_recode_candidates", "predictions", "codes", "negatives", "themes", oracle=f"""with recursive {_UP}, {_POS}, {_REJ}, top as (select segment_id, score from predictions where model_version = 'tfidf_v2' and theme_id = 's__toxic' order by score desc, segment_id limit 30)
    select segment_id, 'coded' as reason, null::double as score from pos where theme_id = 's__toxic' union all select segment_id, 'predicted', score from top where segment_id not in (select segment_id from pos where theme_id = 's__toxic') and segment_id not in (select segment_id from rej where theme_id = 's__toxic')""")
def recode_candidates(predictions, codes, negatives, themes, theme: str = "s__toxic", version: str = "tfidf_v2", limit: int = 30):
    """Coded segments and, of the ``limit`` best predictions, those not decided (the limit comes first)."""
    tree = closure(themes)
    pos = positives(codes, tree).filter(F.col("theme_id") == theme).select("segment_id")
    rej = rejections(negatives, codes, tree).filter(F.col("theme_id") == theme).select("segment_id")
    top = _own(predictions, version, theme).orderBy(F.desc("score"), "segment_id").limit(limit).select("segment_id", "score")
    top = top.join(pos, "segment_id", "left_anti").join(rej, "segment_id", "left_anti")
    return pos.select("segment_id", F.lit("coded").alias("reason"), F.lit(None).cast("double").alias("score")).unionByName(top.select("segment_id", F.lit("predicted").alias("reason"), "score"))


@query("f9_score_matrix", "predictions", "model_runs", "segments", oracle=f"with {_LATEST} select p.segment_id, p.theme_id, p.score from predictions p join latest using (model_version, theme_id) where engine = 'tfidf'")
def score_matrix(predictions, model_runs, wanted, engine: str = "tfidf"):
    """Scores of the segments of ``wanted`` (segment_id) under each theme's newest run of an engine."""
    runs = latest_runs(model_runs).filter(F.col("engine") == engine).select("model_version", "theme_id")
    page = wanted.select("segment_id").distinct()
    return predictions.join(F.broadcast(runs), ["model_version", "theme_id"]).join(page, "segment_id", "left_semi").select("segment_id", "theme_id", "score")


@query("t2_top_predictions", "predictions", oracle="select segment_id, score from predictions where model_version = 'tfidf_v2' and theme_id = 's__quality' order by score desc, segment_id limit 15")
def top_predictions(predictions, limit: int = 15):
    return _own(predictions, "tfidf_v2", "s__quality").orderBy(F.desc("score"), "segment_id").limit(limit).select("segment_id", "score")


@query("t3_predictions_above", "predictions", oracle="select segment_id, score from predictions where model_version = 'tfidf_v2' and theme_id = 's__quality' and score >= 0.45")
def predictions_above(predictions, threshold: float = 0.45):
    return _own(predictions, "tfidf_v2", "s__quality").filter(F.col("score") >= threshold).select("segment_id", "score")


@query("a23_value_proposition", "predictions", "codes", "negatives", "themes", "model_runs", oracle=f"""with recursive {_UP}, {_POS}, {_REJ}, f as (select p.*, threshold, (theme_id, segment_id) in (select theme_id, segment_id from pos) as coded, (theme_id, segment_id) in (select theme_id, segment_id from rej) as rejected from predictions p join model_runs using (model_version, theme_id))
    select model_version, theme_id, count(*) filter (coded)::bigint as coded, count(*) filter (score >= threshold and not coded and not rejected)::bigint as flagged, count(*) filter (rejected)::bigint as rejected, round((count(*) filter (coded) + count(*) filter (score >= threshold and not coded and not rejected)) / count(*)::double, 6) as coverage from f group by 1, 2""")
def value_proposition(predictions, codes, negatives, themes, model_runs):
    d = with_flags(predictions, codes, negatives, themes).join(F.broadcast(model_runs.select("model_version", "theme_id", "threshold")), ["model_version", "theme_id"])
    flagged = (F.col("score") >= F.col("threshold")) & ~F.col("coded") & ~F.col("rejected")
    n = d.groupBy("model_version", "theme_id").agg(F.count_if("coded").alias("coded"), F.count_if(flagged).alias("flagged"), F.count_if("rejected").alias("rejected"), F.count("*").alias("n"))
    return n.select("model_version", "theme_id", "coded", "flagged", "rejected", F.round(F.try_divide(F.col("coded") + F.col("flagged"), F.col("n")), 6).alias("coverage"))


@query("a15_round_summary", "decisions", oracle="select round_id, count(*) filter (decision = 'accept')::bigint as accept, count(*) filter (decision = 'reject')::bigint as reject, count(*) filter (decision = 'skip')::bigint as skip, count(*)::bigint as total from decisions where undone_at is null group by 1")
def round_summary(decisions):
    n = lambda kind: F.count_if(F.col("decision") == kind).alias(kind)
    return decisions.filter("undone_at is null").groupBy("round_id").agg(n("accept"), n("reject"), n("skip"), F.count("*").alias("total"))


@query("a16_label_changes", "codes", "negatives", "item_reviews", "none_confirmations", oracle="""select (select count(*) from codes where created_at > '2024-02-08')::bigint as codes_added, (select count(*) from codes where deleted_at > '2024-02-08')::bigint as codes_removed, (select count(*) from negatives where created_at > '2024-02-08')::bigint as negatives_added,
    (select count(*) from negatives where deleted_at > '2024-02-08')::bigint as negatives_removed, (select count(*) from item_reviews where coalesce(recorded_at, marked_at) > '2024-02-08')::bigint as marks_added, (select count(*) from item_reviews where unmarked_at > '2024-02-08')::bigint as marks_removed,
    (select count(*) from none_confirmations where confirmed_at > '2024-02-08')::bigint as none_added, (select count(*) from none_confirmations where unconfirmed_at > '2024-02-08')::bigint as none_removed""")
def label_changes(codes, negatives, item_reviews, none_confirmations, since: str = "2024-02-08"):
    out = None
    for d, name, on, off in ((codes, "codes", F.col("created_at"), F.col("deleted_at")), (negatives, "negatives", F.col("created_at"), F.col("deleted_at")), (item_reviews, "marks", F.coalesce("recorded_at", "marked_at"), F.col("unmarked_at")), (none_confirmations, "none", F.col("confirmed_at"), F.col("unconfirmed_at"))):
        one = d.agg(F.count_if(on > since).alias(f"{name}_added"), F.count_if(off > since).alias(f"{name}_removed"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


# ------------------------------------------------------------------ evaluation


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; null where undefined."""
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return p, r, F.try_divide(2 * p * r, p + r)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k of n, cut to 0..1; null without observations."""
    p = F.try_divide(k, n)
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    cut = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (1 + z * z / n))))
    return cut(mid - half), cut(mid + half)


def curve(scored: DataFrame, key: str = "theme_id") -> DataFrame:
    """Cumulative true and false positives by descending score; tied scores move together."""
    g = scored.groupBy(key, "score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    d = running_sums(g, [key], [F.desc("score")], ["pos", "n"])
    return d.select(key, "score", "pos", F.col("pos_upto").alias("tp"), F.col("n_upto").alias("k"), F.col("pos_all").alias("all_pos"))


_GOLD = """gold as (select theme_id, dataset_id, item_id from (select * from item_reviews where unmarked_at is null qualify row_number() over (partition by dataset_id, item_id, scheme_id order by marked_at desc, review_id desc) = 1) r join themes t using (scheme_id)
      where (read_in_full_confirmed_at is not null or coalesce(recorded_at = marked_at, false)) and marked_at >= t.created_at)"""
_Y = f"""with recursive {_UP}, {_POS}, {_GOLD}, y as (select p.theme_id, p.segment_id, s.dataset_id, s.item_id, coalesce(oof_score, score) as score, threshold, case when (p.theme_id, p.segment_id) in (select theme_id, segment_id from pos) then 1 else 0 end as y from predictions p join model_runs using (model_version, theme_id)
      join segments s on s.segment_id = p.segment_id join gold using (theme_id, dataset_id, item_id) where model_version = 'tfidf_v2'),
    g as (select theme_id, score, sum(y) as pos, count(*) as n from y group by 1, 2), c as (select theme_id, score, pos, sum(pos) over w as tp, sum(n) over w as k, sum(pos) over (partition by theme_id) as total from g window w as (partition by theme_id order by score desc rows unbounded preceding))"""


def gold_items(item_reviews, themes) -> DataFrame:
    """(theme_id, dataset_id, item_id) of the items read in full whose newest mark is no older than the theme."""
    w = Window.partitionBy("dataset_id", "item_id", "scheme_id").orderBy(F.desc("marked_at"), F.desc("review_id"))
    newest = item_reviews.filter("unmarked_at is null").withColumn("k", F.row_number().over(w)).filter("k = 1").filter("read_in_full_confirmed_at is not null or recorded_at = marked_at")
    t = F.broadcast(themes.select("theme_id", "scheme_id", F.col("created_at").alias("theme_created")))
    return newest.join(t, "scheme_id").filter("marked_at >= theme_created").select("theme_id", "dataset_id", "item_id")


def judged(predictions, codes, themes, model_runs, item_reviews, segments, version="tfidf_v2") -> DataFrame:
    """(theme_id, segment_id, dataset_id, item_id, score, threshold, y) of the gold items' segments that the run scored: honest scores, the out-of-fold one first."""
    pos = positives(codes, closure(themes)).withColumn("y", F.lit(1))
    own = segments.select("segment_id", "dataset_id", "item_id").join(gold_items(item_reviews, themes), ["dataset_id", "item_id"])
    p = predictions.filter(F.col("model_version") == version).join(F.broadcast(model_runs.select("model_version", "theme_id", "threshold")), ["model_version", "theme_id"])
    d = p.join(pos, ["theme_id", "segment_id"], "left").select("theme_id", "segment_id", F.coalesce("oof_score", "score").alias("score"), "threshold", F.coalesce("y", F.lit(0)).alias("y"))
    return d.join(own, ["theme_id", "segment_id"])


_EVAL = ("predictions", "codes", "themes", "model_runs", "item_reviews", "segments")


@query("g2_precision_recall", *_EVAL, oracle=f"""{_Y}, s as (select theme_id, count(*) filter (y = 1 and score >= threshold) as tp, count(*) filter (y = 0 and score >= threshold) as fp, count(*) filter (y = 1 and score < threshold) as fn from y group by 1)
    select theme_id, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp / nullif(tp + fp, 0)::double, 6) as prec, round(tp / nullif(tp + fn, 0)::double, 6) as recall, case when tp > 0 then round(2.0 * tp / (2 * tp + fp + fn)::double, 6) end as f1,
    round((tp / (tp + fp)::double + 3.8416 / (2 * (tp + fp)) - 1.96 * sqrt(tp / (tp + fp)::double * (1 - tp / (tp + fp)::double) / (tp + fp) + 3.8416 / (4.0 * (tp + fp) * (tp + fp)))) / (1 + 3.8416 / (tp + fp)), 6) as prec_low,
    round((tp / (tp + fp)::double + 3.8416 / (2 * (tp + fp)) + 1.96 * sqrt(tp / (tp + fp)::double * (1 - tp / (tp + fp)::double) / (tp + fp) + 3.8416 / (4.0 * (tp + fp) * (tp + fp)))) / (1 + 3.8416 / (tp + fp)), 6) as prec_high from s""")
def evaluation(*t):
    hit = F.col("score") >= F.col("threshold")
    s = judged(*t).groupBy("theme_id").agg(F.count_if((F.col("y") == 1) & hit).alias("tp"), F.count_if((F.col("y") == 0) & hit).alias("fp"), F.count_if((F.col("y") == 1) & ~hit).alias("fn"))
    p, r, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return s.select("theme_id", "tp", "fp", "fn", F.round(p, 6).alias("prec"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(low, 6).alias("prec_low"), F.round(high, 6).alias("prec_high"))


@query("g3_average_precision", *_EVAL, oracle=f"{_Y} select theme_id, round(sum(pos / nullif(total, 0)::double * tp / k::double), 6) as ap from c group by 1")
def average_precision(*t):
    return curve(judged(*t)).groupBy("theme_id").agg(F.round(F.sum(F.try_divide("pos", "all_pos") * F.col("tp") / F.col("k")), 6).alias("ap"))


@query("m11_best_threshold", *_EVAL, oracle=f"{_Y}, f as (select theme_id, score, 2.0 * tp / (k + total)::double as f1 from c where total > 0) select theme_id, score as threshold, round(f1, 6) as f1 from f qualify row_number() over (partition by theme_id order by round(f1, 12) desc, score) = 1")
def best_threshold(*t):
    """The threshold with the best F1; of equals the lowest."""
    c = curve(judged(*t)).filter("all_pos > 0").withColumn("f1", 2 * F.col("tp") / (F.col("k") + F.col("all_pos")))
    w = Window.partitionBy("theme_id").orderBy(F.desc(F.round("f1", 12)), "score")
    return c.withColumn("r", F.row_number().over(w)).filter("r = 1").select("theme_id", F.col("score").alias("threshold"), F.round("f1", 6).alias("f1"))


@query("g4_calibration", *_EVAL, oracle=f"{_Y} select b::double / 5 as low, count(score)::bigint as n, coalesce(sum(y), 0)::bigint as pos, round(avg(score), 6) as mean_score from range(5) r(b) left join y on least(floor(score * 5), 4) = b group by b")
def calibration(*t, bands: int = 5):
    """Equal bands of the score, the last one closed; empty bands stay."""
    d = judged(*t).withColumn("b", F.least(F.floor(F.col("score") * bands), F.lit(bands - 1)).cast("long"))
    n = d.groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.round(F.avg("score"), 6).alias("mean_score"))
    grid = t[0].sparkSession.range(bands).withColumnRenamed("id", "b")
    return grid.join(n, "b", "left").select((F.col("b") / bands).alias("low"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "mean_score")


def roll_up(scored: DataFrame, turn_map: DataFrame) -> DataFrame:
    """Units of judged segments (see ``judged``): one a source turn, positive if any of its segments is, with the highest score.

    ``turn_map``: segment_id, turn_index.  A segment that it doesn't have is its own unit.
    """
    d = scored.join(turn_map.select("segment_id", "turn_index"), "segment_id", "left")
    unit = F.coalesce(F.concat("dataset_id", F.lit("|"), "item_id", F.lit("|"), F.col("turn_index").cast("string")), "segment_id")
    d = d.withColumn("unit", unit).withColumn("alone", F.col("turn_index").isNull())
    g = d.groupBy("theme_id", "unit").agg(F.bool_or(F.col("y") == 1).alias("positive"), F.max("score").alias("score"), F.count("*").alias("n"), F.max("threshold").alias("threshold"), F.bool_and("alone").alias("by_segment"))
    return g


_MAP = "tm as (select segment_id, 0 as turn_index from segments where doc_id % 3 = 0 union all select segment_id, doc_id % 2 from segments where doc_id % 3 = 1)"
_UNITS = "un as (select theme_id, case when turn_index is null then segment_id else dataset_id || '|' || item_id || '|' || turn_index::varchar end as unit, max(y) as y, max(score) as score, count(*) as n, any_value(threshold) as threshold, bool_and(turn_index is null) as by_segment from y left join tm using (segment_id) group by 1, 2)"


@query("a29_turn_rollup", *_EVAL, "segment_turns", oracle=f"{_Y}, {_MAP}, {_UNITS} select theme_id, unit, y = 1 as positive, score, n::bigint as n, by_segment, threshold from un")
def turn_rollup(*t):
    """Segments that share a turn are one unit: positive if any is, with the highest score."""
    return roll_up(judged(*t[:-1]), t[-1])


def metrics(units: DataFrame) -> DataFrame:
    """A theme's counts, precision, recall and F1 with Wilson intervals, and average precision, over its units."""
    hit = F.col("score") >= F.col("threshold")
    y = F.col("positive")
    s = units.groupBy("theme_id").agg(F.count("*").alias("n_units"), F.count_if(y).alias("n_pos"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if("by_segment").alias("units_by_segment"))
    p, r, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    p_low, p_high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    r_low, r_high = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    ap = curve(units.select("theme_id", "score", y.cast("int").alias("y"))).groupBy("theme_id").agg(F.sum(F.try_divide("pos", "all_pos") * F.col("tp") / F.col("k")).alias("pr_auc"))
    named = {"precision": p, "recall": r, "f1": f1}
    d = s.select("*", *(F.round(c, 6).alias(k) for k, c in named.items()), *(F.round(c, 3).alias(k) for k, c in {"precision_low": p_low, "precision_high": p_high, "recall_low": r_low, "recall_high": r_high}.items()))
    return d.join(ap.select("theme_id", F.round("pr_auc", 6).alias("pr_auc")), "theme_id", "left")


def evaluate_run(predictions, codes, themes, model_runs, item_reviews, segments, turn_map: DataFrame, version: str, compare: str | None = None) -> DataFrame:
    """One row for each theme that the run trained: gold items, metrics over gold units, and why there are none.

    ``note``: no_gold (no item read in full), scores_pruned (the run keeps no
    scores) or no_scored_gold (none of the gold is scored).  ``compare`` gives
    the F1 and units of another run on the same gold.
    """
    runs = model_runs.filter(F.col("model_version") == version).select("theme_id", "threshold")
    gold = gold_items(item_reviews, themes).groupBy("theme_id").agg(F.count("*").alias("gold_items"))
    kept = predictions.filter(F.col("model_version") == version).select("theme_id").distinct().withColumn("kept", F.lit(True))
    own = judged(predictions, codes, themes, model_runs, item_reviews, segments, version)
    out = runs.join(gold, "theme_id", "left").join(kept, "theme_id", "left").join(metrics(roll_up(own, turn_map)), "theme_id", "left")
    note = F.when(F.col("gold_items").isNull(), "no_gold").when(F.col("kept").isNull(), "scores_pruned").when(F.col("n_units").isNull(), "no_scored_gold")
    out = out.withColumn("note", note).withColumn("gold_items", F.coalesce("gold_items", F.lit(0))).drop("kept")
    if compare:
        # The same gold passages as the other run scored them; those it didn't score drop out of its numbers only.
        other = judged(predictions, codes, themes, model_runs, item_reviews, segments, compare).join(own.select("theme_id", "segment_id"), ["theme_id", "segment_id"], "left_semi")
        m = metrics(roll_up(other, turn_map)).select("theme_id", F.col("f1").alias("compare_f1"), F.col("n_units").alias("compare_units"))
        out = out.join(m, "theme_id", "left")
    return out


def _metrics_sql(units: str) -> str:
    low = lambda k, n, sign: f"case when {n} > 0 then round(greatest(0.0, least(1.0, ({k} / ({n})::double + 3.8416 / (2 * ({n})) {sign} 1.96 * sqrt({k} / ({n})::double * (1 - {k} / ({n})::double) / ({n}) + 3.8416 / (4.0 * ({n}) * ({n})))) / (1 + 3.8416 / ({n})))), 3) end"
    return f"""select theme_id, count(*)::bigint as n_units, count(*) filter (y = 1)::bigint as n_pos, count(*) filter (y = 1 and score >= threshold)::bigint as tp, count(*) filter (y = 0 and score >= threshold)::bigint as fp, count(*) filter (y = 1 and score < threshold)::bigint as fn, count(*) filter (by_segment)::bigint as units_by_segment from {units} group by 1""", f"""*,
      round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall, case when tp > 0 then round(2.0 * tp / (2 * tp + fp + fn)::double, 6) end as f1, {low('tp', 'tp + fp', '-')} as precision_low, {low('tp', 'tp + fp', '+')} as precision_high, {low('tp', 'tp + fn', '-')} as recall_low, {low('tp', 'tp + fn', '+')} as recall_high"""


_COUNTED, _RATIOS = _metrics_sql("un")


@query("g7_evaluate_run", *_EVAL, "segment_turns", oracle=f"""{_Y}, {_MAP}, {_UNITS}, m0 as ({_COUNTED}), m1 as (select {_RATIOS} from m0), ug as (select theme_id, score, sum(y) as pos, count(*) as n from un group by 1, 2),
    uc as (select theme_id, score, pos, sum(pos) over w as tp, sum(n) over w as k, sum(pos) over (partition by theme_id) as total from ug window w as (partition by theme_id order by score desc rows unbounded preceding)),
    ap as (select theme_id, round(sum(pos / nullif(total, 0)::double * tp / k::double), 6) as pr_auc from uc group by 1), gi as (select theme_id, count(*)::bigint as gold_items from gold group by 1)
    select r.theme_id, r.threshold, coalesce(gold_items, 0) as gold_items, m1.* exclude (theme_id), pr_auc, case when gold_items is null then 'no_gold' when n_units is null then 'no_scored_gold' end as note from (select theme_id, threshold from model_runs where model_version = 'tfidf_v2') r left join gi using (theme_id) left join m1 using (theme_id) left join ap using (theme_id)""")
def q_evaluate(*t):
    return evaluate_run(*t, "tfidf_v2")


@query("g7_compare_runs", *_EVAL, "segment_turns", oracle=f"""{_Y}, {_MAP}, y1 as (select p.theme_id, p.segment_id, s.dataset_id, s.item_id, coalesce(oof_score, p.score) as score, threshold, case when (p.theme_id, p.segment_id) in (select theme_id, segment_id from pos) then 1 else 0 end as y from predictions p join model_runs using (model_version, theme_id)
      join segments s on s.segment_id = p.segment_id join gold using (theme_id, dataset_id, item_id) where model_version = 'tfidf_v1' and (p.theme_id, p.segment_id) in (select theme_id, segment_id from y)), {_UNITS.replace("un as", "u1 as").replace(" from y ", " from y1 ")}, {_UNITS}, m0 as ({_COUNTED}), n0 as ({_metrics_sql("u1")[0]})
    select r.theme_id, m0.n_units, case when m0.tp > 0 then round(2.0 * m0.tp / (2 * m0.tp + m0.fp + m0.fn)::double, 6) end as f1, n0.n_units as compare_units, case when n0.tp > 0 then round(2.0 * n0.tp / (2 * n0.tp + n0.fp + n0.fn)::double, 6) end as compare_f1 from (select theme_id from model_runs where model_version = 'tfidf_v2') r left join m0 using (theme_id) left join n0 using (theme_id)""")
def q_compare(*t):
    return evaluate_run(*t, "tfidf_v2", "tfidf_v1").select("theme_id", "n_units", "f1", "compare_units", "compare_f1")


@query("g5_gold_items", "item_reviews", "themes", oracle=f"with {_GOLD} select theme_id, item_id from gold")
def q_gold_items(item_reviews, themes):
    return gold_items(item_reviews, themes).select("theme_id", "item_id")
