"""Model-coded turns: samples, requests, checked answers, the codebook as a prompt, and answers against gold labels."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.corpus import _words, segmented, segments_sql
from textloom.operators.ranking import precision_recall, wilson
from textloom.plans.graph import written
from textloom.registry import query

# ------------------------------------------------------------------ joins of turns and labels


@query("j14_turn_labels", "turns", "themes", oracle=rf"""with recursive {segments_sql("select item_id, turn_index as k, speaker_name as speaker, content from turns")}, m as (select item_id, item_id || ':' || printf('%04d', seg_index) as segment_id, seg_index, unnest(string_split(turns, ';'))::bigint as turn_index from seg)
    select item_id, turn_index, segment_id, theme_id, case when (seg_index + length(theme_id)) % 3 = 0 then 'pos' else 'neg' end as label from m cross join (select theme_id from themes where status = 'active') where (seg_index + length(theme_id)) % 2 = 1""")
def q_turn_labels(turns, themes):
    """The turn map joined to labels; here every second segment and theme has one, by the segment's number."""
    s = segmented(turns)
    n = F.col("seg_index") + F.length("theme_id")
    labels = s.select("segment_id", "seg_index").crossJoin(F.broadcast(themes.filter("status = 'active'").select("theme_id"))).filter(n % 2 == 1)  # a codebook of themes
    labels = labels.select("segment_id", "theme_id", F.when(n % 3 == 0, "pos").otherwise("neg").alias("label"))
    return turn_labels(s.select("item_id", F.explode(F.col("turns").cast("array<bigint>")).alias("turn_index"), "segment_id"), labels)


def turn_labels(turn_map: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of segments on the turns that each segment was made of."""
    return turn_map.join(labels, "segment_id").select("item_id", "turn_index", "segment_id", "theme_id", "label")


@query("j17_coded_turns", "coded_turns", "turns", oracle=rf"""select comment_id, primary_topic_id, turn_index, {_words("content")}::bigint as words from coded_turns c left join turns t on t.item_id = c.interview_id and t.turn_index = c.turn_id""")
def coded_turns(coded, turns):
    """Coded turns with their source turn."""
    t = turns.select(F.col("item_id").alias("interview_id"), F.col("turn_index").alias("turn_id"), "turn_index", T.word_count("content").alias("words"))
    return coded.join(t, ["interview_id", "turn_id"], "left").select("comment_id", "primary_topic_id", "turn_index", "words")


# ------------------------------------------------------------------ pilot evaluation


def against_gold(coded: DataFrame, gold: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Model answers, primary answers only, and the classifier's scores, each against gold, by theme.

    Gold counts on turns of items read in full that may be used and that no rule
    coded.  ``gold``: comment_id, theme_id, gold, score, gold_set, eval_exclude;
    ``thresholds``: theme_id, threshold (a theme without one has no baseline).
    """
    d = coded.filter("coded_by <> 'rule'").join(gold.filter("gold_set = 'read_in_full' and not eval_exclude and gold in ('pos', 'neg')"), "comment_id").join(F.broadcast(thresholds.select("theme_id", "threshold")), "theme_id", "left")
    y = F.col("gold") == "pos"
    said = {"any": (F.col("primary_topic_id") == F.col("theme_id")) | (F.col("secondary_topic_id") == F.col("theme_id")), "primary": F.col("primary_topic_id") == F.col("theme_id"), "baseline": F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))}
    by = F.explode(F.array(*(F.struct(F.lit(k).alias("judge"), c.alias("yes")) for k, c in said.items())))
    yes = F.col("j.yes")
    s = d.select("theme_id", y.alias("y"), by.alias("j")).groupBy("theme_id", "j.judge").agg(F.count("*").alias("n_turns"), F.count_if("y").alias("n_pos"), F.count_if(yes & F.col("y")).alias("tp"), F.count_if(yes & ~F.col("y")).alias("fp"), F.count_if(~yes & F.col("y")).alias("fn"))
    p, r, f1 = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return s.select("*", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f1, 3).alias("f1"), F.round(low, 3).alias("precision_low"), F.round(high, 3).alias("precision_high"))


_GOLD = "ev as (select *, primary_topic_id = theme_id or secondary_topic_id = theme_id as any_hit, primary_topic_id = theme_id as primary_hit, coalesce(score >= threshold, false) as baseline_hit from coded_turns join turn_gold using (comment_id) left join (select theme_id, threshold from model_runs where model_version = 'tfidf_v2') using (theme_id) where coded_by <> 'rule' and gold_set = 'read_in_full' and not eval_exclude and gold in ('pos', 'neg'))"


@query("g8_model_against_gold", "coded_turns", "turn_gold", "model_runs", oracle=f"""with {_GOLD}, l as (select theme_id, gold, judge, yes from (select theme_id, gold, any_hit as "any", primary_hit as "primary", baseline_hit as baseline from ev) unpivot (yes for judge in ("any", "primary", baseline))),
    s as (select theme_id, judge, count(*)::bigint as n_turns, count(*) filter (gold = 'pos')::bigint as n_pos, count(*) filter (yes and gold = 'pos')::bigint as tp, count(*) filter (yes and gold = 'neg')::bigint as fp, count(*) filter (not yes and gold = 'pos')::bigint as fn from l group by 1, 2)
    select *, round(tp / nullif(tp + fp, 0)::double, 3) as precision, round(tp / nullif(tp + fn, 0)::double, 3) as recall, case when tp > 0 then round(2.0 * tp / (2 * tp + fp + fn)::double, 3) end as f1,
      case when tp + fp > 0 then round(greatest(0.0, (tp / (tp + fp)::double + 3.8416 / (2 * (tp + fp)) - 1.96 * sqrt(tp / (tp + fp)::double * (1 - tp / (tp + fp)::double) / (tp + fp) + 3.8416 / (4.0 * (tp + fp) * (tp + fp)))) / (1 + 3.8416 / (tp + fp))), 3) end as precision_low,
      case when tp + fp > 0 then round(least(1.0, (tp / (tp + fp)::double + 3.8416 / (2 * (tp + fp)) + 1.96 * sqrt(tp / (tp + fp)::double * (1 - tp / (tp + fp)::double) / (tp + fp) + 3.8416 / (4.0 * (tp + fp) * (tp + fp)))) / (1 + 3.8416 / (tp + fp))), 3) end as precision_high from s""")
def q_against_gold(coded, gold, model_runs):
    return against_gold(coded, gold, model_runs.filter("model_version = 'tfidf_v2'"))


@query("g8_disagreements", "coded_turns", "turn_gold", "model_runs", oracle=f"with {_GOLD} select theme_id, comment_id, case when any_hit then 'model_yes_gold_no' else 'model_no_gold_yes' end as kind, confidence from ev where any_hit <> (gold = 'pos')")
def disagreements(coded, gold, model_runs):
    d = coded.filter("coded_by <> 'rule'").join(gold.filter("gold_set = 'read_in_full' and not eval_exclude and gold in ('pos', 'neg')"), "comment_id")
    yes = (F.col("primary_topic_id") == F.col("theme_id")) | (F.col("secondary_topic_id") == F.col("theme_id"))
    return d.withColumn("yes", yes).filter(F.col("yes") != (F.col("gold") == "pos")).select("theme_id", "comment_id", F.when(F.col("yes"), "model_yes_gold_no").otherwise("model_no_gold_yes").alias("kind"), "confidence")


BANDS = (0.0, 0.5, 0.7, 0.85, 1.0001)


@query("g8_confidence_bands", "coded_turns", "turn_gold", "model_runs", oracle=f"with {_GOLD}, b as (select * from (values (0.0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.0001)) as t(low, high)) select low::double as low, count(theme_id)::bigint as n, round(avg((gold = 'pos')::int), 3) as share_correct from b left join (select * from ev where primary_hit) on confidence >= low and confidence < high group by 1")
def confidence_bands(coded, gold, model_runs):
    """Primary answers on gold turns: how many are right, by band of confidence; empty bands stay."""
    d = coded.filter("coded_by <> 'rule'").join(gold.filter("gold_set = 'read_in_full' and not eval_exclude and gold in ('pos', 'neg')"), "comment_id").filter("primary_topic_id = theme_id")
    band = F.when(F.lit(False), 0.0)
    for low, high in zip(BANDS, BANDS[1:]):
        band = band.when((F.col("confidence") >= low) & (F.col("confidence") < high), low)
    n = d.groupBy(band.alias("low")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == "pos").cast("int")), 3).alias("share_correct"))
    grid = coded.sparkSession.createDataFrame([(x,) for x in BANDS[:-1]], "low double")
    return grid.join(n, "low", "left").select("low", F.coalesce("n", F.lit(0)).alias("n"), "share_correct")


@query("a26_topic_distribution", "coded_turns", "topics", oracle="""select topic_id, name, origin, count(c.comment_id) filter (primary_topic_id = topic_id)::bigint as "primary", count(c.comment_id) filter (secondary_topic_id = topic_id)::bigint as secondary, round(count(c.comment_id) filter (primary_topic_id = topic_id) / (select count(*) from coded_turns)::double, 3) as primary_share from topics left join coded_turns c on primary_topic_id = topic_id or secondary_topic_id = topic_id group by 1, 2, 3""")
def topic_distribution(coded, topics):
    """Of every topic how often it comes first and second, and the share of turns where it comes first."""
    one = lambda c, n: coded.groupBy(F.col(c).alias("topic_id")).agg(F.count("*").alias(n))
    d = topics.select("topic_id", "name", "origin").join(one("primary_topic_id", "primary"), "topic_id", "left").join(one("secondary_topic_id", "secondary"), "topic_id", "left").na.fill(0)
    return d.crossJoin(F.broadcast(coded.agg(F.count("*").alias("total")))).select("topic_id", "name", "origin", "primary", "secondary", F.round(F.coalesce(F.try_divide("primary", "total"), F.lit(0.0)), 3).alias("primary_share"))


@query("a27_pilot_summary", "coded_turns", "turn_gold", oracle="""select count(*)::bigint as turns_coded, count(*) filter (coded_by <> 'rule')::bigint as by_model, count(*) filter (coded_by = 'rule')::bigint as by_rule, count(*) filter (coded_by <> 'rule' and secondary_topic_id <> 'none')::bigint as with_secondary, round(avg(confidence) filter (coded_by <> 'rule'), 3) as mean_confidence,
    count(*) filter (coded_by <> 'rule' and comment_id in (select comment_id from turn_gold where gold_set = 'read_in_full' and not eval_exclude))::bigint as eval_turns from coded_turns""")
def pilot_summary(coded, gold):
    ok = gold.filter("gold_set = 'read_in_full' and not eval_exclude").select("comment_id").distinct().withColumn("ok", F.lit(True))
    model = F.col("coded_by") != "rule"
    return coded.join(ok, "comment_id", "left").agg(
        F.count("*").alias("turns_coded"), F.count_if(model).alias("by_model"), F.count_if(~model).alias("by_rule"), F.count_if(model & (F.col("secondary_topic_id") != "none")).alias("with_secondary"),
        F.round(F.avg(F.when(model, F.col("confidence"))), 3).alias("mean_confidence"), F.count_if(model & F.coalesce("ok", F.lit(False))).alias("eval_turns"),
    )


USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


@query("a25_usage_totals", "llm_usage", oracle="select " + ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in USAGE) + " from llm_usage")
def usage_totals(records):
    return records.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in USAGE))


# ------------------------------------------------------------------ samples


def _ranked(d: DataFrame, key: str, order: Column, buckets: int = 64) -> DataFrame:
    """``d`` with ``nth``: a row's place (1 is first) among those of its key, in the order of a hash.

    Hash ranges are counted first, so no task sorts a whole key.
    """
    d = d.withColumn("place", order).withColumn("range", F.conv(F.substring("place", 1, 2), 16, 10).cast("int") % buckets)
    d = d.withColumn("range", F.floor(F.conv(F.substring("place", 1, 2), 16, 10).cast("int") * buckets / 256).cast("int"))
    n = d.groupBy(key, "range").agg(F.count("*").alias("in_range"))
    n = n.withColumn("before", F.coalesce(F.sum("in_range").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_range")
    own = F.row_number().over(Window.partitionBy(key, "range").orderBy("place"))
    return d.withColumn("own", own).join(n, [key, "range"]).withColumn("nth", F.col("own") + F.col("before")).drop("own", "before", "range", "place")


def _draw(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string")))


def draw_sample(turns: DataFrame, ranks: DataFrame, themes: int, n: int = 1500, seeded_share: float = 0.3, floor: int = 200, least_words: int = 20, seed: str = "sample", batch: int = 100) -> DataFrame:
    """A stratified sample of turns (a sampling operator): comment_id, stratum, top_theme, company, batch.

    ``seeded_share`` of it comes from turns whose best percentile over the themes
    is 0.9 or more, as many a theme; the rest by companies' shares with a floor,
    rescaled to the size.  ``turns``: comment_id, company, word_count, gold_set;
    ``ranks``: comment_id, theme_id, pct.  Turns of items read in full stay out.
    """
    best = ranks.groupBy("comment_id").agg(F.max(F.struct("pct", F.negative(F.xxhash64("theme_id")).alias("tie"), "theme_id")).alias("m")).select("comment_id", F.col("m.pct").alias("max_pct"), F.col("m.theme_id").alias("top_theme"))
    pool = turns.filter((F.col("word_count") >= least_words) & (F.coalesce("gold_set", F.lit("")) != "read_in_full")).select("comment_id", "company").join(best, "comment_id", "left")
    per_theme = int(n * seeded_share) // max(1, themes)
    seeded = _ranked(pool.filter("max_pct >= 0.9"), "top_theme", _draw(seed, "comment_id")).filter(F.col("nth") <= per_theme).drop("nth")
    seeded = written(seeded.select("comment_id", "company", "top_theme", F.lit("seeded").alias("stratum")))
    n_random = n - seeded.count()
    rest = pool.join(seeded.select("comment_id"), "comment_id", "left_anti")
    # A row a company: its share with the floor, then scaled back.
    share = rest.groupBy("company").agg(F.count("*").alias("k"))
    total = Window.partitionBy()
    share = share.withColumn("take", F.greatest(F.rint(F.col("k") / F.sum("k").over(total) * n_random), F.lit(float(floor))))
    share = share.withColumn("take", F.rint(F.col("take") * n_random / F.sum("take").over(total)).cast("long")).select("company", "take")
    random = _ranked(rest, "company", _draw(seed, "comment_id")).join(share, "company").filter(F.col("nth") <= F.col("take")).select("comment_id", "company", F.lit(None).cast("string").alias("top_theme"), F.lit("random").alias("stratum"))
    both = seeded.unionByName(random)  # at most the sample's size and a company's rounding
    place = F.row_number().over(Window.orderBy(_draw(seed + " order", "comment_id"))) - 1
    return both.withColumn("batch", F.floor(place / batch))


_POOL = rf"""tu as (select comment_id, company, {_words("body")} as word_count, conv_id_n as c, case when conv_id_n % 3 = 0 then 'read_in_full' else '' end as gold_set from (select *, interview_id::bigint as conv_id_n from coded_turns)),
    rk as (select comment_id, theme_id, (rank() over (partition by theme_id order by score) + (count(*) over (partition by theme_id, score) - 1) / 2.0) / count(*) over (partition by theme_id) as pct from turn_gold),
    be as (select comment_id, pct as max_pct, theme_id as top_theme from rk qualify row_number() over (partition by comment_id order by pct desc, theme_id) = 1),
    po as (select comment_id, company, max_pct, top_theme from tu left join be using (comment_id) where word_count >= 20 and gold_set <> 'read_in_full'),
    se as (select * from po where max_pct >= 0.9 qualify row_number() over (partition by top_theme order by md5('sample|' || comment_id)) <= 9),
    re as (select * from po where comment_id not in (select comment_id from se)), nr as (select 60 - (select count(*) from se) as n),
    s1 as (select company, greatest(round_even(count(*) / (select count(*) from re)::double * (select n from nr), 0), 10.0) as take from re group by 1), s2 as (select company, round_even(take * (select n from nr) / (select sum(take) from s1), 0) as take from s1),
    ra as (select re.* from re join s2 using (company) qualify row_number() over (partition by company order by md5('sample|' || comment_id)) <= take)"""


def _sample_inputs(coded, gold):
    turns = coded.select("comment_id", "company", T.word_count("body").alias("word_count"), F.when(F.col("interview_id").cast("long") % 3 == 0, "read_in_full").otherwise("").alias("gold_set"))
    by, tied = Window.partitionBy("theme_id"), Window.partitionBy("theme_id", "score")
    pct = (F.rank().over(by.orderBy("score")) + (F.count("*").over(tied) - 1) / 2) / F.count("*").over(by)
    return turns, gold.select("comment_id", "theme_id", pct.alias("pct"))


@query("m18_stratified_sample", "coded_turns", "turn_gold", oracle=f"with {_POOL} select comment_id, 'seeded' as stratum from se union all select comment_id, 'random' from ra")
def q_sample(coded, gold):
    turns, ranks = _sample_inputs(coded, gold)
    return draw_sample(turns, ranks, 2, n=60, floor=10).select("comment_id", "stratum")


@query("w12_batches", "coded_turns", "turn_gold", oracle=f"with {_POOL}, al as (select comment_id from se union all select comment_id from ra) select comment_id, ((row_number() over (order by md5('sample order|' || comment_id)) - 1) // 20)::bigint as batch from al")
def q_batches(coded, gold):
    turns, ranks = _sample_inputs(coded, gold)
    return draw_sample(turns, ranks, 2, n=60, floor=10, batch=20).select("comment_id", "batch")


@query("m19_interview_pick", "coded_turns", "turn_gold", oracle="""with g as (select interview_id, any_value(company) as company, max(gold_set) as gold_set, count(distinct comment_id) filter (coded_by <> 'rule') as n from coded_turns join turn_gold using (comment_id) group by 1)
    select interview_id, 'gold' as why from g where gold_set = 'read_in_full' union all (select interview_id, 'random' from g where gold_set <> 'read_in_full' and n >= 2 qualify row_number() over (partition by company order by md5('pick|' || interview_id)) <= 3)""")
def q_pick(coded, gold):
    sets = gold.groupBy("comment_id").agg(F.max("gold_set").alias("gold_set"))
    return interview_pick(coded.join(sets, "comment_id"), least=2)


def interview_pick(turns: DataFrame, least: int = 10, n: int = 3, seed: str = "pick") -> DataFrame:
    """Items for a pilot (a sampling operator): all read in full, and of each company ``n`` others with at least ``least`` turns to code."""
    g = turns.groupBy("interview_id").agg(F.first("company").alias("company"), F.max("gold_set").alias("gold_set"), F.count_if(F.col("coded_by") != "rule").alias("n"))
    others = _ranked(g.filter((F.col("gold_set") != "read_in_full") & (F.col("n") >= least)), "company", _draw(seed, "interview_id")).filter(F.col("nth") <= n)
    return g.filter("gold_set = 'read_in_full'").select("interview_id", F.lit("gold").alias("why")).unionByName(others.select("interview_id", F.lit("random").alias("why")))


# ------------------------------------------------------------------ requests and answers

TARGETS, TARGET_WORDS, CONTEXT = 25, 5000, 4


def request_chunks(turns: DataFrame, targets: int = TARGETS, words: int = TARGET_WORDS, context: int = CONTEXT) -> DataFrame:
    """Requests: greedy runs of an item's turns to code, with the turns before them as context.

    ``turns``: item_id, turn_index, word_count, target.  Returns item_id, chunk,
    first (the first turn shown), last, targets (turn indices).  A fold over the
    item's targets; a closed chunk is a pair of places, so little is copied.
    """
    d = turns.filter("target").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn_index").cast("long").alias("i"), F.col("word_count").cast("long").alias("w")))).alias("t"))
    one = "struct<at:int,k:int>"
    close = f"concat(a.done, array(cast(named_struct('at', a.at, 'k', a.k) as {one})))"
    fold = f"""aggregate(t, named_struct('done', cast(array() as array<{one}>), 'at', 1, 'k', 0, 'w', 0L), (a, x) ->
        case when a.k > 0 and (a.k >= {targets} or a.w + x.w > {words}) then named_struct('done', {close}, 'at', a.at + a.k, 'k', 1, 'w', x.w)
             else named_struct('done', a.done, 'at', a.at, 'k', a.k + 1, 'w', a.w + x.w) end, a -> {close})"""
    c = d.select("item_id", "t", F.posexplode(F.expr(fold)).alias("chunk", "c"))
    own = F.transform(F.slice("t", F.col("c.at"), F.col("c.k")), lambda x: x["i"])
    start = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), own[0] - context)).cast("long")
    return c.select("item_id", F.col("chunk").cast("long").alias("chunk"), start.alias("first"), F.element_at(own, -1).alias("last"), own.alias("targets"))


@query("m20_request_chunks", "turns", oracle=rf"""with recursive t as (select item_id, turn_index, {_words("content")} as w, row_number() over (partition by item_id order by turn_index) as j from turns where speaker_name = 'assistant'),
    f as (select item_id, j, 0 as chunk, 1 as k, w as total from t where j = 1 union all select t.item_id, t.j, case when f.k >= 2 or f.total + t.w > 200 then f.chunk + 1 else f.chunk end, case when f.k >= 2 or f.total + t.w > 200 then 1 else f.k + 1 end, case when f.k >= 2 or f.total + t.w > 200 then t.w else f.total + t.w end from f join t on t.item_id = f.item_id and t.j = f.j + 1)
    select item_id, chunk::bigint as chunk, case when min(chunk) = 0 then 0 else greatest(0, min(turn_index) - 1) end::bigint as first, max(turn_index)::bigint as last, string_agg(turn_index::varchar, ';' order by turn_index) as targets from f join t using (item_id, j) group by 1, 2""")
def q_chunks(turns):
    """Chunks of at most two turns and 200 words, with one turn before."""
    t = turns.select("item_id", "turn_index", T.word_count("content").alias("word_count"), (F.col("speaker_name") == "assistant").alias("target"))
    return request_chunks(t, 2, 200, 1).withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ";"))


def render_chunks(chunks: DataFrame, turns: DataFrame, most_words: int = 60) -> DataFrame:
    """(item_id, chunk, text): the transcript part of each request; turns to code are marked, the others are clipped."""
    c = chunks.join(turns.select("item_id", "turn_index", "speaker_name", "content"), "item_id").filter("turn_index between first and last")
    code = F.array_contains("targets", F.col("turn_index").cast("long"))
    line = F.when(code, F.concat(F.lit('<turn id="'), F.col("turn_index").cast("string"), F.lit('" speaker="'), "speaker_name", F.lit('" code="yes">'), "content", F.lit("</turn>")))
    line = line.otherwise(F.concat(F.lit('<turn speaker="'), "speaker_name", F.lit('">'), T.clip_words(F.col("content"), most_words), F.lit("</turn>")))
    g = c.groupBy("item_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn_index", line.alias("l")))).alias("x"), F.first("first").alias("first"), F.first("targets").alias("targets"))
    omitted = F.when(F.col("first") > 0, "[... earlier turns omitted ...]\n").otherwise("")
    ask = F.concat(F.lit("\n\nCode these "), F.size("targets").cast("string"), F.lit(" turns, each exactly once: "), F.array_join(F.col("targets").cast("array<string>"), ", "))
    return g.select("item_id", "chunk", F.concat(omitted, F.array_join(F.transform("x", lambda t: t["l"]), "\n"), ask).alias("text"))


def check_answers(answers: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers to what was asked (rows), what has no answer (missing), and notes on the rest.

    ``answers``: comment_id, position, primary_topic_id, secondary_topic_id,
    confidence; ``asked``: comment_id.  Of repeated ids the first counts; a
    secondary topic equal to the primary is none; confidence is kept in 0 to 1.
    """
    wanted = asked.select("comment_id").distinct()
    known = answers.join(wanted, "comment_id", "left_semi")
    first = known.groupBy("comment_id").agg(F.min(F.struct("position", "primary_topic_id", "secondary_topic_id", "confidence")).alias("a"))
    second = F.when(F.col("a.secondary_topic_id") == F.col("a.primary_topic_id"), "none").otherwise(F.col("a.secondary_topic_id"))
    rows = first.select("comment_id", F.col("a.primary_topic_id").alias("primary_topic_id"), second.alias("secondary_topic_id"), F.least(F.greatest(F.col("a.confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    missing = wanted.join(rows.select("comment_id"), "comment_id", "left_anti")
    extra = answers.join(wanted, "comment_id", "left_anti").select("comment_id", F.lit("unrequested id dropped").alias("note"))
    twice = known.groupBy("comment_id").agg(F.count("*").alias("n")).filter("n > 1").select("comment_id", F.lit("duplicate id: kept the first").alias("note"))
    return rows, missing, extra.unionByName(twice)


_ANSWERS = "an as (select comment_id, 0 as position, primary_topic_id, case when turn_id % 3 = 0 then primary_topic_id else secondary_topic_id end as secondary_topic_id, confidence * 1.5 - 0.2 as confidence from coded_turns where turn_id % 5 <> 1 union all select comment_id, 1, 'other', 'none', 0.5 from coded_turns where turn_id % 2 = 1 union all select 'x' || comment_id, 0, 'other', 'none', 0.5 from coded_turns where turn_id = 3)"


@query("m21_response_check", "answers", "coded_turns", oracle=f"""with {_ANSWERS}, fi as (select * from an where comment_id in (select comment_id from coded_turns) qualify row_number() over (partition by comment_id order by position) = 1)
    select comment_id, primary_topic_id, case when secondary_topic_id = primary_topic_id then 'none' else secondary_topic_id end as secondary_topic_id, round(least(greatest(confidence, 0), 1), 6)::double as confidence from fi""")
def q_check(answers, coded):
    return check_answers(answers, coded)[0].withColumn("confidence", F.round("confidence", 6))


@query("m21_response_problems", "answers", "coded_turns", oracle=f"""with {_ANSWERS} select comment_id, 'missing' as note from coded_turns where comment_id not in (select comment_id from an) union all select comment_id, 'unrequested id dropped' from an where comment_id not in (select comment_id from coded_turns)
    union all select comment_id, 'duplicate id: kept the first' from an where comment_id in (select comment_id from coded_turns) group by 1 having count(*) > 1""")
def q_problems(answers, coded):
    _, missing, notes = check_answers(answers, coded)
    return missing.select("comment_id", F.lit("missing").alias("note")).unionByName(notes)


def replayed(requests: DataFrame, records: DataFrame | None, call=None) -> DataFrame:
    """Answers to requests (key, text): recorded ones are read back by key, others asked for with ``call(text) -> str`` in the tasks.

    Returns key, answer and recorded; without ``call`` a request without a record has no answer.
    """
    done = records.select("key", "answer") if records is not None else requests.sparkSession.createDataFrame([], "key string, answer string")
    d = requests.join(done, "key", "left").withColumn("recorded", F.col("answer").isNotNull())
    if call is None:
        return d.select("key", "answer", "recorded")

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            answers = [a if a is not None else call(t) for a, t in zip(b.column("answer").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "answer": pa.array(answers, pa.string()), "recorded": b.column("recorded")})

    return d.select("key", "text", "answer", "recorded").mapInArrow(ask, "key string, answer string, recorded boolean")


# ------------------------------------------------------------------ the codebook as a prompt


@query("x21_stale_references", "topics", oracle=r"""with w as (select topic_id, field, unnest(list_distinct(regexp_extract_all(body, '\b[a-z]+(?:_[a-z]+)+\b'))) as word from (select topic_id, description, include, "exclude", boundary_notes from topics) unpivot (body for field in (description, include, "exclude", boundary_notes)))
    select topic_id, field, word from w where word not in (select topic_id from topics)""")
def stale_references(topics):
    """Words in a topic's text that look like topic ids (a_b) and are none."""
    fields = ("description", "include", "exclude", "boundary_notes")
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("")).alias("body")) for f in fields)))
    d = topics.select("topic_id", one.alias("f")).select("topic_id", "f.field", F.explode(F.array_distinct(F.regexp_extract_all("f.body", F.lit(r"\b[a-z]+(?:_[a-z]+)+\b"), F.lit(0)))).alias("word"))
    return d.join(topics.select(F.col("topic_id").alias("word")), "word", "left_anti").select("topic_id", "field", "word")


KINDS = {"seed": "researcher theme", "emergent": "emergent topic", "fixed": "fallback"}


def render_codebook(topics: list[dict], most_words: int = 80) -> str:
    """Topics in prompt order as marked-up text."""
    clip = lambda t: t if len(t.split()) <= most_words else " ".join(t.split()[:most_words]) + " [...]"
    out = []
    for t in topics:
        parts = [f'<topic id="{t["topic_id"]}" name="{t["name"]}" kind="{KINDS[t["origin"]]}">', f"<definition>{t['description']}</definition>"]
        parts += [f"<{k}>{t[k]}</{k}>" for k in ("include", "exclude", "boundary_notes") if t.get(k)]
        parts += [f"<example>{clip(x)}</example>" for x in t.get("examples", ())] + [f"<not_this_topic>{clip(x)}</not_this_topic>" for x in t.get("not_examples", ())]
        out.append("\n".join([*parts, "</topic>"]))
    return "\n\n".join(out)


def load_codebook(topics: DataFrame) -> tuple[list[dict], str, str]:
    """Topics in order, their prompt text and its version; an id that two topics have is an error."""
    rows = [r.asDict() for r in topics.orderBy("position").collect()]  # a codebook
    ids = [t["topic_id"] for t in rows]
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise ValueError(f"topic ids that stand more than once: {twice}")
    text = render_codebook(rows)
    return rows, text, "cb_" + hashlib.sha256(text.encode("utf-8")).hexdigest()[:12]


@query("m23_codebook_prompt", "topics")
def q_codebook_prompt(topics):
    rows, text, version = load_codebook(topics)
    return topics.sparkSession.createDataFrame([(len(rows), len(text), version)], "topics long, chars long, version string")


def resolve_codebook(examples: DataFrame, labels: DataFrame, turns: DataFrame) -> DataFrame:
    """A codebook's examples against current labels: usable or not, and what is wrong.

    ``examples``: topic_id, kind (exemplar or near_miss), comment_id; ``labels``:
    comment_id, theme_id, gold; ``turns``: comment_id, role.  An example that was
    judged not to be the theme can't be used; one that nobody judged can, and is
    reported; a near miss that is now coded can't.
    """
    d = examples.join(turns.select("comment_id", "role"), "comment_id", "left").join(labels.select("comment_id", F.col("theme_id").alias("topic_id"), "gold"), ["comment_id", "topic_id"], "left")
    gold = F.coalesce("gold", F.lit("neutral"))
    issue = (
        F.when(F.col("role").isNull(), "not a turn in the exports")
        .when((F.col("kind") == "exemplar") & (gold == "neg"), "judged not this theme")
        .when((F.col("kind") == "near_miss") & (gold == "pos"), "now coded with this theme")
        .when(F.col("role") != "answer", "not an answer turn")
        .when((F.col("kind") == "exemplar") & (gold == "neutral"), "not coded with this theme")
        .otherwise("")
    )
    bad = issue.isin("not a turn in the exports", "judged not this theme", "now coded with this theme")
    return d.select("topic_id", "kind", "comment_id", gold.alias("label_now"), issue.alias("issue"), (~bad).alias("usable"))


_EXAMPLES = "ex as (select primary_topic_id as topic_id, case when turn_id % 2 = 1 then 'exemplar' else 'near_miss' end as kind, case when turn_id = 5 then 'gone' || comment_id else comment_id end as comment_id, case when turn_id % 7 = 3 then 'question' else 'answer' end as role from coded_turns where primary_topic_id like 's__%')"


@query("m24_resolve_codebook", "coded_turns", "turn_gold", oracle=f"""with {_EXAMPLES}, r as (select ex.topic_id, kind, ex.comment_id, coalesce(gold, 'neutral') as label_now, case when t.comment_id is null then 'not a turn in the exports' when kind = 'exemplar' and coalesce(gold, 'neutral') = 'neg' then 'judged not this theme' when kind = 'near_miss' and coalesce(gold, 'neutral') = 'pos' then 'now coded with this theme'
      when t.role <> 'answer' then 'not an answer turn' when kind = 'exemplar' and coalesce(gold, 'neutral') = 'neutral' then 'not coded with this theme' else '' end as issue from ex left join (select comment_id, case when turn_id % 7 = 3 then 'question' else 'answer' end as role from coded_turns) t on t.comment_id = ex.comment_id left join turn_gold g on g.comment_id = ex.comment_id and g.theme_id = ex.topic_id)
    select *, issue not in ('not a turn in the exports', 'judged not this theme', 'now coded with this theme') as usable from r""")
def q_resolve(coded, gold):
    role = F.when(F.col("turn_id") % 7 == 3, "question").otherwise("answer")
    gone = F.when(F.col("turn_id") == 5, F.concat(F.lit("gone"), "comment_id")).otherwise(F.col("comment_id"))
    examples = coded.filter("primary_topic_id like 's__%'").select(F.col("primary_topic_id").alias("topic_id"), F.when(F.col("turn_id") % 2 == 1, "exemplar").otherwise("near_miss").alias("kind"), gone.alias("comment_id"))
    return resolve_codebook(examples, gold, coded.select("comment_id", role.alias("role")))


def draft_topics(proposed: DataFrame, sampled: DataFrame, taken: list[str]) -> DataFrame:
    """A draft of proposed topics: ids made plain (and told apart from those taken), examples kept only if they were sampled.

    ``proposed``: topic_id, name, examples (comment ids); ``sampled``: comment_id.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower("topic_id"), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")
    d = proposed.withColumn("topic_id", F.when(plain == "", "topic").otherwise(plain))
    again = F.row_number().over(Window.partitionBy("topic_id").orderBy("name")) + F.col("topic_id").isin(*taken).cast("int") if taken else F.row_number().over(Window.partitionBy("topic_id").orderBy("name"))
    d = d.withColumn("again", again).withColumn("topic_id", F.when(F.col("again") > 1, F.concat("topic_id", F.lit("_"), F.col("again").cast("string"))).otherwise(F.col("topic_id")))
    kept = d.select("topic_id", F.posexplode("examples").alias("at", "comment_id")).join(sampled.select("comment_id").distinct(), "comment_id", "left_semi")
    kept = kept.groupBy("topic_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "comment_id"))), lambda x: x["comment_id"]).alias("kept"))
    return d.join(kept, "topic_id", "left").select("topic_id", "name", F.coalesce("kept", F.array().cast("array<string>")).alias("examples"), (F.size("examples") - F.coalesce(F.size("kept"), F.lit(0))).cast("long").alias("dropped"))


@query("m25_draft_topics", "coded_turns", "sampled_turns", oracle="""with p as (select 'Topic ' || (turn_id % 4) || case when turn_id % 2 = 0 then '!' else '' end as topic_id, company as name, string_agg(comment_id, ',' order by comment_id) as all_ids, string_agg(comment_id, ',' order by comment_id) filter (turn_id % 3 <> 1) as kept, count(*) as n, count(*) filter (turn_id % 3 <> 1) as k from coded_turns group by 1, 2),
    q as (select *, regexp_replace(regexp_replace(lower(topic_id), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as id from p), r as (select *, row_number() over (partition by id order by name) + (id = 'topic_1')::int as again from q)
    select case when again > 1 then id || '_' || again::varchar else id end as topic_id, name, coalesce(kept, '') as examples, (n - k)::bigint as dropped from r""")
def q_draft(coded, sampled):
    name = F.concat(F.lit("Topic "), (F.col("turn_id") % 4).cast("string"), F.when(F.col("turn_id") % 2 == 0, "!").otherwise(""))
    p = coded.groupBy(name.alias("topic_id"), F.col("company").alias("name")).agg(F.sort_array(F.collect_list("comment_id")).alias("examples"))
    return draft_topics(p, sampled, ["topic_1"]).withColumn("examples", F.array_join("examples", ","))


_HEADING = re.compile(r"## (.+?) \(`([a-z0-9_]+)`\)\s*")
_FIELD = re.compile(r"\*\*(Definition|Include|Exclude|Boundary notes|Near misses)\.\*\*\s*(.*)")
_EXAMPLE = re.compile(r"- `(\d+_\d{4})`")
_COUNT = re.compile(r"~(\d+) of \d+ sampled turns\.\s*(?:Merged from:\s*(.*))?")


def parse_review(text: str) -> tuple[list[dict], list[str]]:
    """Topics of a reviewed draft in Markdown, and headings that are no topic."""
    lines = text.splitlines()
    begin = next((i for i, x in enumerate(lines) if x.startswith("## Model's overall notes")), 0)
    end = next((i for i, x in enumerate(lines) if x.startswith("## Dropped candidates")), len(lines))
    topics: list[dict] = []
    problems = []
    for raw in lines[begin:end]:
        if m := _HEADING.fullmatch(raw):
            topics.append({"topic_id": m[2], "name": m[1].strip(), "description": "", "include": "", "exclude": "", "boundary_notes": "", "near_misses": "", "examples": [], "approx_sample_turns": None, "merged_from": ""})
            continue
        if not topics:
            continue
        own, line = topics[-1], raw.strip()
        if m := _FIELD.fullmatch(line):
            own["description" if m[1] == "Definition" else m[1].lower().replace(" ", "_")] = m[2].strip()
        elif m := _EXAMPLE.match(line):
            own["examples"].append(m[1])
        elif m := _COUNT.fullmatch(line):
            own |= {"approx_sample_turns": int(m[1]), "merged_from": (m[2] or "").strip()}
        elif line.startswith("## "):
            problems.append(f"heading not read as a topic: {line}")
    return topics, problems


_TOPIC = "topic_id string, name string, description string, include string, exclude string, boundary_notes string, near_misses string, examples array<string>, approx_sample_turns long, merged_from string"


def read_reviews(texts: DataFrame) -> DataFrame:
    """Topics of reviewed drafts (path, value), one row a topic."""

    def parse(batches):
        import pyarrow as pa

        for b in batches:
            rows = [{"path": p} | t for p, v in zip(b.column("path").to_pylist(), b.column("value").to_pylist()) for t in parse_review(v or "")[0]]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), *((n, pa.string()) for n in ("topic_id", "name", "description", "include", "exclude", "boundary_notes", "near_misses")), ("examples", pa.list_(pa.string())), ("approx_sample_turns", pa.int64()), ("merged_from", pa.string())]))

    return texts.select("path", "value").mapInArrow(parse, "path string, " + _TOPIC)


@query("x24_review_topics", "topics", oracle="""select topic_id, name, description, string_agg('7_000' || (length(topic_id) % 10)::varchar, ',') as examples from topics group by 1, 2, 3""")
def q_reviews(topics):
    """Topics written as a review and read back."""
    example = F.concat(F.lit("7_000"), (F.length("topic_id") % 10).cast("string"))
    part = F.concat(F.lit("## "), "name", F.lit(" (`"), "topic_id", F.lit("`)\n\n**Definition.** "), "description", F.lit("\n\n- `"), example, F.lit("` a turn\n"))
    text = topics.agg(F.concat(F.lit("# Draft\n## Model's overall notes\nfine\n"), F.array_join(F.sort_array(F.collect_list(part)), "\n"), F.lit("\n## Dropped candidates\n## Gone (`gone`)\n")).alias("value"), F.lit("review.md").alias("path"))  # a codebook
    return read_reviews(text).select("topic_id", "name", "description", F.array_join("examples", ",").alias("examples"))


def choose_exemplars(candidates: DataFrame, most: int = 5, alike: float = 0.5, words: tuple[int, int] = (40, 180)) -> DataFrame:
    """Up to ``most`` exemplars a theme, one after another: from items not read in full
    first, then of companies and items not taken yet, then by out-of-fold score;
    passages like one taken go.  Returns theme_id, segment_id, place.

    ``candidates``: theme_id, segment_id, company, item_id, answer_only,
    n_themes, words, read_in_full, oof, text.  Each round is one aggregation.
    """
    c = candidates.filter(F.col("answer_only") & (F.col("n_themes") == 1) & F.col("words").between(*words))
    first = c.groupBy("theme_id", T.text_key(F.col("text")).alias("key")).agg(F.min("segment_id").alias("segment_id"))
    c = written(c.join(first.select("theme_id", "segment_id"), ["theme_id", "segment_id"], "left_semi").select("theme_id", "segment_id", "company", "item_id", "read_in_full", "oof", T.word_set(F.col("text")).alias("set"), F.array().cast("array<string>").alias("companies"), F.array().cast("array<string>").alias("items")))
    chosen = None
    for place in range(1, most + 1):
        novelty = (~F.array_contains("companies", F.col("company"))).cast("int") * 2 + (~F.array_contains("items", F.col("item_id"))).cast("int")
        order = F.struct(F.col("read_in_full").cast("int").alias("r"), (-novelty).alias("n"), (-F.col("oof")).alias("o"), "segment_id")
        pick = c.groupBy("theme_id").agg(F.min_by(F.struct("segment_id", "company", "item_id", "set"), order).alias("p"))
        pick = written(pick.select("theme_id", F.col("p.segment_id").alias("taken"), F.col("p.company").alias("its_company"), F.col("p.item_id").alias("its_item"), F.col("p.set").alias("its_set")))
        rows = pick.select("theme_id", F.col("taken").alias("segment_id"), F.lit(place).alias("place"))
        chosen = rows if chosen is None else chosen.unionByName(rows)
        c = c.join(F.broadcast(pick), "theme_id")  # a row a theme
        far = F.coalesce(T.jaccard(F.col("set"), F.col("its_set")), F.lit(0.0)) < alike
        c = written(c.filter((F.col("segment_id") != F.col("taken")) & far).select("theme_id", "segment_id", "company", "item_id", "read_in_full", "oof", "set", F.array_append("companies", F.col("its_company")).alias("companies"), F.array_append("items", F.col("its_item")).alias("items")))
    return chosen


@query("m16_exemplars", "coded_turns")
def q_exemplars(coded):
    c = coded.withColumns({"theme_id": F.col("primary_topic_id"), "segment_id": F.col("comment_id"), "item_id": F.col("interview_id"), "answer_only": F.lit(True), "n_themes": F.lit(1), "words": T.word_count("body"), "read_in_full": F.col("turn_id") % 2 == 0, "oof": F.col("confidence"), "text": F.col("body")})
    return choose_exemplars(c, words=(5, 400))
