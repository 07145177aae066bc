"""Further listings, ranks, selections and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.corpus import PARTS, SCOPE, scope, segmented, segments_sql
from textloom.operators.labels import _POS, _UP, closure, positives
from textloom.operators.ranking import _LATEST, latest_runs
from textloom.plans.sets import similar_sets
from textloom.registry import query


@query("p20_gold_tag", "items", "item_reviews", "labels", oracle="""select item_id, case when item_id in (select item_id from item_reviews where unmarked_at is null and read_in_full_confirmed_at is not null) then 'read_in_full' when doc_id in (select doc_id from labels where quality = 1) then 'positives_only' else '' end as tag from items""")
def gold_tag(items, item_reviews, labels):
    read = item_reviews.filter("unmarked_at is null and read_in_full_confirmed_at is not null").select("item_id").distinct().withColumn("read", F.lit(True))
    pos = labels.filter("quality = 1").select("doc_id").distinct().withColumn("pos", F.lit(True))
    d = items.join(read, "item_id", "left").join(pos, "doc_id", "left")
    return d.select("item_id", F.when(F.col("read"), "read_in_full").when(F.col("pos"), "positives_only").otherwise("").alias("tag"))


@query("p21_rule_rows", "turns", oracle=r"select item_id, turn_index, 'non_substantive' as topic, 1.0::double as confidence from turns where speaker_name = 'assistant' and len(regexp_extract_all(content, '[^\s\x{00a0}]+')) < 40")
def rule_rows(turns, words: int = 40):
    short = turns.filter((F.col("speaker_name") == "assistant") & (T.word_count("content") < words))
    return short.select("item_id", "turn_index", F.lit("non_substantive").alias("topic"), F.lit(1.0).alias("confidence"))


@query("j1_segment_metadata", "segments", "items", oracle="select segment_id, item_title, publish_date from segments left join items using (dataset_id, item_id)")
def segment_metadata(segments, items):
    return segments.join(items.select("dataset_id", "item_id", "item_title", "publish_date"), ["dataset_id", "item_id"], "left").select("segment_id", "item_title", "publish_date")


@query("j2_codes_with_names", "codes", "segments", "themes", oracle="select code_id, segment_id, name, group_name from codes join segments using (segment_id) join themes using (theme_id) where deleted_at is null")
def codes_with_names(codes, segments, themes):
    t = F.broadcast(themes.select("theme_id", "name"))
    return codes.filter("deleted_at is null").join(segments.select("segment_id", "group_name"), "segment_id").join(t, "theme_id").select("code_id", "segment_id", "name", "group_name")


@query("j13_turn_segment_map", "turns", oracle=f"with recursive {segments_sql('select item_id, turn_index as k, speaker_name as speaker, content from turns')} select item_id, unnest(string_split(turns, ';'))::bigint as turn_index, item_id || ':' || printf('%04d', seg_index) as segment_id from seg")
def turn_segment_map(turns):
    """(item_id, turn_index, segment_id): the turns that each segment was made of."""
    return segmented(turns).select("item_id", F.explode(F.col("turns").cast("array<bigint>")).alias("turn_index"), "segment_id")


@query("j16_unlabelled_grid", "segments", "themes", "codes", oracle="select s.segment_id, t.theme_id from segments s cross join themes t where t.status = 'active' and (s.segment_id, t.theme_id) not in (select segment_id, theme_id from codes)")
def unlabelled(segments, themes, codes):
    grid = segments.select("segment_id").crossJoin(F.broadcast(themes.filter("status = 'active'").select("theme_id")))  # a codebook of themes
    return grid.join(codes.select("segment_id", "theme_id").distinct(), ["segment_id", "theme_id"], "left_anti")


@query("j21_reasons", "codes", "predictions", oracle="""with r as (select segment_id, 'coded' as kind, theme_id from codes where deleted_at is null union select segment_id, 'predicted', theme_id from predictions where model_version = 'tfidf_v2' and score >= 0.9)
    select segment_id, string_agg(kind || ':' || theme_id, ',' order by kind, theme_id) as reasons from r group by 1""")
def reasons(codes, predictions):
    c = codes.filter("deleted_at is null").select("segment_id", F.lit("coded").alias("kind"), "theme_id")
    p = predictions.filter("model_version = 'tfidf_v2' and score >= 0.9").select("segment_id", F.lit("predicted").alias("kind"), "theme_id")
    all_of = F.sort_array(F.collect_set(F.concat("kind", F.lit(":"), "theme_id")))
    return c.unionByName(p).groupBy("segment_id").agg(F.array_join(all_of, ",").alias("reasons"))


@query("t4_dates_last", "items", oracle="select item_id, row_number() over (order by nullif(case when doc_id % 8 = 0 then '' else publish_date end, '') nulls last, doc_id) as position from items qualify position <= 100")
def dates_last(items, limit: int = 100):
    """The first page by date, empty dates last."""
    day = F.nullif(F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.col("publish_date")), F.lit(""))
    top = items.select("item_id", "doc_id", day.alias("day")).orderBy(F.asc_nulls_last("day"), "doc_id").limit(limit)  # the page
    return top.select("item_id", F.row_number().over(Window.orderBy(F.asc_nulls_last("day"), "doc_id")).cast("long").alias("position"))


@query("t5_best_reason", "predictions", oracle="select segment_id, max(score) as best from predictions where model_version = 'tfidf_v2' group by 1")
def best_reason(predictions):
    return predictions.filter("model_version = 'tfidf_v2'").groupBy("segment_id").agg(F.max("score").alias("best"))


@query("t7_same_person_chips", "items", oracle="select a.item_id, b.item_id as other from items a join items b on a.person_name = b.person_name and a.item_id <> b.item_id where a.item_id = '7' order by b.doc_id limit 12")
def same_person_chips(items, item: str = "7", limit: int = 12):
    """The first other items of one item's person."""
    one = items.filter(F.col("item_id") == item).select("person_name", F.col("item_id").alias("own"))
    near = items.join(F.broadcast(one), "person_name").filter("item_id <> own").orderBy("doc_id").limit(limit)
    return near.select(F.col("own").alias("item_id"), F.col("item_id").alias("other"))


@query("u5_intersection", "items", "item_reviews", "codes", oracle="select item_id from items where item_id in (select item_id from item_reviews where unmarked_at is null) and item_id in (select split_part(segment_id, ':', 1) from codes)")
def intersection(items, item_reviews, codes):
    marked = item_reviews.filter("unmarked_at is null").select("item_id")
    return items.select("item_id").intersect(marked).intersect(codes.select(F.split_part("segment_id", F.lit(":"), F.lit(1)).alias("item_id")))


@query("w6_top_terms", "documents", oracle=rf"""with t as (select lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) as term from documents), c as (select lang, term, count(*)::bigint as n from t group by 1, 2) select lang, term, n, row_number() over (partition by lang order by n desc, term) as rank from c qualify rank <= 20""")
def top_terms(documents, top: int = 20):
    c = documents.select("lang", F.explode(T.tokens("text")).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term")).cast("long")).filter(F.col("rank") <= top)


@query("m14_missing_embeddings", "segments", "embeddings", oracle="select segment_id from segments where doc_id not in (select vec_id from embeddings)")
def missing_embeddings(segments, embeddings):
    return segments.join(embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("segment_id")


@query("m17_twin_exclusion", "benchmark", oracle="""with w as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) as s from benchmark), h as (select item_id as h, s as hs from w where item_id < 5)
    select item_id from w where item_id >= 5 and not exists (select 1 from h where len(list_intersect(s, hs)) / len(list_distinct(list_concat(s, hs)))::double >= 0.5)""")
def twin_exclusion(benchmark, held: int = 5, least: float = 0.5):
    """Candidates unlike every held example."""
    w = benchmark.select(F.lit(0).alias("g"), F.col("item_id").alias("id"), T.word_set(F.col("text")).alias("words"))
    like = similar_sets(w.filter(F.col("id") >= held), w.filter(F.col("id") < held), least).select(F.col("a").alias("item_id"))
    return benchmark.filter(F.col("item_id") >= held).select("item_id").join(like, "item_id", "left_anti")


@query("f12_runs_page", "model_runs", "run_params", "pins", oracle="""select model_version, count(*)::bigint as themes, max(trained_at) as trained_at, max(json_extract_string(try_cast(params_json as json), '$.codebook.version')) as codebook, bool_or((model_version, theme_id) in (select model_version, theme_id from pins)) as pinned from model_runs left join run_params using (model_version) group by 1""")
def runs_page(model_runs, run_params, pins):
    d = model_runs.join(F.broadcast(run_params), "model_version", "left").join(F.broadcast(pins.withColumn("pin", F.lit(True))), ["model_version", "theme_id"], "left")
    return d.groupBy("model_version").agg(F.count("*").alias("themes"), F.max("trained_at").alias("trained_at"), F.max(F.get_json_object("params_json", "$.codebook.version")).alias("codebook"), F.bool_or(F.coalesce("pin", F.lit(False))).alias("pinned"))


@query("f18_compare_run", "model_runs", oracle=f"with {_LATEST} select model_version from model_runs where starts_with(model_version, 'tfidf_') and model_version not in (select model_version from latest where engine = 'tfidf') order by trained_at desc, model_version desc limit 1")
def compare_run(model_runs):
    """The newest TF-IDF run that is not any theme's latest."""
    now = latest_runs(model_runs).filter("engine = 'tfidf'").select("model_version")
    old = model_runs.filter(F.col("model_version").startswith("tfidf_")).join(now, "model_version", "left_anti")
    return old.orderBy(F.desc("trained_at"), F.desc("model_version")).limit(1).select("model_version")


@query("d25_overrides_upsert", "overrides", "override_updates", oracle="select o.item_id, o.dataset_id, coalesce(u.kind, o.kind) as kind, case when u.item_id is null then o.target_id else u.target_id end as target_id from overrides o left join override_updates u using (dataset_id, item_id)")
def overrides_upsert(overrides, updates):
    from textloom.operators.prepare import upsert

    for bad in updates.filter("kind not in ('include', 'exclude') or (kind = 'include' and target_id = item_id)").limit(1).collect():
        raise ValueError(f"no valid override: {bad}")
    return upsert(overrides.select("item_id", "dataset_id", "kind", "target_id"), updates.select("item_id", "dataset_id", "kind", "target_id"), "dataset_id", "item_id")


@query("d25_overrides_removed", "overrides", "override_updates", oracle="select item_id, kind from overrides where (dataset_id, item_id) not in (select dataset_id, item_id from override_updates)")
def overrides_removed(overrides, updates):
    return overrides.join(updates.select("dataset_id", "item_id"), ["dataset_id", "item_id"], "left_anti").select("item_id", "kind")


@query("d25_promoted", "auto_duplicates", "override_updates", oracle="""with p as (select canonical_id, min(item_id) as promoted from auto_duplicates where item_id in (select item_id from override_updates) group by 1) select a.item_id, coalesce(promoted, a.canonical_id) as canonical_id, a.item_id = coalesce(promoted, a.canonical_id) as is_canonical from auto_duplicates a left join p using (canonical_id)""")
def promoted(auto, chosen):
    """Clusters after members (of several the least) were made their canonical item: all others point to it."""
    p = auto.join(chosen.select("item_id"), "item_id", "left_semi").groupBy("canonical_id").agg(F.min("item_id").alias("promoted"))
    now = F.coalesce("promoted", "canonical_id")
    return auto.join(p, "canonical_id", "left").select("item_id", now.alias("canonical_id"), (F.col("item_id") == now).alias("is_canonical"))


@query("d29_inferred_labels", "segments", "codes", "negatives", "themes", oracle=f"with recursive {_UP}, {_POS} select segment_id, case when segment_id in (select segment_id from pos where theme_id = 's__any') then 'pos' when segment_id in (select segment_id from negatives where deleted_at is null) then 'neg' else 'neutral' end as label from segments")
def inferred_labels(segments, codes, negatives, themes, theme: str = "s__any"):
    pos = positives(codes, closure(themes)).filter(F.col("theme_id") == theme).select("segment_id", F.lit(1).alias("p"))
    neg = negatives.filter("deleted_at is null").select("segment_id").distinct().withColumn("n", F.lit(1))
    d = segments.select("segment_id").join(pos, "segment_id", "left").join(neg, "segment_id", "left")
    return d.select("segment_id", F.when(F.col("p").isNotNull(), "pos").when(F.col("n").isNotNull(), "neg").otherwise("neutral").alias("label"))


@query("p9_scope_rows", *PARTS, oracle=f"with {SCOPE} select segment_id, dataset_id, word_count, length(text)::bigint as chars from scope")
def scope_rows(*t):
    return scope(*t).select("segment_id", "dataset_id", "word_count", F.length("text").cast("long").alias("chars"))
