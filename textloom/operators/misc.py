"""Smaller operators: listings, twins, ledgers, summaries and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.corpus import _words, segmented, segments_sql
from textloom.operators.ranking import engine_of
from textloom.plans.vectors import alike
from textloom.registry import query


@query("a7_normalized_bar", "items", oracle="select person_name, count(*)::bigint as documents, round(sum(length(transcript_text)) / nullif(count(*), 0)::double, 6) as per_document from items group by 1")
def normalized_bar(items):
    n = F.count("*")
    return items.groupBy("person_name").agg(n.alias("documents"), F.round(F.try_divide(F.sum(F.length("transcript_text")), n), 6).alias("per_document"))


TWIN_JACCARD = 0.5


def twin_pairs(flagged: DataFrame, clusters: DataFrame, least: float = TWIN_JACCARD) -> DataFrame:
    """Pairs (theme_id, a, b, similarity) of flagged passages that look like one: of one
    person, or of items in one duplicate cluster, with word sets alike.

    ``flagged``: theme_id, segment_id, item_id, dataset_id, person_name, text; ``clusters``:
    dataset_id, item_id, cluster_id.  Passages of a person or cluster meet in tasks, part by part.
    """
    f = flagged.dropDuplicates(["theme_id", "segment_id"]).select("theme_id", "segment_id", "dataset_id", "item_id", F.nullif("person_name", F.lit("")).alias("person"), T.word_set(F.coalesce("text", F.lit(""))).alias("words"))
    c = clusters.select("dataset_id", "item_id", "cluster_id").dropDuplicates(["dataset_id", "item_id"])
    f = f.join(c, ["dataset_id", "item_id"], "left")
    of = lambda kind, name: F.struct("theme_id", F.lit(kind).alias("kind"), F.col(name).cast("string").alias("value"))
    f = f.select(F.explode(F.array(of("person", "person"), of("cluster", "cluster_id"))).alias("g"), F.col("segment_id").alias("id"), "words").filter("g.value is not null")
    return alike(f, least).select("g.theme_id", "a", "b", "similarity").distinct()


def flagged_rows(codes, negatives, segments, kind: str) -> DataFrame:
    """Active flagged rows of a kind (exemplar, near_miss), one a segment and theme, the oldest, with the segment's columns."""
    table, flag, number = {"exemplar": (codes, "is_exemplar", "code_id"), "near_miss": (negatives, "is_near_miss", "negative_id")}[kind]
    oldest = table.filter(F.col("deleted_at").isNull() & F.col(flag)).groupBy("theme_id", "segment_id").agg(F.min(number).alias("flag_id"))
    return oldest.join(segments.select("segment_id", "dataset_id", "item_id", "group_name", "person_name", "speaker_role", "text"), "segment_id")


_CLUSTERS = "clu as (select dataset_id, item_id, any_value(canonical_id) as cluster_id from auto_duplicates group by 1, 2)"
_FLAGGED = "fl as (select c.theme_id, c.segment_id, min(c.code_id) as flag_id, any_value(person_name) as person_name, any_value(cluster_id) as cluster_id, any_value(list_distinct(regexp_extract_all(lower(text), '[a-z'']+'))) as w from codes c join segments using (segment_id) left join clu using (dataset_id, item_id) where deleted_at is null and is_exemplar group by 1, 2)"
_TWINS = """tw as (select a.theme_id, a.segment_id as a, b.segment_id as b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::double as similarity from fl a join fl b on a.theme_id = b.theme_id and a.segment_id < b.segment_id
      and ((a.person_name <> '' and a.person_name = b.person_name) or a.cluster_id = b.cluster_id) where len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w))))::double >= 0.5)"""


@query("j9_twins", "codes", "negatives", "segments", "auto_duplicates", oracle=f"with {_CLUSTERS}, {_FLAGGED}, {_TWINS} select theme_id, a, b, round(similarity, 6) as similarity from tw")
def twins(codes, negatives, segments, auto_duplicates):
    clusters = auto_duplicates.select("dataset_id", "item_id", F.col("canonical_id").alias("cluster_id"))
    return twin_pairs(flagged_rows(codes, negatives, segments, "exemplar"), clusters).withColumn("similarity", F.round("similarity", 6))


def twin_groups(flagged: DataFrame, pairs: DataFrame) -> DataFrame:
    """(theme_id, segment_id, kept) of every flagged passage that has a twin: twins of twins are one group, and its oldest flag is kept."""
    from textloom.plans.graph import components

    ids = flagged.select("theme_id", "segment_id", F.col("flag_id").cast("long").alias("id"))
    one = ids.withColumnsRenamed({"segment_id": "a", "id": "u"})
    both = pairs.join(one, ["theme_id", "a"]).join(ids.withColumnsRenamed({"segment_id": "b", "id": "v"}), ["theme_id", "b"])
    roots = components(both.select("u", "v"))
    kept = ids.select(F.col("id").alias("root"), F.col("segment_id").alias("kept"))
    return roots.join(ids.withColumnRenamed("id", "node"), "node").join(kept, "root").select("theme_id", "segment_id", "kept")


@query("d22_twin_collapse", "codes", "negatives", "segments", "auto_duplicates", oracle=f"""with recursive {_CLUSTERS}, {_FLAGGED}, {_TWINS}, ed as (select theme_id, a as x, b as y from tw union all select theme_id, b, a from tw),
    re as (select distinct theme_id, x, x as y from ed union select r.theme_id, r.x, e.y from re r join ed e on e.theme_id = r.theme_id and e.x = r.y)
    select r.theme_id, x as segment_id, arg_min(y, flag_id) as kept from re r join fl on fl.theme_id = r.theme_id and fl.segment_id = y group by 1, 2""")
def twin_collapse(codes, negatives, segments, auto_duplicates):
    flagged = flagged_rows(codes, negatives, segments, "exemplar")
    clusters = auto_duplicates.select("dataset_id", "item_id", F.col("canonical_id").alias("cluster_id"))
    return twin_groups(flagged, twin_pairs(flagged, clusters))


@query("f10_current_decisions", "decisions", oracle="select segment_id, theme_id, arg_max(decision, decision_id) as decision from decisions where undone_at is null group by 1, 2")
def current_decisions(decisions):
    """What holds after undos: the last decision that was not undone."""
    return decisions.filter("undone_at is null").groupBy("segment_id", "theme_id").agg(F.max_by("decision", "decision_id").alias("decision"))


@query("f13_round_ledger", "model_runs", "round_decisions", oracle="""with r as (select model_version, 1 + (select count(*) from round_decisions d where d.created_at < m.trained_at) as round from (select model_version, max(trained_at) as trained_at from model_runs group by 1) m)
    select round::bigint as round, string_agg(model_version, ',' order by model_version) as runs, bool_and(round <= (select count(*) from round_decisions)) as closed from r group by 1""")
def round_ledger(model_runs, round_decisions):
    """Rounds with their runs; the last one is open."""
    runs = model_runs.groupBy("model_version").agg(F.max("trained_at").alias("at"))
    all_at = round_decisions.agg(F.sort_array(F.collect_list("created_at")).alias("ends"))  # a ledger of rounds, one row
    d = runs.crossJoin(F.broadcast(all_at)).withColumn("round", 1 + F.size(F.filter("ends", lambda e: e < F.col("at"))))
    return d.groupBy(F.col("round").cast("long").alias("round")).agg(F.array_join(F.sort_array(F.collect_list("model_version")), ",").alias("runs"), F.bool_and(F.col("round") <= F.size("ends")).alias("closed"))


@query("d19_dataset_status", "items", "dataset_status", oracle="select distinct dataset_id from items where dataset_id not in (select dataset_id from dataset_status)")
def active_datasets(items, dataset_status):
    return items.select("dataset_id").distinct().join(F.broadcast(dataset_status.select("dataset_id")), "dataset_id", "left_anti")


@query("d15_bulk_marks", "codes", "segments", "item_reviews", oracle="""select dataset_id, item_id, max(c.created_at) as marked_at from codes c join segments s using (segment_id) where deleted_at is null and (dataset_id, item_id) not in (select dataset_id, item_id from item_reviews where unmarked_at is null) group by 1, 2""")
def bulk_marks(codes, segments, item_reviews):
    """Marks of unmarked coded items, dated by their last code."""
    j = codes.filter("deleted_at is null").join(segments.select("segment_id", "dataset_id", "item_id"), "segment_id")
    j = j.join(item_reviews.filter("unmarked_at is null").select("dataset_id", "item_id"), ["dataset_id", "item_id"], "left_anti")
    return j.groupBy("dataset_id", "item_id").agg(F.max("created_at").alias("marked_at"))


@query("d24_flagged_examples", "codes", "segments", oracle="select theme_id, segment_id, min(code_id) as code_id, any_value(group_name) as group_name from codes join segments using (segment_id) where deleted_at is null and is_exemplar group by 1, 2")
def flagged_examples(codes, segments):
    """One row per flagged segment, the oldest code's."""
    f = codes.filter("deleted_at is null and is_exemplar").groupBy("theme_id", "segment_id").agg(F.min("code_id").alias("code_id"))
    return f.join(segments.select("segment_id", "group_name"), "segment_id").select("theme_id", "segment_id", "code_id", "group_name")


@query("d27_cluster_listing", "auto_duplicates", oracle="select canonical_id, string_agg(item_id, ',' order by doc_id) as members, count(*)::bigint as n from auto_duplicates group by 1")
def cluster_listing(auto):
    d = auto.groupBy("canonical_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "item_id"))).alias("m"), F.count("*").alias("n"))
    return d.select("canonical_id", F.array_join(F.transform("m", lambda x: x["item_id"]), ",").alias("members"), "n")


@query("u2_set_algebra", "codes", "negatives", oracle="select segment_id from (select segment_id from negatives union select segment_id from codes where is_exemplar) except select segment_id from codes where deleted_at is null and theme_id = 's__quality'")
def set_algebra(codes, negatives):
    both = negatives.select("segment_id").union(codes.filter("is_exemplar").select("segment_id")).distinct()
    return both.join(codes.filter("deleted_at is null and theme_id = 's__quality'").select("segment_id"), "segment_id", "left_anti")


@query("s5_contract_check", "items", oracle="select count(*)::bigint as n, count(*) filter (item_id is null)::bigint as without_id, (count(*) - count(distinct item_id))::bigint as repeated from items")
def contract_check(items):
    return items.agg(F.count("*").alias("n"), F.count_if(F.col("item_id").isNull()).alias("without_id"), (F.count("*") - F.countDistinct("item_id")).alias("repeated"))


@query("s15_canonical_records", "items", oracle="select coalesce(item_id, substr(sha1(coalesce(group_name, '')), 1, 10)) as item_id, coalesce(item_title, 'Untitled') as item_title, coalesce(like_count, '0') as like_count, length(transcript_text)::bigint as chars from items")
def canonical_records(items):
    return items.select(F.coalesce("item_id", T.item_key(F.col("group_name"))).alias("item_id"), F.coalesce("item_title", F.lit("Untitled")).alias("item_title"), F.coalesce("like_count", F.lit("0")).alias("like_count"), F.length("transcript_text").cast("long").alias("chars"))


@query("k7_name_resync", "segments", "item_renames", oracle="select segment_id, coalesce(r.group_name, s.group_name) as group_name, coalesce(r.person_name, s.person_name) as person_name from segments s left join item_renames r using (dataset_id, item_id)")
def name_resync(segments, renames):
    """Segments with the names that their items have now."""
    fresh = renames.select("dataset_id", "item_id", F.col("group_name").alias("g"), F.col("person_name").alias("p"))
    return segments.join(fresh, ["dataset_id", "item_id"], "left").select("segment_id", F.coalesce("g", "group_name").alias("group_name"), F.coalesce("p", "person_name").alias("person_name"))


def table_dump(tables: dict[str, DataFrame], themes: DataFrame, scheme: str | None = None) -> dict[str, DataFrame]:
    """All rows of the codebook's tables, deleted ones too; with a scheme, those of its themes (by theme or scheme)."""
    if scheme is None:
        return dict(tables)
    own = F.broadcast(themes.filter(F.col("scheme_id") == scheme).select("theme_id"))  # a codebook
    return {n: d.filter(F.col("scheme_id") == scheme) if "scheme_id" in d.columns else d.join(own, "theme_id", "left_semi") if "theme_id" in d.columns else d for n, d in tables.items()}


_DUMPED = ("schemes", "themes", "codes", "negatives", "item_reviews", "none_confirmations", "predictions", "model_runs")


@query("k8_table_dump", *_DUMPED, oracle=" union all ".join(f"select '{n}' as name, count(*)::bigint as n from {n}" + (" where scheme_id = 's'" if n in ("schemes", "themes", "item_reviews", "none_confirmations") else " where theme_id in (select theme_id from themes where scheme_id = 's')") for n in _DUMPED))
def q_dump(*t):
    """Rows of each of the eight tables of a scheme's dump."""
    out = None
    for name, d in table_dump(dict(zip(_DUMPED, t)), t[1], "s").items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("x5_slug", "items", oracle=r"select item_id, coalesce(nullif(regexp_replace(regexp_replace(strip_accents(item_title || ' / É ' || group_name), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'query')[1:40] as slug from items")
def slugs(items):
    return items.select("item_id", T.slug(F.concat("item_title", F.lit(" / É "), "group_name")).alias("slug"))


@query("x16_metadata", "items", oracle=r"""select item_id, nullif(trim('  ' || coalesce(like_count, '') || ' '), '') as likes, case when doc_id % 7 = 0 then null else publish_date || 'T10:00' end as published,
    case when doc_id % 5 = 0 then null when doc_id % 2 = 0 then (doc_id // 2)::varchar else (doc_id // 2)::varchar || '.5' end as duration from items""")
def cleaned_metadata(items):
    """Submitted values cleaned: counts trimmed, dates checked, durations as numbers."""
    half = F.concat(F.lit(" "), (F.col("doc_id") / 2).cast("string"), F.lit("\t"))
    day = F.concat(F.lit(" "), "publish_date", F.lit("T10:00 "))
    return items.select(
        "item_id",
        T.clean_metadata(F.concat(F.lit("  "), F.coalesce("like_count", F.lit("")), F.lit(" "))).alias("likes"),
        T.clean_date(F.when(F.col("doc_id") % 7 != 0, day).otherwise(" \n")).alias("published"),
        T.clean_duration(F.when(F.col("doc_id") % 5 != 0, half)).alias("duration"),
    )


@query("x22_shared_examples", "codes", oracle="select segment_id, count(distinct theme_id)::bigint as n from codes where deleted_at is null group by 1 having count(distinct theme_id) > 1")
def shared_examples(codes):
    return codes.filter("deleted_at is null").groupBy("segment_id").agg(F.countDistinct("theme_id").alias("n")).filter("n > 1")


@query("x23_passage_lookup", "items", oracle=r"select item_id, regexp_extract(item_title, 'Talk (\d+)', 1) as number from items where contains(regexp_replace(transcript_text, '\s+', ' ', 'g'), 'the th')")
def passage_lookup(items, passage: str = "the  th"):
    flat = F.regexp_replace("transcript_text", r"\s+", " ")
    return items.filter(flat.contains(" ".join(passage.split()))).select("item_id", F.regexp_extract("item_title", r"Talk (\d+)", 1).alias("number"))


@query("f11_engines", "model_runs", oracle="select model_version, theme_id, case when starts_with(model_version, 'tfidf_') then 'tfidf' when starts_with(model_version, 'emb_') then 'embedding' end as engine from model_runs")
def engines(model_runs):
    return model_runs.select("model_version", "theme_id", engine_of().alias("engine"))


@query("a30_segment_info", "turns", oracle=rf"""with recursive {segments_sql("select item_id, turn_index as k, speaker_name as speaker, content from turns")}, m as (select item_id || ':' || printf('%04d', seg_index) as segment_id, item_id, text, unnest(string_split(turns, ';'))::bigint as turn_index from seg)
    select segment_id, bool_and(coalesce(speaker_role = 'subject', false)) as all_answers, any_value(m.item_id) as item_id, any_value(text) as text, string_agg(item_id || '_' || printf('%04d', turn_index + 1), ';' order by turn_index) as comment_ids, {_words("any_value(text)")}::bigint as words
    from m join turns using (item_id, turn_index) group by 1""")
def segment_info(turns):
    """Of each segment: whether all its turns are answers, its item and text, its turns' comment ids in order and its words."""
    m = segmented(turns).select("segment_id", "item_id", "text", F.explode(F.col("turns").cast("array<bigint>")).alias("turn_index"))
    d = m.join(turns.select("item_id", "turn_index", F.coalesce(F.col("speaker_role") == "subject", F.lit(False)).alias("answer")), ["item_id", "turn_index"])
    comment = F.struct("turn_index", F.concat("item_id", F.lit("_"), F.format_string("%04d", F.col("turn_index") + 1)).alias("id"))
    g = d.groupBy("segment_id").agg(F.bool_and("answer").alias("all_answers"), F.first("item_id").alias("item_id"), F.first("text").alias("text"), F.sort_array(F.collect_list(comment)).alias("c"))
    return g.select("segment_id", "all_answers", "item_id", "text", F.array_join(F.transform("c", lambda x: x["id"]), ";").alias("comment_ids"), T.word_count("text").alias("words"))
