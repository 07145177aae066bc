"""Corpus scope, browse filters, corpus analytics and segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.ordered import running_sums
from textloom.registry import query

# ------------------------------------------------------------------ scope


def duplicate_status(items: DataFrame, auto: DataFrame, overrides: DataFrame) -> DataFrame:
    """(item_id, is_duplicate) as it holds: an override beats the scan, without a scan too.

    ``include`` marks an item as a duplicate, ``exclude`` clears it.
    """
    o = overrides.select("dataset_id", "item_id", "kind")
    a = auto.select("dataset_id", "item_id", (~F.col("is_canonical")).alias("auto"))
    d = items.select("dataset_id", "item_id").join(o, ["dataset_id", "item_id"], "left").join(a, ["dataset_id", "item_id"], "left")
    status = F.when(F.col("kind") == "include", True).when(F.col("kind") == "exclude", False).otherwise(F.coalesce("auto", F.lit(False)))
    return d.select("dataset_id", "item_id", status.alias("is_duplicate"))


def scope(segments: DataFrame, dataset_status: DataFrame, auto: DataFrame, overrides: DataFrame, least_words: int = 5) -> DataFrame:
    """Segments that training and analytics use: no interviewer, enough words, no excluded dataset, no duplicate item."""
    s = segments.filter("speaker_role is null or speaker_role <> 'interviewer'").filter(F.col("word_count").isNull() | (F.col("word_count") >= least_words))
    s = s.join(F.broadcast(dataset_status.select("dataset_id")), "dataset_id", "left_anti")  # a flag table of datasets
    status = duplicate_status(auto.select("dataset_id", "item_id").unionByName(overrides.select("dataset_id", "item_id")).distinct(), auto, overrides)
    return s.join(status.filter("is_duplicate"), ["dataset_id", "item_id"], "left_anti")


SCOPE = """scope as (select * from segments s where (speaker_role is null or speaker_role <> 'interviewer') and (word_count is null or word_count >= 5) and dataset_id not in (select dataset_id from dataset_status)
    and not ((dataset_id, item_id) in (select dataset_id, item_id from overrides where kind = 'include') or (dataset_id, item_id) in (select dataset_id, item_id from auto_duplicates where not is_canonical)
             and (dataset_id, item_id) not in (select dataset_id, item_id from overrides where kind = 'exclude')))"""
PARTS = ("segments", "dataset_status", "auto_duplicates", "overrides")


@query("p8_corpus_scope", *PARTS, oracle=f"with {SCOPE} select segment_id from scope")
def q_scope(*t):
    return scope(*t).select("segment_id")


@query("d26_duplicate_status", "items", "auto_duplicates", "overrides", oracle="""select i.dataset_id, i.item_id, case when kind = 'include' then true when kind = 'exclude' then false else coalesce(not is_canonical, false) end as is_duplicate
    from items i left join overrides o using (dataset_id, item_id) left join auto_duplicates a using (dataset_id, item_id)""")
def q_duplicate_status(items, auto, overrides):
    return duplicate_status(items, auto, overrides)


@query("a21_duplicates_of", "auto_duplicates", "overrides", oracle="""select target as canonical_id, count(*)::bigint as n from (select canonical_id as target, item_id from auto_duplicates where not is_canonical and item_id not in (select item_id from overrides where kind = 'exclude')
    union select target_id, item_id from overrides where kind = 'include') group by 1""")
def duplicates_of(auto, overrides):
    a = auto.filter("not is_canonical").join(overrides.filter("kind = 'exclude'").select("item_id"), "item_id", "left_anti").select(F.col("canonical_id"), "item_id")
    m = overrides.filter("kind = 'include'").select(F.col("target_id").alias("canonical_id"), "item_id")
    return a.unionByName(m).distinct().groupBy("canonical_id").agg(F.count("*").alias("n"))


@query("a22_code_counts_per_item", "items", "segments", "codes", oracle="""select i.item_id, case when count(s.segment_id) = 0 then null else count(distinct c.code_id) end::bigint as n from items i left join (select * from segments where speaker_role is not null) s using (dataset_id, item_id)
    left join (select * from codes where deleted_at is null) c on c.segment_id = s.segment_id group by 1""")
def code_counts(items, segments, codes):
    s = segments.filter("speaker_role is not null").select("dataset_id", "item_id", "segment_id")
    d = items.select("dataset_id", "item_id").join(s, ["dataset_id", "item_id"], "left").join(codes.filter("deleted_at is null").select("segment_id", "code_id"), "segment_id", "left")
    return d.groupBy("item_id").agg(F.when(F.count("segment_id") > 0, F.countDistinct("code_id")).alias("n"))


# ------------------------------------------------------------------ analytics


@query("a1_corpus_summary", *PARTS, oracle=rf"""with {SCOPE}, t as (select unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) as t from scope)
    select count(distinct dataset_id || '/' || item_id)::bigint as n_documents, count(*)::bigint as n_segments, sum(coalesce(word_count, 0))::bigint as n_words, round(avg(coalesce(word_count, 0)), 6) as mean_words, round(median(coalesce(word_count, 0)), 6)::double as median_words,
      min(coalesce(word_count, 0))::bigint as min_words, max(coalesce(word_count, 0))::bigint as max_words, (select count(distinct t) from t)::bigint as vocabulary, round((select count(distinct t) / nullif(count(*), 0)::double from t), 6) as diversity from scope""")
def corpus_summary(*t):
    s = scope(*t).withColumn("w", F.coalesce("word_count", F.lit(0)))
    tiles = s.agg(
        F.countDistinct("dataset_id", "item_id").alias("n_documents"),
        F.count("*").alias("n_segments"),
        F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("n_words"),
        F.round(F.avg("w"), 6).alias("mean_words"),
        F.round(F.median("w"), 6).alias("median_words"),
        F.min("w").cast("long").alias("min_words"),
        F.max("w").cast("long").alias("max_words"),
    )
    # Pre-aggregated by term, so that the distinct count needs no second pass over tokens.
    terms = s.select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    v = terms.agg(F.count("*").alias("vocabulary"), F.round(F.try_divide(F.count("*"), F.sum("n")), 6).alias("diversity"))
    return tiles.crossJoin(v)  # one row each


def _fields(items: DataFrame, fields: list[str]) -> DataFrame:
    return items.select("item_id", *(F.col(f).cast("string") for f in fields)).unpivot(["item_id"], fields, "field", "value")


DATE = r"^\d{4}-\d{2}-\d{2}"


@query("a2_field_discovery", "items", oracle="""with u as (unpivot (select item_id, group_name, person_name, publish_date, view_count, like_count from items) on group_name, person_name, publish_date, view_count, like_count into name field value value),
      n as (select count(*) as total from items), t as (select field, count(distinct value)::bigint as n_distinct, (total - count(value))::bigint as n_missing, bool_and(try_cast(value as double) is not null) as num, avg(case when regexp_matches(value, '^\\d{4}-\\d{2}-\\d{2}') then 1.0 else 0 end) as dates from u, n group by field, total)
    select field, n_distinct, n_missing, case when num and n_distinct > 15 then 'quantitative' when not num and dates >= 0.9 then 'temporal' else 'categorical' end as type from t""")
def discover_fields(items, fields=("group_name", "person_name", "publish_date", "view_count", "like_count"), cutoff: int = 15):
    """Per field its type (numbers before dates), distinct and missing values; all-null fields go."""
    u = _fields(items, list(fields))
    number = T.numeric(F.col("value"))
    a = u.groupBy("field").agg(
        F.countDistinct("value").alias("n_distinct"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.bool_and(number.isNotNull() | F.col("value").isNull()).alias("num"),
        F.avg(F.when(F.col("value").isNotNull(), F.col("value").rlike(DATE).cast("int"))).alias("dates"),
    )
    kind = F.when(F.col("num") & (F.col("n_distinct") > cutoff), "quantitative").when(~F.col("num") & (F.col("dates") >= 0.9), "temporal").otherwise("categorical")
    return a.filter("n_distinct > 0").select("field", "n_distinct", "n_missing", kind.alias("type"))


@query("a4_categorical_breakdown", "segments", "items", oracle="""with d as (select coalesce(like_count, 'Unknown') as v, i.item_id, count(*) as segs, sum(coalesce(word_count, 0)) as words from segments s join items i using (dataset_id, item_id) group by 1, 2),
     g as (select v, count(*) as docs, sum(segs) as segs, sum(words) as words from d group by 1), r as (select *, row_number() over (order by docs desc, v) as k from g)
    select case when k <= 20 then v else 'Other' end as value, sum(docs)::bigint as documents, sum(segs)::bigint as segments, sum(words)::bigint as words from r group by 1""")
def categorical_breakdown(segments, items, field: str = "like_count", cap: int = 20):
    """Documents, segments and words by value; the tail beyond ``cap`` values is one row, Other."""
    d = segments.join(items.select("dataset_id", "item_id", F.coalesce(F.col(field), F.lit("Unknown")).alias("v")), ["dataset_id", "item_id"])
    d = d.groupBy("v", "item_id").agg(F.count("*").alias("segs"), F.sum(F.coalesce("word_count", F.lit(0))).alias("words"))
    g = d.groupBy("v").agg(F.count("*").alias("docs"), F.sum("segs").alias("segs"), F.sum("words").alias("words"))
    top = g.orderBy(F.desc("docs"), "v").limit(cap).select("v", F.lit(True).alias("top"))  # the cap is the feature
    r = g.join(F.broadcast(top), "v", "left").withColumn("value", F.when(F.col("top"), F.col("v")).otherwise("Other"))
    return r.groupBy("value").agg(F.sum("docs").alias("documents"), F.sum("segs").alias("segments"), F.sum("words").cast("long").alias("words"))


@query("a5_temporal_breakdown", "items", oracle="""with d as (select try_cast(publish_date as date) as d from items), s as (select date_diff('day', min(d), max(d)) as span from d)
    select case when span <= 60 then strftime(d, '%Y-%m-%d') when span <= 730 then strftime(d, '%Y-%m') else strftime(d, '%Y') end as bin, count(*)::bigint as n from d, s where d is not null group by 1""")
def temporal_breakdown(items):
    d = items.select(F.when(F.col("publish_date").rlike(DATE), F.substring("publish_date", 1, 10).try_cast("date")).alias("d"))
    span = d.agg(F.datediff(F.max("d"), F.min("d")).alias("span"))
    label = F.when(F.col("span") <= 60, F.date_format("d", "yyyy-MM-dd")).when(F.col("span") <= 730, F.date_format("d", "yyyy-MM")).otherwise(F.date_format("d", "yyyy"))
    return d.filter("d is not null").crossJoin(F.broadcast(span)).select(label.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("a6_quantitative_points", "segments", "items", oracle="select i.item_id, try_cast(like_count as double) as value, sum(coalesce(word_count, 0))::bigint as words from segments s join items i using (dataset_id, item_id) where try_cast(like_count as double) is not null group by 1, 2")
def quantitative_points(segments, items):
    v = items.select("dataset_id", "item_id", T.numeric(F.col("like_count")).alias("value")).filter("value is not null")
    return segments.join(v, ["dataset_id", "item_id"]).groupBy("item_id", "value").agg(F.sum(F.coalesce("word_count", F.lit(0))).cast("long").alias("words"))


_OVER = r"""t as (select person_name as g, unnest(list_filter(regexp_extract_all(lower(transcript_text), '[\p{L}\p{N}_]{2,}'), lambda x: x not in (%s))) as term from items), c as (select g, term, count(*) as n, count(*) over (partition by term) as groups from t group by 1, 2)""" % ", ".join(repr(w) for w in T.STOPWORDS)


@query("a8_vocabulary_overlap", "items", oracle=f"with {_OVER} select g as person_name, count(*)::bigint as vocabulary, round(100.0 * count(*) filter (groups > 1) / count(*), 6) as shared, round(100.0 * count(*) filter (groups = 1) / count(*), 6) as unique_share from c group by 1")
def vocabulary_overlap(items, field: str = "person_name"):
    """Per group: share of its vocabulary found in other groups, and found in it alone."""
    c = _group_terms(items, field)
    n = F.count("*")
    return c.groupBy(field).agg(n.alias("vocabulary"), F.round(100 * F.count_if(F.col("groups") > 1) / n, 6).alias("shared"), F.round(100 * F.count_if(F.col("groups") == 1) / n, 6).alias("unique_share"))


def _group_terms(items, field):
    t = items.select(field, F.explode(T.content_tokens("transcript_text")).alias("term")).groupBy(field, "term").agg(F.count("*").alias("n"))
    return t.withColumn("groups", F.count("*").over(Window.partitionBy("term")))


@query("a8_unique_terms", "items", oracle=f"with {_OVER} select g as person_name, term, n::bigint as n, row_number() over (partition by g order by n desc, term) as k from c where groups = 1 qualify k <= 15")
def unique_terms(items, field: str = "person_name", top: int = 15):
    """The most frequent terms of each group that no other group has; the list's length is the feature."""
    w = Window.partitionBy(field).orderBy(F.desc("n"), "term")
    return _group_terms(items, field).filter("groups = 1").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top).select(field, "term", "n", F.col("k").cast("long").alias("k"))


# ------------------------------------------------------------------ browse


def facets(items: DataFrame, groups=(), people=(), date_from=None, date_to=None, title=None, least_views: float = 0) -> DataFrame:
    """Conjunction of browse filters; an empty set or bound doesn't filter."""
    d = items
    for column, chosen in (("group_name", groups), ("person_name", people)):
        if chosen:
            d = d.filter(F.col(column).isin(*chosen))
    day = F.when(F.col("publish_date").rlike(DATE), F.substring("publish_date", 1, 10).try_cast("date"))
    if date_from:
        d = d.filter(day >= F.lit(date_from).cast("date"))
    if date_to:  # the whole last day counts
        d = d.filter(day < F.date_add(F.lit(date_to).cast("date"), 1))
    if title:
        d = d.filter(F.instr(F.lower("item_title"), title.lower()) > 0)
    if least_views:
        d = d.filter(F.coalesce(T.numeric(F.col("view_count")), F.lit(0)) >= least_views)
    return d


@query("p1_faceted_filter", "items", oracle="select item_id from items where person_name in ('en', 'fr') and publish_date::date >= date '2024-01-03' and publish_date::date < date '2024-01-21' and contains(lower(item_title), 'talk 1') and coalesce(try_cast(view_count as double), 0) >= 500")
def q_facets(items):
    return facets(items, people=("en", "fr"), date_from="2024-01-03", date_to="2024-01-20", title="TALK 1", least_views=500).select("item_id")


@query("p2_facet_values", "items", oracle="select distinct like_count as v from items where like_count is not null and like_count <> ''")
def facet_values(items):
    return items.filter("like_count <> ''").select(F.col("like_count").alias("v")).distinct().orderBy("v")


@query("p3_date_bounds", "items", oracle="select min(publish_date) as first_day, max(publish_date) as last_day from items")
def date_bounds(items):
    return items.agg(F.date_format(F.min(F.to_date("publish_date")), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(F.to_date("publish_date")), "yyyy-MM-dd").alias("last_day"))


def search(items: DataFrame, term: str, whole_word: bool = False) -> DataFrame:
    """Items whose text holds the literal term, without regard to case; an empty term finds none."""
    t = term.strip().lower()
    if not t:
        return items.limit(0)
    if not whole_word:
        return items.filter(F.instr(F.lower("transcript_text"), t) > 0)
    quoted = "".join(c if c.isalnum() or c == " " else "\\" + c for c in t)
    return items.filter(F.lower("transcript_text").rlike(rf"(?U)(?<!\w){quoted}(?!\w)"))


@query("p4_search", "items", oracle="select item_id from items where contains(lower(transcript_text), 'the th')")
def q_search(items):
    return search(items, " The th").select("item_id")


@query("p4_search_whole_word", "items", oracle=r"select item_id from items where regexp_matches(lower(transcript_text), '(^|[^\p{L}\p{N}_])queé?([^\p{L}\p{N}_]|$)') and regexp_matches(lower(transcript_text), '(^|[^\p{L}\p{N}_])que([^\p{L}\p{N}_]|$)')")
def q_search_word(items):
    return search(items, "que", whole_word=True).select("item_id")


@query("p5_match_counts", "items", oracle="select item_id, len(regexp_extract_all(lower(transcript_text), 'tion'))::bigint as n from items")
def match_counts(items):
    return items.select("item_id", F.regexp_count(F.lower("transcript_text"), F.lit("tion")).cast("long").alias("n"))


@query("p7_index", "items", oracle="select item_id, row_number() over (order by publish_date nulls last, doc_id) - 1 as position from items")
def light_index(items):
    """Dense positions by date, undated last: running sums over ranges, so a day of any size spreads."""
    d = items.select("item_id", "doc_id", "publish_date", F.lit(1).cast("long").alias("n"))
    return running_sums(d, [], [F.asc_nulls_last("publish_date"), F.asc("doc_id")], ["n"]).select("item_id", (F.col("n_upto") - 1).alias("position"))


@query("p10_drill_down", "segments", "items", oracle="select s.segment_id from segments s join items i using (dataset_id, item_id) where try_cast(like_count as double) = 42.0")
def drill_down(segments, items):
    return segments.join(items.filter(T.numeric(F.col("like_count")) == 42.0).select("dataset_id", "item_id"), ["dataset_id", "item_id"], "left_semi").select("segment_id")


@query("p11_min_words", "segments", oracle="select segment_id from segments where coalesce(word_count, 0) >= 50")
def min_words(segments):
    return segments.filter("coalesce(word_count, 0) >= 50").select("segment_id")


@query("p12_lookup", "segments", "labels", oracle="select segment_id, word_count from segments where doc_id in (select doc_id from labels)")
def lookup(segments, labels):
    return segments.join(labels.select("doc_id"), "doc_id", "left_semi").select("segment_id", "word_count")


@query("p15_dataset_listing", "items", "segments", "dataset_status", oracle="select dataset_id, coalesce(status, 'active') as status, count(*)::bigint as segment_count from segments left join dataset_status using (dataset_id) where coalesce(status, '') <> 'unloaded' group by 1, 2")
def dataset_listing(items, segments, dataset_status):
    n = segments.groupBy("dataset_id").agg(F.count("*").alias("segment_count"))
    d = items.select("dataset_id").distinct().join(n, "dataset_id", "left").join(dataset_status, "dataset_id", "left")
    return d.select("dataset_id", F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("segment_count", F.lit(0)).alias("segment_count")).filter("status <> 'unloaded'")


@query("p16_log_filter", "activity", oracle="select log_id, action_type, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from activity where action_type = (select min(action_type) from activity) and strftime(ts, '%Y-%m-%d') >= '2024-01-10'")
def log_filter(activity):
    first = activity.agg(F.min("action_type").alias("action_type"))
    d = activity.join(F.broadcast(first), "action_type", "left_semi").filter(F.date_format("ts", "yyyy-MM-dd") >= "2024-01-10")
    return d.select("log_id", "action_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at")).orderBy(F.desc("at"), "log_id")


@query("p17_item_segments", "segments", "codes", "negatives", oracle="""select segment_id, coalesce((select string_agg(theme_id, ',' order by theme_id) from (select distinct theme_id from codes c where c.segment_id = s.segment_id and deleted_at is null)), '') as codes,
    coalesce((select string_agg(theme_id, ',' order by theme_id) from (select distinct theme_id from negatives c where c.segment_id = s.segment_id and deleted_at is null)), '') as rejections from segments s""")
def item_segments(segments, codes, negatives):
    lists = lambda d, name: d.filter("deleted_at is null").groupBy("segment_id").agg(F.array_join(F.sort_array(F.collect_set("theme_id")), ",").alias(name))
    d = segments.select("segment_id").join(lists(codes, "codes"), "segment_id", "left").join(lists(negatives, "rejections"), "segment_id", "left")
    return d.select("segment_id", F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("rejections", F.lit("")).alias("rejections"))


@query("t1_page", "segments", oracle="select segment_id, word_count, (select count(*) from segments)::bigint as total from segments order by word_count desc nulls last, segment_id limit 25 offset 50")
def page(segments, offset: int = 50, limit: int = 25):
    """A page and the number of all rows; at most 200 rows, at least one."""
    d = segments.orderBy(F.desc_nulls_last("word_count"), "segment_id").offset(max(0, offset)).limit(max(1, min(200, limit))).select("segment_id", "word_count")
    return d.crossJoin(F.broadcast(segments.agg(F.count("*").alias("total"))))


# ------------------------------------------------------------------ segmentation

SHORT, LONG, TARGET = 20, 220, 120


def turns_of_lines(documents: DataFrame) -> DataFrame:
    """Turns made of a document's lines, three lines a speaker; every eleventh line blank."""
    lines = documents.select(F.col("doc_id").cast("string").alias("item_id"), F.posexplode(F.split("text", "\n")).alias("turn_index", "content"))
    return lines.withColumn("speaker_name", F.concat(F.lit("S"), (F.floor(F.col("turn_index") / 3) % 2).cast("string"))).withColumn("content", F.when(F.col("turn_index") % 11 == 10, "").otherwise(F.col("content")))


#: What a block keeps of its first turn.
META = {"speaker_id": "string", "speaker_role": "string", "depth": "int", "timestamp": "string"}
#: Numbers that a fold carries along.
LIST = 256


def numbered(items: str, begins: str) -> str:
    """SQL for the group of each element of array ``items`` (structs with a size ``n``).

    An element ``t`` begins a new group if ``begins`` holds, where ``s.n`` is
    the size of the open one.  A fold copies what it carries at each step, so
    this one carries numbers only, in lists of ``LIST``.
    """
    one = f"""aggregate(l, named_struct('b', a.b, 'n', a.n, 'out', cast(array() as array<int>)), (s, t) -> if({begins},
        named_struct('b', s.b + 1, 'n', t.n, 'out', concat(s.out, array(s.b + 1))), named_struct('b', s.b, 'n', s.n + t.n, 'out', concat(s.out, array(s.b)))))"""
    lists = f"transform(sequence(0, greatest(size({items}) - 1, 0) div {LIST}), k -> slice({items}, int(k) * {LIST} + 1, {LIST}))"
    step = f"transform(array({one}), x -> named_struct('b', x.b, 'n', x.n, 'lists', concat(a.lists, array(x.out))))[0]"
    return f"aggregate({lists}, named_struct('b', 0, 'n', 0, 'lists', cast(array() as array<array<int>>)), (a, l) -> {step}, a -> flatten(a.lists))"


def merged_turns(turns: DataFrame) -> DataFrame:
    """Blocks of turns: blank turns go, and a turn joins the block before it if the
    speaker is the same (null equals null) and that block has fewer than ``SHORT`` words.

    One fold over an item's word counts numbers the turns by block; blocks are
    then made of slices of the turns, so texts are joined once.
    """
    have = {c: F.col(c).cast(t) if c in turns.columns else F.lit(None).cast(t) for c, t in META.items()}
    row = F.struct(F.col("turn_index").cast("int").alias("turn_index"), F.col("speaker_name").alias("speaker"), *(v.alias(c) for c, v in have.items()), "text", T.word_count("text").cast("int").alias("n"))
    d = turns.withColumn("text", T.strip(F.coalesce("content", F.lit("")))).filter("text <> ''").groupBy("item_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    changes = F.transform("turns", lambda t, i: F.struct(((i == 0) | ~t["speaker"].eqNullSafe(F.get("turns", i - 1)["speaker"])).alias("new"), t["n"].alias("n")))
    d = d.withColumn("sizes", changes).withColumn("block", F.expr(numbered("sizes", f"t.new or s.n >= {SHORT}")))
    d = d.select("item_id", F.posexplode(F.arrays_zip("turns", "block")).alias("at", "t")).select("item_id", "at", "t.turns.*", "t.block")
    # Turns of an item are where they were numbered, so this moves no row.
    own = F.sort_array(F.collect_list(F.struct("at", "text", "turn_index")))
    d = d.groupBy("item_id", "block").agg(F.min(F.struct("at", "speaker", *META)).alias("first"), F.sum("n").cast("int").alias("n"), own.alias("own"))
    return d.select("item_id", (F.col("block") - 1).alias("block"), "first.speaker", *(f"first.{c}" for c in META), F.array_join("own.text", " ").alias("text"), "n", F.col("own.turn_index").alias("turns"))


def pieces(blocks: DataFrame) -> DataFrame:
    """Rows of ``blocks`` (item_id, block, text, its words ``n`` and more) by ``part``: a text over
    ``LONG`` words is cut into whole sentences of up to ``TARGET`` words together.

    Sentences are numbered by piece in one fold over their word counts.
    """
    keep = [c for c in blocks.columns if c not in ("item_id", "block", "text", "n")]
    d = blocks.withColumn("s", F.when(F.col("n") > LONG, T.sentences(F.col("text"))).otherwise(F.array("text")))
    d = d.withColumn("sizes", F.transform("s", lambda x: F.struct(T.word_count(x).cast("int").alias("n"))))
    d = d.withColumn("part", F.when(F.size("s") > 1, F.expr(numbered("sizes", f"s.n > 0 and s.n + t.n > {TARGET}"))).otherwise(F.array(F.lit(0))))
    d = d.select("item_id", "block", *keep, F.posexplode(F.arrays_zip("s", "part")).alias("at", "x"))
    # The first sentence's row of a piece has what the block has.
    d = d.groupBy("item_id", "block", F.col("x.part").alias("part")).agg(F.min(F.struct("at", *keep)).alias("first"), F.sort_array(F.collect_list(F.struct("at", "x.s"))).alias("own"))
    return d.select("item_id", "block", "part", *(f"first.{c}" for c in keep), F.array_join("own.s", " ").alias("text"))


def segmented(turns: DataFrame) -> DataFrame:
    """Segments with stable ids: blocks of turns, the long ones cut at sentences."""
    p = pieces(merged_turns(turns))
    index = F.row_number().over(Window.partitionBy("item_id").orderBy("block", "part")) - 1
    return p.withColumn("seg_index", index).select(T.segment_id(F.col("item_id"), F.col("seg_index")).alias("segment_id"), "item_id", "seg_index", "speaker", *META, "text", T.word_count("text").alias("word_count"), "turns")


def segment_all(items: DataFrame) -> DataFrame:
    """Segments of every item of every dataset, from their nested turns, with the item's names (a batch for an upsert)."""
    turns = items.select("item_id", F.posexplode("turns").alias("turn_index", "t")).select("item_id", "turn_index", "t.*")
    names = items.select("item_id", "dataset_id", "group_name", "person_name")
    return segmented(turns).withColumnRenamed("speaker", "speaker_name").join(names, "item_id")


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[{T.WS}]+|[{T.WS}]+\z', '', 'g')"


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{T.WS}]+'))"


def segments_sql(turns: str) -> str:
    """DuckDB CTEs from turns (item_id, k, speaker, content) to blocks ``b`` and segments ``seg``, turn by turn and sentence by sentence."""
    return rf"""t as (select item_id, k, speaker, {_strip("content")} as content, {_words("content")} as n, row_number() over (partition by item_id order by k) as i from ({turns}) where {_strip("content")} <> ''),
    f as (select item_id, i, 0 as block, n as total, speaker from t where i = 1 union all
      select t.item_id, t.i, case when t.speaker is not distinct from f.speaker and f.total < {SHORT} then f.block else f.block + 1 end, case when t.speaker is not distinct from f.speaker and f.total < {SHORT} then f.total + t.n else t.n end, t.speaker from f join t on t.item_id = f.item_id and t.i = f.i + 1),
    b as (select item_id, block, max(total) as n, any_value(f.speaker) as speaker, string_agg(content, ' ' order by t.i) as text, string_agg(k::varchar, ';' order by t.i) as turns from f join t using (item_id, i) group by 1, 2),
    l as (select item_id, block, list_filter(string_split(regexp_replace(text, '([.!?])[{T.WS}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from b where n > {LONG}),
    sn as (select item_id, block, j, s[j] as s, {_words("s[j]")} as n from l, unnest(range(1, len(s) + 1)) u(j)),
    g as (select item_id, block, j, 0 as part, n as total from sn where j = 1 union all
      select sn.item_id, sn.block, sn.j, case when g.total + sn.n > {TARGET} then g.part + 1 else g.part end, case when g.total + sn.n > {TARGET} then sn.n else g.total + sn.n end from g join sn on sn.item_id = g.item_id and sn.block = g.block and sn.j = g.j + 1),
    p as (select item_id, block, part, string_agg(s, ' ' order by j) as text from g join sn using (item_id, block, j) group by 1, 2, 3 union all select item_id, block, 0, text from b where n <= {LONG}),
    seg as (select item_id, row_number() over (partition by item_id order by block, part) - 1 as seg_index, speaker, p.text, turns from p join b using (item_id, block))"""


_LINES = """select doc_id::varchar as item_id, k - 1 as k, 'S' || (((k - 1) // 3) % 2)::varchar as speaker, case when (k - 1) % 11 = 10 then '' else content end as content
    from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)"""
_TURNS = "select item_id, turn_index as k, speaker_name as speaker, content from turns"
_SEG = f"select item_id || ':' || printf('%04d', seg_index) as segment_id, item_id, seg_index::bigint as seg_index, speaker, text, {_words('text')}::bigint as word_count, turns from seg"
_SEG_COLUMNS = ("segment_id", "item_id", "seg_index", "speaker", "text", "word_count")


@query("b1_merge", "documents", oracle=f"with recursive {segments_sql(_LINES)} select item_id, block::bigint as block, n::bigint as n, text, turns from b")
def q_merge(documents):
    b = merged_turns(turns_of_lines(documents))
    return b.select("item_id", F.col("block").cast("long").alias("block"), F.col("n").cast("long").alias("n"), "text", F.array_join(F.col("turns").cast("array<string>"), ";").alias("turns"))


def _flat(segments: DataFrame) -> DataFrame:
    return segments.withColumn("seg_index", F.col("seg_index").cast("long")).select(*_SEG_COLUMNS, F.array_join(F.col("turns").cast("array<string>"), ";").alias("turns"))


@query("b3_segments", "documents", oracle=f"with recursive {segments_sql(_LINES)} {_SEG}")
def q_segments(documents):
    return _flat(segmented(turns_of_lines(documents)))


@query("b3_conversation_segments", "turns", oracle=f"with recursive {segments_sql(_TURNS)} {_SEG}")
def q_conversation_segments(turns):
    return _flat(segmented(turns))


@query("b4_turn_indices", "documents", oracle=f"with recursive {segments_sql(_LINES)} select item_id || ':' || printf('%04d', seg_index) as segment_id, unnest(string_split(turns, ';'))::bigint as turn_index from seg")
def q_turn_indices(documents):
    """The turns that each segment was made of, by their places among all turns."""
    return segmented(turns_of_lines(documents)).select("segment_id", F.explode(F.col("turns").cast("array<bigint>")).alias("turn_index"))


@query("b5_batch_segments", "items", oracle=rf"""with recursive src as (select * from items), {segments_sql("select item_id, k - 1 as k, 'S' || ((k - 1) % 2)::varchar as speaker, content from (select item_id, unnest(string_split(transcript_text, '. ')) as content, generate_subscripts(string_split(transcript_text, '. '), 1) as k from src)")}
    select s.item_id || ':' || printf('%04d', seg_index) as segment_id, i.dataset_id, i.group_name, i.person_name, speaker as speaker_name, case when speaker = 'S0' then 'interviewer' else 'subject' end as speaker_role, {_words('s.text')}::bigint as word_count from seg s join src i using (item_id)""")
def q_batch_segments(items):
    """All items of all datasets; their turns are the sentences of the transcript, by two speakers in turn."""
    said = F.transform(
        F.split("transcript_text", r"\. "),
        lambda c, i: F.struct(F.concat(F.lit("S"), (i % 2).cast("string")).alias("speaker_name"), F.lit(None).cast("string").alias("speaker_id"), F.when(i % 2 == 0, "interviewer").otherwise("subject").alias("speaker_role"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("timestamp"), c.alias("content")),
    )
    return segment_all(items.withColumn("turns", said)).select("segment_id", "dataset_id", "group_name", "person_name", "speaker_name", "speaker_role", "word_count")
