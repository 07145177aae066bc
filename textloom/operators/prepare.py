"""Turn tables, gold labels, samples, exports, updates and other preparation steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.labels import _NEG, _POS, _REJ, _UP, _J, closure, positives, reviewed_negatives
from textloom.plans.graph import written
from textloom.plans.ordered import running_sums
from textloom.registry import query

_NAMES = """case when turn_index % 9 = 2 then 'Speaker ' || turn_index when turn_index % 9 = 4 then 'The Narrator' when turn_index % 9 = 5 then ' unknown person' when turn_index % 9 = 7 then 'Anna Unknown' else speaker_name end"""
_ROLE = """case when n = 'assistant' then 'answer' when regexp_matches(lower(trim(n)), 'narrator|^unknown|^speaker\\s*[0-9]+$') then 'other' else 'question' end"""
_NAMED = f"nt as (select item_id, turn_index, content, {_ROLE.replace('n =', 'nm =').replace('(n)', '(nm)')} as r from (select *, {_NAMES} as nm from turns))"


def speaker_role(name="speaker_name", executives=("assistant",)):
    """answer for the executives, other for narrators, unknown speakers and numbered ones, question for everyone else, also the unnamed."""
    n = F.coalesce(F.col(name), F.lit(""))
    other = F.lower(T.strip(n)).rlike(r"narrator|\Aunknown|\Aspeaker\s*\d+\z")
    return F.when(n.isin(*executives), "answer").when(other, "other").otherwise("question")


def named(turns: DataFrame) -> DataFrame:
    """Turns of which some have other speakers: numbered, narrators, unknown."""
    k, n = F.col("turn_index") % 9, F.col("turn_index").cast("string")
    name = F.when(k == 2, F.concat(F.lit("Speaker "), n)).when(k == 4, "The Narrator").when(k == 5, " unknown person").when(k == 7, "Anna Unknown").otherwise(F.col("speaker_name"))
    return turns.withColumn("speaker_name", name)


@query("p18_speaker_roles", "turns", oracle=f"with {_NAMED} select item_id, turn_index, r as role from nt")
def speaker_roles(turns):
    return named(turns).select("item_id", "turn_index", speaker_role().alias("role"))


_SCOPE = rf"sc as (select item_id, turn_index, n, case when r = 'other' then 'excluded_other' when r = 'answer' and n < 5 then 'rule_non_substantive' when r = 'answer' then 'llm' else 'context_only' end as scope from (select *, len(regexp_extract_all(content, '[^{T.WS}]+')) as n from nt))"


def coding_scope(turns: DataFrame) -> DataFrame:
    r, n = speaker_role(), T.word_count("content")
    kind = F.when(r == "other", "excluded_other").when((r == "answer") & (n < 5), "rule_non_substantive").when(r == "answer", "llm").otherwise("context_only")
    return turns.select("item_id", "turn_index", kind.alias("scope"), n.alias("words"))


@query("p19_coding_scope", "turns", oracle=f"with {_NAMED}, {_SCOPE} select item_id, turn_index, scope from sc")
def q_coding_scope(turns):
    return coding_scope(named(turns)).drop("words")


@query("a31_scope_report", "turns", oracle=f"with {_NAMED}, {_SCOPE} select scope, count(*)::bigint as turns, sum(n)::bigint as words from sc group by 1")
def scope_report(turns):
    return coding_scope(named(turns)).groupBy("scope").agg(F.count("*").alias("turns"), F.sum("words").alias("words"))


@query("j12_question_of_answer", "turns", oracle=f"""with {_NAMED}, q as (select *, last_value(case when r = 'question' then turn_index end ignore nulls) over (partition by item_id order by turn_index rows between unbounded preceding and 1 preceding) as question, lag(turn_index) over (partition by item_id order by turn_index) as before from nt)
    select item_id, turn_index, case when r = 'answer' then question end as question, coalesce(case when r = 'answer' then question end, before)::varchar as parent_turn, coalesce(coalesce(case when r = 'answer' then question end, before)::varchar, item_id) as parent from q""")
def q_parents(turns):
    return parents(named(turns))


def parents(turns: DataFrame) -> DataFrame:
    """Every turn's parent: an answer's is the last question before it, others' (and answers' without one) the turn before, else the item."""
    w = Window.partitionBy("item_id").orderBy("turn_index")
    d = turns.withColumn("role", speaker_role())
    q = F.last(F.when(F.col("role") == "question", F.col("turn_index")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("question", q).withColumn("before", F.lag("turn_index").over(w)).withColumn("question", F.when(F.col("role") == "answer", F.col("question")))
    above = F.coalesce("question", "before").cast("string")
    return d.select("item_id", "turn_index", "question", above.alias("parent_turn"), F.coalesce(above, "item_id").alias("parent"))


def _tiers(codes, negatives, item_reviews, none_confirmations, segments, themes) -> DataFrame:
    """(theme_id, segment_id, label, unit) with units of four segments."""
    pos = positives(codes, closure(themes)).join(segments.select("segment_id"), "segment_id", "left_semi").withColumn("label", F.lit("pos"))
    neg = reviewed_negatives(codes, negatives, item_reviews, none_confirmations, segments, themes).withColumn("label", F.lit("neg"))
    return pos.unionByName(neg)


_LAB = f"with recursive {_UP}, {_POS}, {_REJ}, {_J}, {_NEG}, lab as (select theme_id, segment_id, 'pos' as label from pos where segment_id in (select segment_id from segments) union all select theme_id, segment_id, 'neg' from neg)"
_SIX = ("codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes")


@query("j15_label_grid", *_SIX, oracle=f"{_LAB} select t.theme_id, s.segment_id, coalesce(label, 'neutral') as label from segments s cross join themes t left join lab l on l.theme_id = t.theme_id and l.segment_id = s.segment_id")
def label_grid(*t):
    """Every segment and theme with its label; neutral where none."""
    grid = t[4].select("segment_id").crossJoin(F.broadcast(t[5].select("theme_id")))  # a codebook of themes
    return grid.join(_tiers(*t), ["theme_id", "segment_id"], "left").select("theme_id", "segment_id", F.coalesce("label", F.lit("neutral")).alias("label"))


@query("a28_turn_gold", *_SIX, oracle=f"""{_LAB}, g as (select t.theme_id, doc_id // 4 as unit, coalesce(label, 'neutral') as label from segments s cross join themes t left join lab l on l.theme_id = t.theme_id and l.segment_id = s.segment_id)
    select theme_id, unit, case when bool_or(label = 'pos') then 'pos' when bool_or(label = 'neg') then 'neg' else 'neutral' end as gold from g group by 1, 2""")
def turn_gold(*t):
    """A turn is positive if a piece is, else negative if a piece is, else neutral."""
    d = label_grid(*t).withColumn("unit", F.floor(F.split_part("segment_id", F.lit(":"), F.lit(1)).cast("long") / 4))
    rank = F.when(F.col("label") == "neg", 0).when(F.col("label") == "pos", 2).otherwise(1)
    a = d.groupBy("theme_id", "unit").agg(F.max(rank).alias("hi"), F.min(rank).alias("lo"))
    return a.select("theme_id", "unit", F.when(F.col("hi") == 2, "pos").when(F.col("lo") == 0, "neg").otherwise("neutral").alias("gold"))


@query("w4_percentile_rank", "predictions", oracle="select theme_id, segment_id, round((rank() over (partition by theme_id order by score) + (count(*) over (partition by theme_id, score) - 1) / 2.0) / count(*) over (partition by theme_id), 6) as pct from predictions where model_version = 'tfidf_v2'")
def percentile_rank(predictions):
    """Average rank over the number of rows, from one row a score instead of a sort of all rows."""
    p = predictions.filter("model_version = 'tfidf_v2'")
    g = p.groupBy("theme_id", "score").agg(F.count("*").alias("n"))
    g = running_sums(g, ["theme_id"], [F.asc("score")], ["n"])
    pct = g.select("theme_id", "score", F.round((F.col("n_upto") - F.col("n") + 1 + (F.col("n") - 1) / 2) / F.col("n_all"), 6).alias("pct"))
    return p.join(pct, ["theme_id", "score"]).select("theme_id", "segment_id", "pct")


@query("w13_near_misses", "predictions", "segments", oracle="""with d as (select theme_id, p.segment_id, score, substr(regexp_replace(lower(text), '[^a-z ]', '', 'g'), 1, 120) as k from predictions p join segments using (segment_id) where model_version = 'tfidf_v2'),
    u as (select * from d qualify row_number() over (partition by theme_id, k order by score desc, segment_id) = 1) select theme_id, segment_id, score from u qualify row_number() over (partition by theme_id order by score desc, segment_id) <= 8""")
def near_misses(predictions, segments, top: int = 8):
    d = predictions.filter("model_version = 'tfidf_v2'").join(segments.select("segment_id", T.text_key(F.col("text")).alias("k")), "segment_id")
    best = d.groupBy("theme_id", "k").agg(F.min_by(F.struct("segment_id", "score"), F.struct((-F.col("score")).alias("s"), "segment_id")).alias("b")).select("theme_id", "b.*")
    w = Window.partitionBy("theme_id").orderBy(F.desc("score"), "segment_id")
    return best.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("theme_id", "segment_id", "score")


@query("s23_seeded_sample", "items", oracle="select item_id from items order by md5('demo|' || item_id), item_id limit 50")
def seeded_sample(items, n: int = 50, seed: str = "demo"):
    return items.select("item_id").orderBy(F.md5(F.concat(F.lit(seed + "|"), "item_id")), "item_id").limit(n)


# ------------------------------------------------------------------ transcripts and updates


@query("s16_transcript", "turns", oracle="select item_id, string_agg('[' || coalesce(speaker_name, 'unknown') || '] ' || content, chr(10) order by turn_index) as transcript from turns where content <> '' group by 1")
def transcript(turns):
    line = F.concat(F.lit("["), F.coalesce("speaker_name", F.lit("unknown")), F.lit("] "), "content")
    d = turns.filter("content <> ''").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("turn_index", line.alias("l")))).alias("x"))
    return d.select("item_id", F.array_join(F.transform("x", lambda t: t["l"]), "\n").alias("transcript"))


@query("s13_roles", "turns", oracle="select item_id, turn_index, case speaker_name when 'user' then 'interviewer' when 'assistant' then 'subject' else 'other' end as role from turns")
def assigned_roles(turns, roles={"user": "interviewer", "assistant": "subject"}):  # noqa: B006
    known = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv))
    return turns.select("item_id", "turn_index", F.coalesce(F.element_at(known, F.col("speaker_name")), F.lit("other")).alias("role"))


@query("s19_import_summary", "turns", oracle="select count(*)::bigint as turns, count(distinct item_id)::bigint as items, string_agg(distinct speaker_name, ', ' order by speaker_name) as speakers from turns")
def import_summary(turns):
    return turns.agg(F.count("*").alias("turns"), F.countDistinct("item_id").alias("items"), F.array_join(F.sort_array(F.collect_set("speaker_name")), ", ").alias("speakers"))


def tree_paths(comments: DataFrame) -> DataFrame:
    """(id, depth, path) of comments (id, parent) from the roots down, one join and one written table a level, as deep as they go."""
    name = F.lpad(F.col("id").cast("string"), 12, "0")
    c = written(comments.select("id", "parent"))
    level = written(c.filter("parent is null").select("id", F.lit(0).cast("long").alias("depth"), name.alias("path")))
    out = level
    while not level.isEmpty():
        above = level.select(F.col("id").alias("parent"), F.col("depth").alias("d"), F.col("path").alias("p"))
        level = written(c.join(above, "parent").select("id", (F.col("d") + 1).alias("depth"), F.concat("p", F.lit("/"), name).alias("path")))
        out = out.unionByName(level)
    return out


@query("k3_collisions", "items", "labels", oracle="select item_id from items where item_id in (select doc_id::varchar from labels)")
def collisions(items, labels):
    """Ids of an append that the table has already; an append with any is refused."""
    return items.select("item_id").join(labels.select(F.col("doc_id").cast("string").alias("item_id")), "item_id", "left_semi")


@query("k5_metadata_diff", "items", oracle="""with n as (select item_id, item_title as old_title, case when doc_id % 3 = 0 then 'New' else item_title end as title, like_count as old_likes, case when doc_id % 4 = 0 then null else like_count end as likes from items)
    select item_id, 'item_title' as field, old_title as before, title as after from n where old_title is distinct from title union all select item_id, 'like_count', old_likes, likes from n where old_likes is distinct from likes""")
def metadata_diff(items):
    """Changed fields only, with the value before and after."""
    d = items.withColumns({"item_title_new": F.when(F.col("doc_id") % 3 == 0, "New").otherwise(F.col("item_title")), "like_count_new": F.when(F.col("doc_id") % 4 != 0, F.col("like_count"))})
    changes = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("before"), F.col(f + "_new").alias("after")) for f in ("item_title", "like_count")))
    return d.select("item_id", F.explode(changes).alias("c")).select("item_id", "c.*").filter("not (before <=> after)")


@query("k6_upsert", "segments", "segment_updates", oracle="""with o as (select segment_id, coalesce(speaker_role, 'none') as role, '2024-01-0' || (1 + doc_id % 9)::varchar as created_at from segments)
    select coalesce(u.segment_id, o.segment_id) as segment_id, coalesce(u.speaker_role, o.role) as role, coalesce(o.created_at, u.created_at) as created_at from o full join segment_updates u on u.segment_id = o.segment_id""")
def q_upsert(segments, updates):
    old = segments.select("segment_id", F.coalesce("speaker_role", F.lit("none")).alias("role"), F.concat(F.lit("2024-01-0"), (1 + F.col("doc_id") % 9).cast("string")).alias("created_at"))
    return upsert(old, updates.select("segment_id", F.col("speaker_role").alias("role"), "created_at"), "segment_id", keep=("created_at",))


def upsert(old: DataFrame, new: DataFrame, *key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; columns of ``keep`` stay as they were."""
    if keep:
        before = old.select(*key, *(F.col(c).alias(f"old {c}") for c in keep))
        new = new.join(before, list(key), "left").withColumns({c: F.coalesce(f"old {c}", c) for c in keep}).select(*old.columns)
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


@query("a32_last_wins", "codes", oracle="select segment_id, arg_max(theme_id, code_id) as theme_id, max(code_id) as code_id from codes group by 1")
def last_wins(codes):
    return codes.groupBy("segment_id").agg(F.max_by("theme_id", "code_id").alias("theme_id"), F.max("code_id").alias("code_id"))


# ------------------------------------------------------------------ relational forms


@query("rel_revenue_by_segment", "customer", "orders", "lineitem", oracle="select c_mktsegment, year(o_orderdate)::bigint as y, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey group by 1, 2")
def revenue(customer, orders, lineitem):
    j = lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")).join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(customer.select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_mktsegment", F.year("o_orderdate").cast("long").alias("y")).agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("rel_anti_semi", "customer", "orders", oracle="select c_nationkey::bigint as nation, count(*) filter (c_custkey in (select o_custkey from orders))::bigint as active, count(*) filter (c_custkey not in (select o_custkey from orders))::bigint as idle from customer group by 1")
def anti_semi(customer, orders):
    seen = orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    return customer.join(seen, "c_custkey", "left").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count_if("seen").alias("active"), F.count_if(F.col("seen").isNull()).alias("idle"))
