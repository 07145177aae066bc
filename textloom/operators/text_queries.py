"""Queries of the text functions over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.registry import query


@query("x1_word_count", "documents", oracle=r"select doc_id, len(regexp_extract_all(text, '[^\s\x{00a0}\x{0b}\x{85}\x{2028}\x{2029}]+'))::bigint as word_count from documents")
def word_count(documents):
    return documents.select("doc_id", T.word_count("text").alias("word_count"))


@query("x2_tokens", "documents", oracle=r"""select t as token, count(*)::bigint as n, count(distinct doc_id)::bigint as docs
    from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as t from documents) group by 1""")
def token_frequencies(documents):
    e = documents.select("doc_id", F.explode(T.tokens("text")).alias("token"))
    per = e.groupBy("token", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query("x3_stopwords", "documents", oracle=rf"""select doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x not in ({", ".join(repr(w) for w in T.STOPWORDS)})))::bigint as n_content from documents""")
def content_words(documents):
    return documents.select("doc_id", F.size(T.content_tokens("text")).cast("long").alias("n_content"))


@query("x4_sentences", "documents", oracle=r"""select doc_id, len(s)::bigint as n_sentences, s[1] as first_sentence from
    (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as s from documents)""")
def sentence_split(documents):
    s = T.sentences(F.col("text"))
    return documents.select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.get(s, F.lit(0)).alias("first_sentence"))


@query("x6_shingles", "documents", oracle=r"""select doc_id, case when len(w) < 8 then 0 else (select count(distinct array_to_string(w[i:i+7], ' ')) from range(1, len(w) - 6) r(i)) end::bigint as n_shingles
    from (select doc_id, regexp_extract_all(lower(text), '[^\s\x{00a0}\x{0b}\x{85}]+') as w from documents)""")
def shingle_counts(documents):
    return documents.withColumn("w", T.words(F.lower("text"))).select("doc_id", F.size(F.when(F.size("w") < 8, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 7, F.lit(1))), lambda i: F.array_join(F.slice("w", i, F.lit(8)), " "))))).cast("long").alias("n_shingles"))


@query("x7_word_set", "documents", oracle="select doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z'']+')))::bigint as n from documents")
def word_sets(documents):
    return documents.select("doc_id", F.size(T.word_set(F.col("text"))).cast("long").alias("n"))


@query("x8_text_key", "documents", oracle="select doc_id, substr(regexp_replace(lower(text), '[^a-z ]', '', 'g'), 1, 120) as k from documents")
def text_keys(documents):
    return documents.select("doc_id", T.text_key(F.col("text")).alias("k"))


@query("x9_clip_words", "documents", oracle=r"""select doc_id, case when len(w) > 12 then array_to_string(w[1:12], ' ') || ' [...]' else text end as clipped
    from (select doc_id, text, regexp_extract_all(text, '[^\s\x{00a0}\x{0b}\x{85}]+') as w from documents)""")
def clipped(documents):
    return documents.select("doc_id", T.clip_words(F.col("text"), 12).alias("clipped"))


@query("x10_timestamps", "events", oracle=r"""select event_id, case when h is not null then h * 3600 + m * 60 + s else m * 60 + s end::bigint as secs from
    (select event_id, case when event_id % 3 = 0 then null else event_id % 5 end as h, event_id % 60 as m, event_id % 59 as s from events)""")
def timestamps(events):
    e = F.col("event_id")
    stamp = F.concat(F.lit("at ["), F.when(e % 3 == 0, "").otherwise(F.concat((e % 5).cast("string"), F.lit(":"))), F.lpad((e % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((e % 59).cast("string"), 2, "0"), F.lit("]"))
    return events.select("event_id", T.seconds_of(stamp).cast("long").alias("secs"))


@query("x11_segment_ids", "documents", oracle="select doc_id, source || ':' || case when length(doc_id::varchar) < 4 then lpad(doc_id::varchar, 4, '0') else doc_id::varchar end as segment_id from documents")
def segment_ids(documents):
    return documents.select("doc_id", T.segment_id(F.col("source"), F.col("doc_id")).alias("segment_id"))


@query("x12_permalinks", "pages", oracle="select page_id, case when url like '%example%' then url || '&t=' || (page_id % 500)::varchar || 's' else url end as link from pages")
def permalinks(pages):
    return pages.select("page_id", F.when(F.col("url").contains("example"), F.concat("url", F.lit("&t="), (F.col("page_id") % 500).cast("string"), F.lit("s"))).otherwise(F.col("url")).alias("link"))


@query("x13_numeric", "items", oracle="select item_id, try_cast(view_count as double) as views, try_cast(like_count as double) as likes, try_cast(item_title as double) as title from items")
def numerics(items):
    return items.select("item_id", T.numeric(F.col("view_count")).alias("views"), T.numeric(F.col("like_count")).alias("likes"), T.numeric(F.col("item_title")).alias("title"))


@query("x17_json", "activity", oracle="select log_id, json_extract_string(details_json, '$.k') as k from activity")
def json_paths(activity):
    return activity.select("log_id", F.get_json_object("details_json", "$.k").alias("k"))


@query("x19_digests", "documents", oracle="select doc_id, sha1(text) as sha1, sha256(text) as sha256 from documents")
def digests(documents):
    return documents.select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query("s14_item_key", "items", oracle="select item_id, substr(sha1(coalesce(group_name,'') || '|' || coalesce(person_name,'') || '|' || coalesce(like_count,'') || '|' || coalesce(publish_date,'')), 1, 10) as k from items")
def item_keys(items):
    return items.select("item_id", T.item_key(F.col("group_name"), F.col("person_name"), F.col("like_count"), F.col("publish_date")).alias("k"))


@query("s18_epoch_to_iso", "events", oracle="select event_id, strftime(make_timestamp(1700000000000000 + event_id * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso from events")
def epoch_iso(events):
    return events.select("event_id", F.concat(F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("event_id")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"))


@query("k4_relabel", "items", oracle="""select dataset_id, regexp_replace(dataset_id || ' — 12 items', ' — \\d+ \\w+$', '') || ' — ' || count(*)::varchar || ' items' as label from items group by dataset_id""")
def relabelled(items):
    return items.groupBy("dataset_id").agg(F.count("*").alias("n")).select("dataset_id", T.relabel(F.concat("dataset_id", F.lit(" — 12 items")), F.col("n")).alias("label"))


@query("u8_jaccard", "benchmark", oracle="""with w as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) as s from benchmark)
    select a.item_id as a, b.item_id as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::double, 6) as j, round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s))::double, 6) as c
    from w a join w b on b.item_id = a.item_id + 1""")
def neighbours_jaccard(benchmark):
    w = benchmark.select("item_id", T.word_set(F.col("text")).alias("s"))
    n = w.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("s").alias("s2"))
    j = w.withColumnRenamed("item_id", "a").join(n, "a")
    return j.select("a", "b", F.round(T.jaccard(F.col("s"), F.col("s2")), 6).alias("j"), F.round(T.containment(F.col("s"), F.col("s2")), 6).alias("c"))
