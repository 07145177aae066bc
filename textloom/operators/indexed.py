"""Searches through an inverted index of the items' texts."""

from pyspark.sql import functions as F

from textloom.plans.graph import new_folder
from textloom.registry import query
from textloom.sources import text_index


def _indexed(items):
    path = new_folder(items.sparkSession)
    text_index.build(items, path)
    return items.sparkSession, path


@query("p4_indexed_word", "items", oracle=r"select item_id, len(regexp_extract_all(lower(transcript_text), '(?:^|[^\p{L}\p{M}\p{N}_])que(?:$|[^\p{L}\p{M}\p{N}_])'))::bigint > 0 as found from items where regexp_matches(lower(transcript_text), '(^|[^\p{L}\p{M}\p{N}_])que([^\p{L}\p{M}\p{N}_]|$)')")
def indexed_word(items):
    return text_index.whole_words(*_indexed(items), "que").select(F.col("key").alias("item_id"), (F.col("n") > 0).alias("found"))


@query("p4_indexed_phrase", "items", oracle=r"select item_id from items where regexp_matches(lower(transcript_text), '(^|[^\p{L}\p{M}\p{N}_])of the([^\p{L}\p{M}\p{N}_]|$)')")
def indexed_phrase(items):
    return text_index.whole_words(*_indexed(items), "Of the").select(F.col("key").alias("item_id"))


@query("p5_indexed_counts", "items", oracle="select item_id, len(regexp_extract_all(lower(transcript_text), 'tion'))::bigint as n from items where contains(lower(transcript_text), 'tion')")
def indexed_counts(items):
    return text_index.inside_words(*_indexed(items), "tion").select(F.col("key").alias("item_id"), "n")
