"""Line-first cleaning: rules per line, failing lines go, then the document is judged.

Only DataFrame functions.  A line fails as *punctuation* (marks and symbols
rival its words), *navigation* (a row of short entries between bars or angle
quotes) or *boilerplate* (licence, rights, cookie, sign-in and sharing lines,
and lines already seen in the document).  A document is rejected if more than
``MOST_LOST`` percent of its word characters were in failing lines, or if it
fails the base rules: under ``LEAST_WORDS`` words, or more than
``MOST_REPEATED`` percent of them in five-word windows found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, texts

LEAST_WORDS, MOST_REPEATED, MOST_LOST, SPAN = 10, 20, 50, 5
#: Marks that crowd a line, separators of menus, phrases of boilerplate.
MARKS = "!#*$%&<>@^_=~{}[]\\"
BARS = "|»›•"
PHRASES = (
    r"^(this work is )?licensed under ",
    r"all rights reserved",
    r"^copyright ",
    r"©",
    r"\b(cookie|privacy) policy\b",
    r"\bterms (of|and) (use|service|conditions)\b",
    r"^(sign|log) (in|up|out)\b",
    r"^(share|follow us|subscribe|read more|click here)\b",
    r"\bjavascript\b",
)
#: A boilerplate phrase condemns a line of at most so many words.
SHORT_LINE = 25
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, ""))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column) -> Column:
    """Whether one line fails the punctuation, navigation or boilerplate rules."""
    n = F.regexp_count(line, F.lit(WORD))
    marks, bars = count_of(line, MARKS), count_of(line, BARS)
    phrases = (n <= SHORT_LINE) & F.lower(line).rlike("|".join(f"({p})" for p in PHRASES))
    return (2 * marks > n) & (marks >= 3) | (bars >= 3) & (3 * bars >= n) | phrases


def repeated_words(words: Column) -> Column:
    """Words inside ``SPAN``-word windows that the text has twice or more.

    Windows are compared by 64-bit hash.  They are sorted with their positions,
    so that equal ones are neighbours; the repeated positions, in order, then
    each add what the next one does not cover.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (SPAN - 1)), lambda i: F.struct(F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(SPAN))).alias("h"), i.alias("i")))

    def positions(s: Column) -> Column:
        same = lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), F.get(s, i + 1)["h"] == x["h"], F.get(s, i - 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(SPAN), F.coalesce(F.get(p, i + 1) - x, F.lit(SPAN))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def of(h: Column) -> Column:
        return let(F.sort_array(windows(h)), lambda s: let(positions(s), covered))

    return F.when(F.size(words) < SPAN + 1, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base measures of every row; a null text is empty."""
    d = texts(docs).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    d = d.withColumn("lines", lines)
    return d.select(
        "doc_id",
        "text",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        word_chars(F.col("text")).cast("long").alias("word_chars"),
        count_of(F.col("text"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """Every row with its measures, its cleaned text and the verdict.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, lost_chars, cleaned, base_failed and kept.  Null
    and empty texts have no words and fail the base rules; repeated rows are
    each judged; an empty table gives no rows; other columns are ignored.  Of
    equal lines the first stays; a text of any length is one row, read whole.
    """
    d = measures(docs).withColumn("good", F.array_distinct(F.filter("lines", lambda x: ~line_fails(x))))
    stay = F.aggregate("good", F.lit(0).cast("long"), lambda a, x: a + word_chars(x))
    d = d.withColumn("lost_chars", F.col("word_chars") - stay)
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = 100 * F.col("lost_chars") > MOST_LOST * F.col("word_chars")
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        "lost_chars",
        F.array_join("good", "\n").alias("cleaned"),
        base_failed.alias("base_failed"),
        (~base_failed & ~lost).alias("kept"),
    )


def _sql_count(text: str, chars: str) -> str:
    chars = chars.replace("'", "''")
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the digest columns of ``clean``."""
    spaces = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    phrases = "|".join(f"({p})" for p in PHRASES)
    n = rf"len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))"
    fails = (
        f"(2 * {_sql_count('x', MARKS)} > {n} and {_sql_count('x', MARKS)} >= 3 or {_sql_count('x', BARS)} >= 3 and 3 * {_sql_count('x', BARS)} >= {n}"
        f" or {n} <= {SHORT_LINE} and regexp_matches(lower(x), '{phrases}'))"
    )
    return rf"""
    with d as (select doc_id, coalesce(text, '') as t from {table}),
    w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
                 list_filter(string_split(t, chr(10)), lambda x: translate(x, {spaces}, '') <> '') as lines from d),
    g as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(ws[i:i+{SPAN - 1}], ' ')) as n
          from (select doc_id, ws, unnest(range(1, len(ws) - {SPAN - 2})) as i from w)),
    r as (select doc_id, count(distinct i + k) as n_repeat_words from g, range({SPAN}) k(k) where n > 1 group by doc_id),
    m as (select doc_id, len(ws)::bigint as n_words, length(translate(t, {spaces}, ''))::bigint as word_chars,
                 {_sql_count("t", "#*$%&|<>")}::bigint as n_symbols,
                 (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                 coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
                 list_sum(list_transform(list_distinct(list_filter(lines, lambda x: not {fails})), lambda x: length(translate(x, {spaces}, '')))) as stay
          from w left join r using (doc_id)),
    b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and not (100 * (word_chars - coalesce(stay, 0)) > {MOST_LOST} * word_chars) as kept
    from b"""
