"""SQL functions of the engine: expressions that Catalyst puts in the place of the call.

``register`` makes them temporary functions of a session, with SQL bodies, so a
query that calls them plans like one that spells the expression out.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from textloom.functions.text import STOPWORDS, TOKEN, WS

_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)
#: Half of the Wilson interval's formula: the middle, and the distance to either end.
_MIDDLE, _HALF = "(k / n + z * z / (2 * n)) / (1 + z * z / n)", "z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)"

#: Fixed value: letters and digits of Unicode 14 to 16 that DuckDB knows and Java 17 doesn't.
_NEWER = """870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a 1057c-1058a
1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81 11071-11072 11075 1123f-11240 11740-11746
11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132
1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739
31350-323af"""
_KNOWN = r"\p{L}\p{N}_" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in _NEWER.split())

#: name -> (arguments, result, body)
FUNCTIONS = {
    "strip_text": ("t string", "string", rf"regexp_replace(t, r'\A[{WS}]+|[{WS}]+\z', '')"),
    "text_words": ("t string", "array<string>", rf"regexp_extract_all(t, r'[^{WS}]+', 0)"),
    "word_count": ("t string", "bigint", rf"cast(coalesce(size(regexp_extract_all(t, r'[^{WS}]+', 0)), 0) as bigint)"),
    "text_tokens": ("t string", "array<string>", f"regexp_extract_all(lower(coalesce(t, '')), r'{TOKEN}', 0)"),
    "content_tokens": ("t string", "array<string>", f"filter(regexp_extract_all(lower(coalesce(t, '')), r'{TOKEN}', 0), x -> x not in ({_LIST}))"),
    "text_sentences": ("t string", "array<string>", rf"filter(split(t, r'(?<=[.!?])[{WS}]+'), s -> s <> '')"),
    # Counts as DuckDB's functions make them: null stays null, white space inside \s is ASCII, empty sentences count, a capital dotted I becomes an i, and two capitals aren't known.
    "plain_word_count": ("t string", "bigint", r"cast(size(regexp_extract_all(t, r'[^\t\n\x0b\f\r \x{85}\x{a0}\x{2028}\x{2029}]+', 0)) as bigint)"),
    "plain_token_count": ("t string", "bigint", f"cast(size(regexp_extract_all(lower(translate(t, '\u0130\ua7cb\ua7dc', 'i  ')), r'[{_KNOWN}]{{2,}}', 0)) as bigint)"),
    "plain_sentence_count": ("t string", "bigint", r"cast(size(regexp_extract_all(t, r'[.!?][\t\n\f\r ]+|\x01', 0)) + 1 as bigint)"),
    "wilson_low": ("k double, n double, z double default 1.96", "double", f"case when n > 0 then greatest(0d, least(1d, {_MIDDLE} - {_HALF})) end"),
    "wilson_high": ("k double, n double, z double default 1.96", "double", f"case when n > 0 then greatest(0d, least(1d, {_MIDDLE} + {_HALF})) end"),
    "f1_score": ("tp bigint, fp bigint, fn bigint", "double", "case when tp > 0 then 2.0d * tp / (2 * tp + fp + fn) end"),
    "jaccard": ("a array<string>, b array<string>", "double", "case when size(array_union(a, b)) > 0 then size(array_intersect(a, b)) / size(array_union(a, b)) else 0d end"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {result} return {body}")
    return list(FUNCTIONS)
