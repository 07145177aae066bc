"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Fixed value: Unicode white space with the separators U+001C to U+001F, for the inside of a character class.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The signs of ``WS``.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: The default English stop words of vocabulary reports.  A longer list can be passed.
STOPWORDS = """a about above after again against all almost along already also although always am among an and another any anyone anything are
around as at back be became because become been before behind being below between both but by can cannot could did do does doing done down
during each either else enough etc even ever every everyone everything few first for from further get give go had has have having he hence
her here hers herself him himself his how however i if in indeed into is it its itself keep last least less made many may me might mine more
moreover most mostly much must my myself neither never nevertheless next no nobody none nor not nothing now of off often on once one only
onto or other others our ours ourselves out over own per perhaps please put quite rather really same she should since so some somehow
someone something sometimes still such than that the their theirs them themselves then there therefore these they this those though through
thus to together too toward under until up upon us very was we well were what when where whether which while who whole whom whose why will
with within without would yet you your yours yourself yourselves""".split()


def strip(text: Column | str) -> Column:
    """Without the white space at both ends."""
    c = F.col(text) if isinstance(text, str) else text
    return F.btrim(c, F.lit(SPACES))


def word_count(text: Column | str) -> Column:
    """Words between Unicode white space; null is 0."""
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def words(text: Column | str) -> Column:
    """What stands between white space; splitting takes a fifth of the time of extracting every word."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(c, f"[{WS}]+"), lambda w: w != "")


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_tokens(text: Column | str, stopwords: list[str] = STOPWORDS) -> Column:
    # Spark looks literals of a long list up in a hash set.
    return F.filter(tokens(text), lambda t: ~t.isin(*stopwords))


def sentences(text: Column) -> Column:
    """Sentences of a text without white space at its ends; none is empty."""
    return F.filter(F.split(text, rf"(?<=[.!?])[{WS}]+"), lambda s: s != "")


def word_shingles(text: Column, k: int = 8) -> Column:
    """The set of ``k``-word runs of the lower-cased words; empty for shorter texts."""
    w = words(F.lower(text))
    n = F.size(w)
    made = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    return F.when(n >= k, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)))


def text_key(text: Column, size: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z ]", ""), 1, size)


def clip_words(text: Column, n: int) -> Column:
    """The first ``n`` words and a mark, where there are more; the text is split no further than that."""
    # White space at the beginning takes one piece, the rest of the text another.
    w = F.filter(F.split(text, f"[{WS}]+", n + 2), lambda p: p != "")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" [...]"))).otherwise(text)


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def seconds_of(timestamp: Column) -> Column:
    """Seconds of the first H:MM:SS or MM:SS in a string; null without one."""
    p = r"(?:(\d+):)?(\d{1,2}):(\d{2})"
    part = lambda g: F.coalesce(F.expr("null").cast("int"), F.regexp_extract(timestamp, p, g).try_cast("int"))
    return F.when(timestamp.rlike(p), F.coalesce(part(1), F.lit(0)) * 3600 + part(2) * 60 + part(3))


def segment_id(item_id: Column, index: Column) -> Column:
    """Item id and index, zero-padded to four digits and never cut."""
    return F.concat(item_id, F.lit(":"), F.format_string("%04d", index))


def numeric(value: Column) -> Column:
    """A number-like string as double, else null; NaN and infinities are not numbers here."""
    v = F.trim(value).try_cast("double")
    return F.when(F.trim(value).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v)


def item_key(*parts: Column) -> Column:
    """First ten hex digits of the SHA-1 of the parts joined by bars; null parts are empty."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 10)


def slug(text: Column, default: str = "query", size: int = 40) -> Column:
    """ASCII letters and digits of the decomposed text, other runs as underscores, cut to ``size``; case is kept.

    Spark has no decomposition, so text goes through one Arrow batch function.
    """

    @F.pandas_udf(StringType())
    def decomposed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))

    s = F.regexp_replace(F.regexp_replace(decomposed(text), "[^A-Za-z0-9]+", "_"), r"\A_+|_+\z", "")
    return F.substring(F.when(s == "", F.lit(default)).otherwise(s), 1, size)


def clean_metadata(value: Column) -> Column:
    """Trimmed; empty is null."""
    v = strip(value)
    return F.when(v != "", v)


def clean_date(value: Column) -> Column:
    """A trimmed value that begins with a valid YYYY-MM-DD, whole; empty is null, another value an error."""
    v = clean_metadata(value)
    good = F.substring(v, 1, 10).rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.substring(v, 1, 10).try_cast("date").isNotNull()
    return F.when(v.isNull() | good, v).otherwise(F.raise_error(F.concat(F.lit("publish_date must start with a date as YYYY-MM-DD: "), v)).cast("string"))


def clean_duration(value: Column) -> Column:
    """A trimmed number of 0 or more, whole ones without a point; empty is null, another value an error."""
    v = clean_metadata(value)
    n = v.try_cast("double")
    text = F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string"))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(n >= 0, text).otherwise(F.raise_error(F.concat(F.lit("duration_secs must be a number of 0 or more: "), v)).cast("string"))


def relabel(label: Column, n: Column, noun: str = "items") -> Column:
    """The label with its count suffix replaced."""
    return F.concat(F.regexp_replace(label, " — \\d+ \\w+$", ""), F.lit(" — "), n.cast("string"), F.lit(f" {noun}"))
