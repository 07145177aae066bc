"""An inverted index of texts: a written table of words and their places, by buckets of words.

A search reads the buckets of its words instead of every text.  Words are runs
of word signs in lower case; a place knows the signs up to the next word, so
phrases are matched as they are written.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: A word and what stands up to the next one, in Java's syntax, and the same for terms.
WORD = r"(?U)(\w+)(\W*)"
_TERM = regex.compile(r"([\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]+)([^\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]*)")
#: Signs between two words that a place keeps; terms with longer gaps can't be looked up.
GAP = 16


def _bucket(word, buckets: int):
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def build(texts: DataFrame, path: str, key: str = "item_id", text: str = "transcript_text", buckets: int = BUCKETS) -> None:
    """Writes the index of ``texts`` under ``path``: ``words`` (bucket, word, key, at, gap) and ``terms`` (word, items).

    A row has a word's places in one text.  Files are ranges of (bucket, word),
    so a frequent word spreads over several; null texts have no words.
    """
    # Dealt by key, so a text's places are gathered where it is.
    dealt = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    low = F.lower("text")
    both = F.arrays_zip(F.regexp_extract_all(low, F.lit(WORD), F.lit(1)).alias("word"), F.regexp_extract_all(low, F.lit(WORD), F.lit(2)).alias("gap"))
    places = dealt.select("key", F.posexplode(both).alias("at", "w")).select("key", "at", "w.word", F.when(F.length("w.gap") <= GAP, F.col("w.gap")).alias("gap"))
    rows = places.groupBy("key", "word").agg(F.sort_array(F.collect_list(F.struct("at", "gap"))).alias("p"))
    rows = rows.select(_bucket("word", buckets).alias("bucket"), "word", "key", F.col("p.at").alias("at"), F.col("p.gap").alias("gap"))
    # Gaps that are all single spaces, nearly all, don't move.
    rows = rows.withColumn("gap", F.when(~F.forall("gap", lambda g: g.eqNullSafe(F.lit(" "))), F.col("gap")))
    rows = rows.repartitionByRange("bucket", "word", "key").sortWithinPartitions("bucket", "word")
    rows.withColumn("gap", F.coalesce("gap", F.transform("at", lambda _: F.lit(" ")))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/words")
    spark = texts.sparkSession
    spark.read.parquet(f"{path}/words").groupBy("word").agg(F.count("*").alias("items")).write.mode("overwrite").parquet(f"{path}/terms")


def _parse(term: str) -> tuple[list[str], list[str]] | None:
    """Words of a term and the gaps between them; None if it doesn't begin and end with a word sign, or a gap is too long."""
    t = term.strip().lower()
    found = _TERM.findall(t)
    if not found or "".join(w + g for w, g in found) != t or found[-1][1] or any(len(g) > GAP for _, g in found):
        return None
    return [w for w, _ in found], [g for _, g in found[:-1]]


def places(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The index rows of ``words``: only their buckets are read."""
    rows = spark.range(1).select(*(_bucket(F.lit(w), buckets).alias(f"b{k}") for k, w in enumerate(words))).first()
    return spark.read.parquet(f"{path}/words").filter(F.col("bucket").isin(*sorted(set(rows))) & F.col("word").isin(*words))


def whole_words(spark: SparkSession, path: str, term: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, n) of the texts that hold the term as whole words, and how often; what ``corpus.search`` finds by reading all.

    A term must begin and end with a word sign.
    """
    parsed = _parse(term)
    if parsed is None:
        raise ValueError(f"can't look up {term!r}: it must begin and end with a word sign, with gaps of {GAP} signs at most")
    words, gaps = parsed
    rows = places(spark, path, sorted(set(words)), buckets)
    if len(words) == 1:
        return rows.select("key", F.size("at").cast("long").alias("n"))
    each = rows.select("key", "word", F.explode(F.arrays_zip("at", "gap")).alias("p")).select("key", "word", "p.*")
    # Where the phrase would begin, for each of its places that the word may be.
    starts = []
    for k, w in enumerate(words):
        fits = F.col("word") == w
        if k < len(gaps):
            fits = fits & (F.col("gap") == gaps[k])
        starts.append(F.when(fits, F.struct((F.col("at") - k).alias("start"), F.lit(k).alias("k"))))
    hits = each.select("key", F.explode(F.filter(F.array(*starts), lambda s: s.isNotNull())).alias("s")).groupBy("key", "s.start").agg(F.count("*").alias("k")).filter(F.col("k") == len(words))
    return hits.groupBy("key").agg(F.count("*").alias("n"))


def inside_words(spark: SparkSession, path: str, term: str) -> DataFrame:
    """(key, n) of the texts with words that hold the term, and how often it occurs; the list of distinct words tells which.

    A term must be word signs only, so no match spans two words.
    """
    t = term.strip().lower()
    if _parse(t) is None or len(_parse(t)[0]) > 1:
        raise ValueError(f"can't look up {term!r}: it must be word signs only")
    found = spark.read.parquet(f"{path}/terms").filter(F.contains("word", F.lit(t))).select("word")
    times = F.regexp_count("word", F.lit(r"\Q" + t + r"\E"))
    return spark.read.parquet(f"{path}/words").join(found, "word").groupBy("key").agg(F.sum(times * F.size("at")).cast("long").alias("n"))
