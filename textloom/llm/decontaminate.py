"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (13 words; a shorter item is one window) are sets of
``SHINGLE``-word shingles.  Containment of a whole window needs all of its
shingles, so its necessary prefix is one shingle: the one in fewest documents,
counted over the whole corpus.  A document joins on those shingles only; the
length and position bounds (the window must lie inside the document where the
shingle puts it) leave candidates, and each is verified word by word.

The benchmark is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows; the
documents pass through one block after another, so nothing is cut off when the
benchmark grows, and no document is shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import saved, slices, strings

WINDOW, SHINGLE, BLOCK_WINDOWS = 13, 3, 50_000
#: Blocks after which the partial result is written, so that workers don't pile up.
CHAIN = 4
#: Lower case for A-Z, 0-9 a-z and all bytes from 0x80 kept, the rest a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: What is added to a document's row.
_ADDED = StructType([StructField("n_words", LongType()), StructField("hits", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))])


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(words: list[bytes]) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))]


def _shingles(words, k: int):
    """The tuples of ``k`` words in a row, in order."""
    return zip(*(words[i:] for i in range(k)))


def _count_shingles(batches, wanted):
    """Documents by shingle, for the benchmark's shingles only, once a task."""
    counts: dict = {}
    sizes = {k: set(v) for k, v in wanted.value.items()}
    for batch in batches:
        for text in strings(batch.column(0)):
            words = words_of(text)
            for k, known in sizes.items():
                for s in known.intersection(_shingles(words, k)):
                    counts[s] = counts.get(s, 0) + 1
    yield pa.RecordBatch.from_pydict({"shingle": pa.array([b" ".join(s) for s in counts], pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})


def _hit(batches, index):
    """Adds a block's hit positions and items, the last three columns, to each document's row."""
    by_size = index.value
    schema = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]
    for batch in slices(batches, 1_024):
        n_words, all_hits, all_items = [], batch.column(len(batch.columns) - 2).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist()
        for r, text in enumerate(strings(batch.column("text"))):
            words = words_of(text)
            n = len(words)
            hits, items = set(), set()
            for k, prefix in by_size.items():
                for p, s in [(p, s) for p, s in enumerate(_shingles(words, k)) if s in prefix]:
                    for offset, window, owners in prefix[s]:
                        start = p - offset
                        if start < 0 or start + len(window) > n or owners <= items and hits.issuperset(range(start, start + len(window))):
                            continue
                        if tuple(words[start : start + len(window)]) == window:
                            hits.update(range(start, start + len(window)))
                            items |= owners
            n_words.append(n)
            if hits:
                all_hits[r] = sorted(hits.union(all_hits[r]))
                all_items[r] = sorted(items.union(all_items[r]))
        added = [pa.array(x, t) for x, t in zip((n_words, all_hits, all_items), schema)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *added], names=batch.schema.names)


def _blocks(benchmark: DataFrame):
    """Windows of the benchmark, in blocks; rows come one partition at a time."""
    block: dict = {}
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if item_id is None:
            continue
        for w in item_windows(words_of(text)):
            block.setdefault(w, set()).add(item_id)
        if len(block) >= BLOCK_WINDOWS:
            yield block
            block = {}
    if block:
        yield block


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document with its words inside occurrences of benchmark windows.

    Returns every row of ``docs``, its columns as they are, with n_words, hits
    (sorted word positions) and items (sorted item ids as strings); columns of
    these names are replaced.  Null or empty texts have no words and no hits;
    repeated rows are each judged, and of windows in several items all items
    count; a text of any length is read whole; items without words or without
    id match nothing; an empty benchmark hits nothing; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(*_ADDED.names)
    plain = docs.select("text")
    state = docs.select("*", F.lit(None).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    fields = StructType([*docs.schema.fields, *_ADDED.fields])
    done = 0
    for block in _blocks(benchmark):
        wanted: dict[int, set] = {}
        for w in block:
            k = min(SHINGLE, len(w))
            wanted.setdefault(k, set()).update(_shingles(w, k))
        b = spark.sparkContext.broadcast(wanted)
        counted = plain.select("text").mapInArrow(lambda it, b=b: _count_shingles(it, b), "shingle binary, n long")
        counts = {bytes(s): n for s, n in counted.groupBy("shingle").agg(F.sum("n")).collect()}  # at most the block's shingles
        index: dict[int, dict] = {}
        for w, owners in block.items():
            k = min(SHINGLE, len(w))
            n, offset, s = min((counts.get(b" ".join(s), 0), o, s) for o, s in enumerate(_shingles(w, k)))
            if n:
                index.setdefault(k, {}).setdefault(s, []).append((offset, w, frozenset(owners)))
        b = spark.sparkContext.broadcast(index)
        state = state.mapInArrow(lambda it, b=b: _hit(it, b), fields)
        done += 1
        if done % CHAIN == 0:
            state = saved(state)
    if not done:
        b = spark.sparkContext.broadcast({})
        state = state.mapInArrow(lambda it, b=b: _hit(it, b), fields)
    return state


def contaminated() -> Column:
    """Of rows of ``hits``: hit words are at least a twentieth of all."""
    return (F.size("hits") > 0) & (F.size("hits") * 20 >= F.col("n_words"))


def verdicts(found: DataFrame) -> DataFrame:
    """The digest columns."""
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and contamination verdict for every row of ``docs`` (see ``hits``)."""
    return verdicts(hits(docs.select("doc_id", "text"), benchmark))


def brute_force(text: str | None, items: dict) -> tuple:
    """(n_words, hit positions, item ids) of one text, by trying every window everywhere."""
    words = words_of(text)
    hit, owners = set(), set()
    for item_id, item in items.items():
        for w in item_windows(words_of(item)):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    owners.add(str(item_id))
    return len(words), sorted(hit), sorted(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest()
