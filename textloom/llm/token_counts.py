"""Token counts from distinct pre-tokens.

Pieces are counted once per distinct pre-token.  The corpus' pre-token counts
are gathered over all documents; the ``HEAD`` most frequent ones are broadcast
with their piece counts, so documents sum those where they are, and only the
rare rest travels: (row, pre-token, frequency) joins the piece counts of the
rare pre-tokens by key and is summed per row.  No ids are kept.
"""

from __future__ import annotations

import itertools
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent, saved, strings, texts

#: Pre-tokens that are broadcast with their piece counts: at most this many, some MB.
HEAD = 300_000
#: Distinct pre-tokens that a task holds before it hands them on.
FLUSH = 400_000
#: Public split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(file: str):
    """The tokenizer of a vocabulary file, named or by its full path."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file if "/" in file else public_tokenizers.path(file))
    t.no_padding()
    t.no_truncation()
    _check(t, file)
    return t


def _check(tokenizer, file: str) -> None:
    """Raises unless the file asks for what ``splitter`` does: byte-level pieces by ``PATTERN``, special strings as they stand."""
    import json

    d = json.loads(tokenizer.to_str())
    pre, model = d.get("pre_tokenizer") or {}, d["model"]
    whole = all(not t[k] for t in d.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    plain = d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not (whole and plain and bpe):
        raise ValueError(f"{file}: only byte-level BPE with the public split pattern and plain special tokens is supported")


def splitter(specials: list[str]):
    """A function that lists a text's pre-tokens, special strings whole."""
    import regex

    find = regex.compile(PATTERN).findall
    if not specials:
        return find
    cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")

    def pre_tokens(text: str) -> list[str]:
        if not any(s in text for s in specials):
            return find(text)
        out: list[str] = []
        for i, part in enumerate(cut.split(text)):
            out += [part] if i % 2 else find(part)
        return out

    return pre_tokens


def specials_of(spark: SparkSession, file: str) -> list[str]:
    """The file's special strings; a task reads it, so the driver needn't hold the vocabulary."""

    def read(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"special": pa.array([t.content for t in load(file).get_added_tokens_decoder().values()], pa.string())})

    return [r.special for r in spark.range(0, 1, 1, 1).mapInArrow(read, "special string").collect()]


def _frequencies(batches, specials):
    """(pre-token, n) sums of a task."""
    split, counts = splitter(specials), Counter()

    def out():
        return pa.RecordBatch.from_pydict({"pre": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    for batch in batches:
        for text in strings(batch.column(0)):
            counts.update(split(text or ""))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    yield out()


def _pieces(batches, file):
    """Adds to each distinct pre-token the number of its pieces."""
    t = load(file)
    for batch in batches:
        pre = batch.column(0)
        n = [len(e) for e in t.encode_batch_fast(pre.to_pylist(), add_special_tokens=False)]
        yield pa.RecordBatch.from_pydict({"pre": pre, "n": batch.column(1), "pieces": pa.array(n, pa.int32())})


def _known_part(batches, head, specials):
    """Per document row: the sum over broadcast pre-tokens and the rest as (pre-token, n)."""
    split, pieces = splitter(specials), head.value
    for batch in batches:
        sums, rest = [], []
        for text in strings(batch.column(1)):
            total, rare = 0, {}
            for pre in split(text or ""):
                n = pieces.get(pre)
                if n is None:
                    rare[pre] = rare.get(pre, 0) + 1
                else:
                    total += n
            sums.append(total)
            rest.append(list(rare.items()))
        offsets = list(itertools.accumulate(map(len, rest), initial=0))
        flat = list(itertools.chain.from_iterable(rest))
        pairs = pa.StructArray.from_arrays([pa.array([p for p, _ in flat], pa.string()), pa.array([n for _, n in flat], pa.int32())], ["pre", "n"])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(2), "known": pa.array(sums, pa.int64()), "rest": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)})


def vocabulary(plain: DataFrame, file: str) -> DataFrame:
    """(pre, n, pieces) of every distinct pre-token of column ``text``, as a written table."""
    specials = specials_of(plain.sparkSession, file)
    counted = plain.select("text").mapInArrow(lambda it: _frequencies(it, specials), "pre string, n long")
    return saved(counted.groupBy("pre").agg(F.sum("n").alias("n")).mapInArrow(lambda it: _pieces(it, file), "pre string, n long, pieces int"))


def count_tokens(docs: DataFrame, file: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit``) for every row.

    Null and empty texts have no tokens; repeated rows are each counted; an
    empty table gives no rows; columns besides doc_id and text are ignored.
    Special strings inside a text are one token, as the library has it.
    Pre-tokens of equal counts are all broadcast or none.  A text of any length
    is counted whole.
    """
    specials = specials_of(docs.sparkSession, file)
    plain = texts(docs)
    vocab = vocabulary(plain, file)
    least = frequent(vocab, HEAD)
    head = docs.sparkSession.sparkContext.broadcast({r.pre: r.pieces for r in vocab.filter(F.col("n") >= least).select("pre", "pieces").toLocalIterator()})
    rows = plain.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(
        lambda it: _known_part(it, head, specials), f"doc_id {dict(plain.dtypes)['doc_id']}, n_bytes long, known long, rest array<struct<pre:string,n:int>>"
    )
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.pre", F.col("r.n").alias("k"))
    rest = rare.join(vocab.filter(F.col("n") < least).select("pre", "pieces"), "pre").select("row", F.lit(None).cast(dict(plain.dtypes)["doc_id"]).alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("k") * F.col("pieces")).cast("long").alias("n"))
    both = rows.select("row", "doc_id", "n_bytes", F.col("known").alias("n")).unionByName(rest)
    return both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def brute_force(text: str | None, file: str = "byte_bpe_50k.json") -> int:
    """The library's own count for a whole text."""
    return len(load(file).encode(text or "", add_special_tokens=False).ids)
