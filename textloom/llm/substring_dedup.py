"""Substring dedup by Rabin-Karp hashes of every window of ``WINDOW`` words.

Every window of every text is hashed (two 64-bit lanes, from running sums of
word hashes).  Shipping each of them would move several times the corpus, so
they're counted at two sizes, without losing any:

1. *Blocks.*  A text's windows are cut into runs at windows whose own hash says
   so, about one in ``EVERY``; equal passages are cut alike.  A run's Rabin-Karp
   hash stands for all its windows: where a smaller document has the same run,
   all of them repeat.
2. *Windows* of the runs that are the first of their kind.  A repeated window
   has an equal least ``ANCHOR``-word hash inside, so only windows whose anchor
   is in runs of two texts go on, each as a row of its own.

Removed windows merge into maximal spans of words.  Groups of copies meet as
rows pre-aggregated by hash; hashes with very many rows are looked up in a
broadcast of bounded size (``join_hot``).  Texts are shuffled once by their id,
and a second time only where the windows of step 2 decide.  A text is read
whole in one task, whose memory grows with the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, saved, slices, strings

WINDOW, ANCHOR, EVERY = 50, 12, 64
#: Odd bases of the two lanes, and the multiplier that mixes a hash's bits.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BLOCK = "doc_id long, key long, start int, length int, b1 long, b2 long, anchors array<long>"
_SETTLED = "doc_id long, key long, n_words long, n_removed long, spans array<int>, kept string, kept_sha256 string, text string, w1 array<long>, w2 array<long>, at array<int>"
_powers: list = []


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _power(n: int) -> list:
    """Powers and inverse powers of both bases, at least ``n`` of each."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(1 << 14, 1 << n.bit_length())
        found = []
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                pair.append(np.multiply.accumulate(steps))
            found.append(pair)
        _powers[:] = found
    return _powers


def _mixed(h):
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _sums(words: list[bytes]) -> list:
    """Running sums of the word hashes by powers of each base."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return [np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(h * up[: len(h)]))) for up, _ in _power(len(words) + 1)]


def _runs(sums, start, end) -> list:
    """Hashes of the words from ``start`` up to ``end``, by lane; the length counts too."""
    size = _MIX * (end - start).astype(np.uint64)
    return [_mixed((s[end] - s[start]) * down[start] + size) for s, (_, down) in zip(sums, _power(len(sums[0])))]


def _least(a, span: int):
    """The least of every ``span`` neighbours."""
    size = 1
    while 2 * size <= span:
        a, size = np.minimum(a[:-size], a[size:]), 2 * size
    return np.minimum(a[: len(a) - (span - size)], a[span - size :])


def windows(words: list[bytes]):
    """(lane 1, lane 2, anchor) of every window, and the running sums."""
    sums = _sums(words)
    at = np.arange(len(words) - WINDOW + 1)
    w1, w2 = _runs(sums, at, at + WINDOW)
    at = np.arange(len(words) - ANCHOR + 1)
    return w1, w2, _least(_runs(sums[:1], at, at + ANCHOR)[0], WINDOW - ANCHOR + 1), sums


def _blocks(batches):
    """Every text's blocks, with the anchors of their windows."""
    for batch in slices(batches):
        rows, anchors, sizes = [], [], []
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
            words = words_of(text)
            if len(words) < WINDOW:
                continue
            w1, _, least, sums = windows(words)
            cut = w1 % np.uint64(EVERY) == 0
            cut[0] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(w1))
            b1, b2 = _runs(sums, start, end + (WINDOW - 1))
            new = cut.copy()
            new[1:] |= least[1:] != least[:-1]
            anchors.append(least[new].view(np.int64))
            sizes.append(np.add.reduceat(new, start, dtype=np.int64))
            n = len(start)
            rows.append((np.full(n, doc_id), np.full(n, key), start, end - start, b1.view(np.int64), b2.view(np.int64)))
        if rows:
            flat = [np.concatenate(c) for c in zip(*rows)]
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(flat, kinds)]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(anchors)))
            yield pa.RecordBatch.from_arrays([*arrays, lists], names=["doc_id", "key", "start", "length", "b1", "b2", "anchors"])


def _spans(covered) -> list[int]:
    """Starts and ends of the covered runs of words, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], covered, [0])).astype(np.int8)))
    return edge.tolist()


def _cover(n: int, starts, ends):
    """Which of ``n`` words lie in any of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.asarray(starts, np.int64), 1)
    np.add.at(steps, np.asarray(ends, np.int64), -1)
    return np.add.accumulate(steps)[:n] > 0


def _left(words: list[bytes], spans: list[int], whole: bool) -> tuple:
    """(words removed, spans, kept text if ``whole``, its digest)."""
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out += words[last:a]
        last = b
    out += words[last:]
    kept = b" ".join(out)
    return len(words) - len(out), spans, kept.decode("utf-8", "surrogatepass") if whole else None, hashlib.sha256(kept).hexdigest()


def _settle(batches, whole: bool):
    """What blocks decide.  Where windows have to decide too, the row keeps its
    text and lists those windows."""
    names = [f.split()[0] for f in _SETTLED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] + [pa.string()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())]
    for batch in slices(batches):
        out = []
        for doc_id, key, text, known, wanted in zip(*(strings(c) for c in batch.columns)):
            words = words_of(text)
            n = len(words)
            mine = [(s["start"], s["length"]) for s in known or () if s["key"] == key]
            starts, ends = [s for s, _ in mine], [s + k + WINDOW - 1 for s, k in mine]
            spans = _spans(_cover(n, starts, ends)) if mine else []
            if wanted and n >= WINDOW:
                w1, w2, least, _ = windows(words)
                open_ = np.isin(least, np.array(wanted, np.int64).view(np.uint64))
                for s, k in mine:
                    open_[s : s + k] = False
                at = np.flatnonzero(open_)
                if len(at):
                    out.append((doc_id, key, n, None, spans, None, None, text, w1[at].view(np.int64), w2[at].view(np.int64), at.astype(np.int32)))
                    continue
            out.append((doc_id, key, n, *_left(words, spans, whole), None, None, None, None))
        columns = zip(*out) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _finish(batches, whole: bool):
    """Rows that waited for their windows: ``hit`` are the starts of the repeated ones."""
    names = ["doc_id", "n_words", "n_removed", "spans", "kept", "kept_sha256"]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] + [pa.string()] * 2
    for batch in slices(batches):
        out = []
        for doc_id, n, text, spans, hit in zip(*(strings(c) for c in batch.columns)):
            hit = np.array(hit or (), np.int64)
            found = _spans(_cover(n, [*spans[::2], *hit], [*spans[1::2], *(hit + WINDOW)]))
            out.append((doc_id, n, *_left(words_of(text), found, whole)))
        columns = zip(*out) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def dedup(docs: DataFrame, whole: bool = True) -> DataFrame:
    """Every row of ``docs`` without the words of windows that start in a smaller document.

    Returns doc_id, n_words, n_removed, spans (starts and ends of the removed
    runs of words, in turn), kept (the words left, joined by a space; null
    unless ``whole``) and kept_sha256.  Windows are judged on the input.  A null
    text has no words; a text under ``WINDOW`` words loses none; a text of any
    length is read whole.  Windows that repeat only inside a document stay; so
    do those of rows that share the smallest id (a tie), each of which is judged
    by its own text.  A row without an id loses nothing and makes no other row
    lose any.  An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    named = docs.filter("doc_id is not null")
    blocks = saved(named.mapInArrow(_blocks, _BLOCK))
    first = saved(blocks.groupBy("b1", "b2").agg(F.min_by("anchors", "doc_id").alias("anchors"), F.min("doc_id").alias("least"), F.count("*").alias("n")))
    again = join_hot(blocks.drop("anchors"), first.filter("n > 1").drop("anchors"), ["b1", "b2"], blocks.count()).filter("doc_id > least")

    anchors = first.select(F.col("least").alias("doc_id"), F.explode("anchors").alias("anchor"))
    # Two blocks of one text that meet in a window share its anchor: other texts count.
    often = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    often = saved(often.filter("least < most").drop("least", "most"))
    wanted = join_hot(anchors, often, "anchor", anchors.count())
    known = again.select("doc_id", F.struct("key", "start", "length").alias("known"), F.lit(None).cast("long").alias("anchor"))
    state = known.unionByName(wanted.select("doc_id", F.lit(None).cast(known.schema["known"].dataType).alias("known"), "anchor"))
    state = state.groupBy("doc_id").agg(F.collect_list("known").alias("known"), F.collect_set("anchor").alias("wanted"))

    nothing = (F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("known", "wanted"))
    joined = named.join(state, "doc_id", "left").unionByName(docs.filter("doc_id is null").select("*", *nothing))
    settled = saved(joined.mapInArrow(lambda it: _settle(it, whole), _SETTLED))
    shown = ["doc_id", "n_words", "n_removed", "spans", "kept", "kept_sha256"]
    done, waiting = settled.filter("at is null").select(*shown), settled.filter("at is not null")

    rows = waiting.select("doc_id", "key", F.explode(F.arrays_zip("w1", "w2", "at")).alias("w")).select("doc_id", "key", "w.*")
    total = waiting.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    least = rows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    repeated = join_hot(rows, saved(least.filter("least < most").drop("most")), ["w1", "w2"], total).filter("doc_id > least")
    hit = repeated.groupBy("doc_id", "key").agg(F.collect_set("at").alias("hit"))
    late = waiting.select("doc_id", "key", "n_words", "text", "spans").join(hit, ["doc_id", "key"], "left")
    late = late.select("doc_id", "n_words", "text", "spans", "hit").mapInArrow(lambda it: _finish(it, whole), settled.select(*shown).schema)
    return done.unionByName(late)


def brute_force(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows, window by window."""
    texts = [(i, words_of(t)) for i, t in rows]
    least: dict = {}
    for i, words in texts:
        for a in range(len(words) - WINDOW + 1 if i is not None else 0):
            w = tuple(words[a : a + WINDOW])
            least[w] = min(i, least.get(w, i))
    out = []
    for i, words in texts:
        gone = {a + k for a in range(len(words) - WINDOW + 1 if i is not None else 0) if least[tuple(words[a : a + WINDOW])] < i for k in range(WINDOW)}
        kept = b" ".join(w for a, w in enumerate(words) if a not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the digest columns of ``dedup``."""
    return rf"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from {table}),
    w as (select doc_id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: struct_pack(i := i, h := md5(array_to_string(ws[i:i + {WINDOW - 1}], ' '))))) as x from d),
    l as (select doc_id, x.i as i, min(doc_id) over (partition by x.h) as least from w),
    g as (select distinct doc_id, i + k as p from l, range({WINDOW}) k(k) where least < doc_id),
    p as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d),
    k as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from p anti join g using (doc_id, p) group by doc_id)
    select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
    from d left join k using (doc_id)"""
