"""Convolutional text classifier for toxicity, trained in numpy.

Words are hashed into five embedding tables (whole word, first four to seven
bytes) that are summed; filters of widths 1, 2 and 3 run over the words of a
whole text and are max-pooled in chunks of ``CHUNK`` words; the largest and the
mean of a text's chunks go to a linear layer that gives the logit.  Buckets seen in fewer than ``LEAST_DOCS`` training documents stay
zero, so rare words can't be learnt by heart; the first embedding dimension
starts at the word's smoothed log-odds.

Everything is learnt from all labelled documents: counts are summed over them,
a warm-up on a bounded number of them starts the weights, a pass over every one
that isn't held back goes on from there in tasks whose weights are averaged, and
the thresholds come from every document held back.

Thresholds are calibrated by language: a naive Bayes guess from the text
itself (never the lang column of a scored row) picks the language, and its
threshold, the middle of the scores' gap on held-back training documents, is
moved to ``THRESHOLD``.  One table serves all languages that are too rare.
"""

from __future__ import annotations

import pickle
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, saved, strings, worker_cache
from .decontaminate import words_of

#: The warm-up sees at most so many labelled documents of each class; a task of the pass over all of them so many.
TRAIN_DOCS, TASK_DOCS = 2_000, 8_192
BITS, DIM, FILTERS, WIDTHS = 16, 8, 8, (1, 2, 3)
#: Bytes of a word that each table hashes.
PARTS = (1 << 20, 4, 5, 6, 7)
LEAST_DOCS, STEPS, BATCH, RATE = 5, 250, 64, 0.07
THRESHOLD = 0.3
#: Words after which a batch ends.
BATCH_WORDS = 200_000
#: Words that are pooled together.
CHUNK = 24
#: A language gets its own threshold from so many held-back documents of each class.
LEAST_BY_LANGUAGE = 10
#: Languages that are told apart, at most (those with the most labels; the others are one); cells of a logit's histogram to 1.
LANGUAGES, CELLS = 64, 64
#: Documents that a worker scores at once, and bytes of text after which a block ends.
BLOCK, BLOCK_BYTES = 256, 1 << 20
#: Words whose buckets a worker remembers.
REMEMBERED = 100_000


class _Buckets(dict):
    """The buckets of a word (whole, and its first four to seven bytes) as 32-bit numbers; at most ``REMEMBERED`` short words."""

    def __missing__(self, w: bytes) -> bytes:
        at = struct.pack(f"={len(PARTS)}i", *((zlib.crc32(w[:k], k) & ((1 << BITS) - 1)) + (i << BITS) for i, k in enumerate(PARTS)))
        if len(w) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[w] = at
        return at

    def of(self, words) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32).reshape(-1, len(PARTS))


def _flat(texts_of, buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: each word's row in the table of distinct words, the
    texts' starts, the distinct words' buckets and the texts' numbers of words.
    Every text ends in padding (row 0) as long as the widest filter less one,
    and starts with one padding, so empty texts have a word too."""
    rows: dict[bytes, int] = {}
    ids, starts, n = [], [], []
    for t in texts_of:
        words = words_of(t)
        starts.append(len(ids))
        n.append(len(words))
        ids.append(0)
        ids += [rows.setdefault(w, len(rows) + 1) for w in words]
        ids += [0] * (max(WIDTHS) - 1)
    at = buckets.of(rows)
    return np.array(ids, np.int64), np.array(starts, np.int64), at, np.array(n, np.int64)


class Model:
    """Weights, as plain arrays."""

    def __init__(self, table, filters, bias, out, out_bias, language, threshold):
        self.table, self.filters, self.bias, self.out, self.out_bias = table, filters, bias, out, out_bias
        self.language, self.threshold = language, threshold

    def convolve(self, words: np.ndarray, ids: np.ndarray, starts: np.ndarray):
        """Pooled filters of each chunk, with bias and cut at zero; each text's
        first chunk; the chunks' starts; and the filters' values at each word."""
        lengths = np.diff(np.append(starts, len(ids)))
        n = -(-lengths // CHUNK)
        first = np.cumsum(n) - n
        chunks = np.repeat(starts - first * CHUNK, n) + np.arange(n.sum()) * CHUNK
        values = []
        for w, width in enumerate(WIDTHS):
            total = None
            for j in range(width):
                part = (words @ self.filters[w][j])[ids[j : len(ids) - (width - 1) + j]]
                total = part if total is None else total + part
            values.append(np.concatenate([total, np.full((width - 1, FILTERS), -9.0, np.float32)]) if width > 1 else total)
        pooled = np.concatenate([np.maximum.reduceat(v, chunks, axis=0) for v in values], 1)
        return np.maximum(pooled + self.bias, 0), first, n, chunks, values

    def hidden(self, pooled, first, n):
        return np.concatenate([np.maximum.reduceat(pooled, first, axis=0), np.add.reduceat(pooled, first, axis=0) / n[:, None].astype(np.float32)], 1)

    def logits(self, texts_of, buckets) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language of each text."""
        ids, starts, at, _ = _flat(texts_of, buckets)
        words = np.concatenate([np.zeros((1, DIM), np.float32), self.table[at].sum(1)])
        h = self.hidden(*self.convolve(words, ids, starts)[:3])
        told = np.concatenate([np.zeros((1, self.language.shape[1]), np.float32), self.language[at[:, 0]]])
        return h @ self.out + self.out_bias, np.add.reduceat(told[ids], starts, axis=0).argmax(1)

    def scores(self, texts_of, buckets) -> np.ndarray:
        logit, language = self.logits(texts_of, buckets)
        z = logit - self.threshold[language] + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def constant(n1: int, n0: int) -> Model:
    """Without both classes, one score for all: high where all labels are toxic, else low."""
    k = FILTERS * len(WIDTHS)
    filters = [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS]
    return Model(np.zeros((len(PARTS) << BITS, DIM), np.float32), filters, np.zeros(k, np.float32), np.zeros(2 * k, np.float32), np.float32(3 if n1 and not n0 else -3), np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32))


def fresh(counts: np.ndarray, n1: int, n0: int, seed: int = 11) -> tuple[Model, np.ndarray]:
    """A model that only counts have gone into, and which buckets are known; ``counts`` are those of ``_count``."""
    rng = np.random.default_rng(seed)
    size = len(PARTS) << BITS
    seen, toxic, told = counts[:size], counts[size : 2 * size], counts[2 * size :].reshape(1 << BITS, -1)
    table = (rng.standard_normal((size, DIM)) * 0.05).astype(np.float32)
    told = np.log((told + 0.1) / (told.sum(0) + 0.1 * (1 << BITS))).astype(np.float32)
    known = seen >= LEAST_DOCS
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((seen - toxic + 0.5) / (n0 + 1))
    table[:, 0] = np.clip(odds / 3, -1.2, 1.2)
    table[~known] = 0
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = 0.7 / len(f)
    k = FILTERS * len(WIDTHS)
    return Model(table, filters, np.zeros(k, np.float32), (rng.standard_normal(2 * k) * 0.1 + 0.1).astype(np.float32), np.float32(-1), told, np.zeros(told.shape[1], np.float32)), known


def _sums() -> dict:
    """Adagrad's sums of squares before the first step."""
    return {"table": np.full(len(PARTS) << BITS, 1e-6, np.float32), "bias": 1e-6, "out": 1e-6, "out_bias": 1e-6} | {f"f{w}": 1e-6 for w in range(len(WIDTHS))}


def _learn(m: Model, grad2: dict, known: np.ndarray, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
    """One step on a batch of documents (their words' buckets), labels and weights."""
    table = m.table
    ids, starts, at = _joined(docs)
    words = np.concatenate([np.zeros((1, DIM), np.float32), table[at].sum(1)])
    pooled, first, n, chunks, values = m.convolve(words, ids, starts)
    h = m.hidden(pooled, first, n)
    p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30)))
    g = ((p - y) * weight).astype(np.float32) / len(docs)
    k = FILTERS * len(WIDTHS)
    top = pooled == np.repeat(h[:, :k], n, 0)
    to_chunk = (top * np.repeat(np.outer(g, m.out[:k]), n, 0) + np.repeat(np.outer(g / n, m.out[k:]), n, 0)) * (pooled > 0)
    steps = {"out": h.T @ g + 1e-4 * m.out, "out_bias": g.sum(), "bias": to_chunk.sum(0)}
    ends = np.append(chunks[1:], len(ids))
    touched, change = [], []
    for w, width in enumerate(WIDTHS):
        delta = to_chunk[:, w * FILTERS : (w + 1) * FILTERS].astype(np.float32)
        best = np.stack([values[w][a:b].argmax(0) + a for a, b in zip(chunks, ends)])  # the pooled positions, chunks by filters
        gf = np.zeros_like(m.filters[w])
        for j in range(width):
            r = ids[np.minimum(best + j, len(ids) - 1)]
            gf[j] = np.einsum("bf,bfd->df", delta, words[r])
            live = delta != 0
            touched.append(r[live])
            change.append((delta[:, :, None] * m.filters[w][j].T[None])[live])
        steps[f"f{w}"] = gf
    for name, gr in steps.items():  # Adagrad, one rate an array
        grad2[name] += float(np.mean(np.square(gr)))
        step = RATE * gr / np.sqrt(grad2[name])
        if name[0] == "f":
            m.filters[int(name[1:])] -= step
        else:
            setattr(m, name, (getattr(m, name) - step).astype(np.float32))
    r, change = np.concatenate(touched), np.concatenate(change)
    r, change = r[r > 0] - 1, change[r > 0]
    # Of each word its sums, then each of its buckets; flat indices, which numpy adds fast.
    own = np.flatnonzero(np.bincount(r, minlength=len(at)))
    sq = np.bincount(r, np.square(change).mean(1), len(at))[own].astype(np.float32)
    change = np.stack([np.bincount(r, change[:, d], len(at)) for d in range(DIM)], 1)[own].astype(np.float32)
    cells = at[own].ravel()
    keep = known[cells]
    cells, sq, change = cells[keep].astype(np.int64), np.repeat(sq, len(PARTS))[keep], np.repeat(change, len(PARTS), 0)[keep]
    np.add.at(grad2["table"], cells, sq)
    step = (-RATE * change / np.sqrt(grad2["table"][cells])[:, None]).astype(np.float32)
    np.add.at(table.reshape(-1), (cells[:, None] * DIM + np.arange(DIM)).ravel(), step.ravel())


def _kept(m: Model, known: np.ndarray) -> dict:
    """The model's arrays; rows of unknown buckets, which are zero, are left out."""
    return vars(m) | {"table": m.table[known], "known": np.packbits(known)}


def _restored(kept: dict) -> tuple[Model, np.ndarray]:
    kept = dict(kept)
    known = np.unpackbits(kept.pop("known"), count=len(PARTS) << BITS).astype(bool)
    table = np.zeros((len(known), DIM), np.float32)
    table[known] = kept["table"]
    return Model(**kept | {"table": table, "filters": [f.copy() for f in kept["filters"]]}), known


def _learnt(m: Model, known: np.ndarray) -> list[np.ndarray]:
    """What steps change, in a fixed order."""
    return [m.table[known], *m.filters, m.bias, m.out, np.atleast_1d(m.out_bias)]


def _joined(docs):
    """``_flat`` for texts whose buckets are known."""
    at = np.concatenate(docs) if docs else np.zeros((0, len(PARTS)), np.int32)
    ids, starts, row = [], [], 1
    n = 0
    for d in docs:
        starts.append(n)
        ids += [np.zeros(1, np.int64), np.arange(row, row + len(d)), np.zeros(max(WIDTHS) - 1, np.int64)]
        row += len(d)
        n += len(d) + max(WIDTHS)
    return np.concatenate(ids), np.array(starts), at


def _threshold(logit: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """Of logits, how many documents have each and how many of those are toxic: the one with the best F1; of the gap between its neighbours, the middle."""
    order = np.argsort(-logit, kind="stable")
    z, found = logit[order], np.cumsum(hits[order])
    best = int((2 * found / (np.cumsum(n[order]) + hits.sum())).argmax())
    return float((z[best] + (z[best + 1] if best + 1 < len(z) else z[best] - 2)) / 2)


def labelled(docs: DataFrame, labels: DataFrame, allowed, target: str, bound: int, *more: str) -> DataFrame:
    """(doc_id, text, y, *more) of at most ``bound`` labelled rows of each class, the
    same for any partitioning: the first by a hash of the id."""
    own = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    own = own.filter(allowed).withColumn("nth", F.xxhash64(F.col("doc_id")))
    picked = None
    for label in (0, 1):  # two small top-k lists; no window over all labels
        part = own.filter(F.col("y") == label).orderBy("nth", "doc_id").limit(bound)
        picked = part if picked is None else picked.unionByName(part)
    picked = F.broadcast(picked.select("doc_id", "y"))  # 2 * bound rows at most
    columns = [c for c in more if c in docs.columns]
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *columns).join(picked, "doc_id").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("nth = 1")
    return found.select("doc_id", "text", "y", *(c if c in columns else F.lit(None).cast("string").alias(c) for c in more))


def _squeezed(batches):
    """Rows whose text, the first column, becomes compressed bytes: they're shuffled and kept."""
    for batch in batches:
        data = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in strings(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *batch.columns[1:]], names=["squeezed", *batch.schema.names[1:]])


def _text(squeezed: bytes) -> str:
    return zlib.decompress(squeezed).decode("utf-8", "surrogatepass")


def _words(squeezed: bytes, buckets) -> np.ndarray:
    return buckets.of(words_of(_text(squeezed)))


def every_labelled(docs: DataFrame, labels: DataFrame, allowed) -> DataFrame:
    """(doc_id, squeezed, y, lang, back) of every labelled document, once; ``back``: a fifth, by a hash, held back for the thresholds."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).filter("y in (0, 1)").filter(allowed)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    plain = docs.filter("doc_id is not null").select("text", "doc_id", lang.alias("lang"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    squeezed = plain.mapInArrow(_squeezed, f"squeezed binary, doc_id {kind}, lang string").join(own, "doc_id")
    first = squeezed.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("squeezed", "lang"))).filter("nth = 1")
    return first.select("doc_id", "squeezed", "y", "lang", (F.pmod(F.xxhash64("doc_id", F.lit("back")), F.lit(5)) == 0).alias("back"))


def _count(batches, languages):
    """Over (squeezed, y, lang) rows: documents that have a bucket, toxic ones of them, and words of each bucket by language."""
    buckets, size, of = _Buckets(), len(PARTS) << BITS, {k: i for i, k in enumerate(languages)}
    counts, told = np.zeros(2 * size, np.int64), np.zeros((len(languages), 1 << BITS), np.int64)
    for batch in batches:
        for squeezed, y, lang in zip(*(strings(c) for c in batch.columns)):
            at = _words(squeezed, buckets)
            u = np.unique(at)
            counts[u] += 1
            counts[size + u] += y
            np.add.at(told[of.get(lang, len(of) - 1)], at[:, 0], 1)
    yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64()), "data": pa.array([np.append(counts, told.T.ravel()).tobytes()], pa.binary())})


def _added(batches, kind):
    """The sum of rows of arrays, and of their numbers of documents; a mean's arrays come weighted."""
    n, total = 0, None
    for batch in batches:
        for k, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist()):
            x = np.frombuffer(data, kind)
            n, total = n + k, x.copy() if total is None else np.add(total, x, out=total)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})


def _over_all(parts: DataFrame, kind, width: int):
    """Rows (n, data) added up in ``width`` tasks and then in one: one row."""
    add = lambda it: _added(it, kind)
    return parts.repartition(width).mapInArrow(add, "n long, data binary").repartition(1).mapInArrow(add, "n long, data binary").first()


def _warm(batches, shared):
    """The model after the warm-up on a task's (doc_id, squeezed, y) rows, in the order of ids, and Adagrad's sums; pickled."""
    s = shared.value
    rows = sorted((r for b in batches for r in zip(*(strings(c) for c in b.columns))), key=lambda r: r[0])
    m, known = fresh(np.frombuffer(s["counts"], np.int64), s["n1"], s["n0"])
    buckets, grad2, rng = _Buckets(), _sums(), np.random.default_rng(12)
    docs, y = [_words(r[1], buckets) for r in rows], np.array([r[2] for r in rows], np.float32)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(STEPS):
        pick = np.concatenate([rng.choice(pos, BATCH // 2), rng.choice(neg, BATCH // 2)])
        _learn(m, grad2, known, [docs[i] for i in pick], y[pick], np.float32(1))
    grad2["table"] = grad2["table"][known]
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps((_kept(m, known), grad2))], pa.binary())})


def _fit(rows: pa.Table, shared) -> pa.Table:
    """One pass over a shard's documents, each once, classes of equal weight in all: the learnt arrays times the number of documents."""
    kept, grad2, weight = shared.value
    (m, known), grad2 = _restored(kept), dict(grad2)
    table = np.full(len(known), 1e-6, np.float32)
    table[known] = grad2["table"]
    grad2["table"], buckets = table, _Buckets()
    rows = rows.sort_by([("nth", "ascending"), ("doc_id", "ascending")])
    docs, y = [], []
    for k, (squeezed, label) in enumerate(zip(strings(rows["squeezed"]), strings(rows["y"]))):
        docs.append(_words(squeezed, buckets))
        y.append(label)
        if len(docs) == BATCH or sum(map(len, docs)) >= BATCH_WORDS or k + 1 == len(rows):
            _learn(m, grad2, known, docs, np.array(y, np.float32), np.where(np.array(y) == 1, *weight).astype(np.float32))
            docs, y = [], []
    flat = np.concatenate([x.ravel() for x in _learnt(m, known)]).astype(np.float32) * np.float32(len(rows))
    return pa.table({"n": pa.array([len(rows)], pa.int64()), "data": pa.array([flat.tobytes()], pa.binary())})


def _cells(batches, shared):
    """Of (squeezed, y) rows: language by guess, the logit's cell, y."""
    m = _restored(shared.value)[0]
    buckets = worker_cache("toxicity", _Buckets)
    for batch in batches:
        for a in range(0, len(batch), BLOCK):
            part = batch.slice(a, BLOCK)
            logit, language = m.logits([_text(x) for x in part.column(0).to_pylist()], buckets)
            cell = np.floor(np.clip(logit, -500, 500) * CELLS).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"language": pa.array(language, pa.int64()), "cell": pa.array(cell, pa.int64()), "y": part.column(1)})


def train(rows: DataFrame) -> dict:
    """The model's arrays, learnt from all of ``rows`` (those of ``every_labelled``, written): counts, warm-up, a pass over all that aren't held back, thresholds."""
    spark = rows.sparkSession
    n = {(r.y, r.back): r.n for r in rows.groupBy("y", "back").agg(F.count("*").alias("n")).collect()}
    n1, n0 = (n.get((y, False), 0) + n.get((y, True), 0) for y in (1, 0))
    if not n1 or not n0:
        return _kept(constant(n1, n0), np.zeros(len(PARTS) << BITS, bool))
    fit = rows.filter("not back") if n.get((1, False)) and n.get((0, False)) else rows
    held = rows.filter("back") if n.get((1, True)) and n.get((0, True)) else rows
    f1, f0 = ((n[1, False], n[0, False]) if fit is not rows else (n1, n0))
    by = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    often = by.filter((F.col("hits") >= LEAST_BY_LANGUAGE) & (F.col("n") - F.col("hits") >= LEAST_BY_LANGUAGE)).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in often)
    if sum(r.n for r in often) < n1 + n0:
        languages.append(None)  # the rest
    width = 8
    counts = _over_all(rows.select("squeezed", "y", "lang").mapInArrow(lambda it: _count(it, languages), "n long, data binary"), np.int64, width)
    shared = spark.sparkContext.broadcast({"counts": bytes(counts.data), "n1": n1, "n0": n0})
    nth = F.xxhash64("doc_id")
    few = [fit.filter(F.col("y") == y).orderBy(nth, "doc_id").limit(TRAIN_DOCS) for y in (0, 1)]
    warm = few[0].unionByName(few[1]).select("doc_id", "squeezed", "y").repartition(1).mapInArrow(lambda it: _warm(it, shared), "model binary").first()
    kept, grad2 = pickle.loads(warm.model)
    shared.destroy()
    tasks = -(-(f1 + f0) // TASK_DOCS)
    # Weights of a toxic document and of another: halves of the total to each class, 1 on average.
    shared = spark.sparkContext.broadcast((kept, grad2, ((f1 + f0) / (2 * f1), (f1 + f0) / (2 * f0))))
    dealt = fit.select("doc_id", "squeezed", "y", nth.alias("nth"), F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(tasks)).alias("shard"))
    learnt = _over_all(dealt.groupBy("shard").applyInArrow(lambda t: _fit(t, shared), "n long, data binary"), np.float32, max(width, round(tasks**0.5)))
    shared.destroy()
    flat, at = np.frombuffer(learnt.data, np.float32) / np.float32(learnt.n), 0
    k = 1 + len(WIDTHS)
    arrays = []
    for x in (kept["table"], *kept["filters"], kept["bias"], kept["out"], np.zeros(1)):
        arrays.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    kept |= {"table": arrays[0], "filters": arrays[1:k], "bias": arrays[k], "out": arrays[k + 1], "out_bias": arrays[k + 2][0]}
    shared = spark.sparkContext.broadcast(kept)
    cells = held.select("squeezed", "y").mapInArrow(lambda it: _cells(it, shared), "language long, cell long, y int")
    cells = np.array([(r.language, r.cell, r.n, r.hits) for r in cells.groupBy("language", "cell").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).collect()], np.int64).T
    shared.destroy()
    best = lambda c: _threshold((c[1] + 0.5) / CELLS, c[2], c[3])
    cell, place = np.unique(cells[1], return_inverse=True)
    kept["threshold"] = np.full(len(languages), best((None, cell, np.bincount(place, cells[2]), np.bincount(place, cells[3]))), np.float32)
    for i in range(len(languages)):
        own = cells[:, cells[0] == i]
        if min(own[3].sum(), own[2].sum() - own[3].sum()) >= LEAST_BY_LANGUAGE:
            kept["threshold"][i] = best(own)
    return kept


def _blocks(column):
    """The column's texts in blocks of bounded rows and bytes (a longer text is a block)."""
    block, size = [], 0
    for text in strings(column):
        text = text or ""
        block.append(text)
        size += len(text)
        if len(block) >= BLOCK or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _score(batches, model):
    """The batches with a last column of scores; ``text`` is the first one."""
    m = _restored(model.value)[0]
    buckets = worker_cache("toxicity", _Buckets)
    for batch in batches:
        scores = [m.scores(part, buckets) for part in _blocks(batch.column(0))]
        scores = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=[*batch.schema.names[1:], "toxicity_score"])


def with_score(docs: DataFrame, labels: DataFrame, allowed, text: str = "text") -> DataFrame:
    """Every row of ``docs``, all columns as they are, with ``toxicity_score`` (0 to 1; toxic from ``THRESHOLD``).

    ``allowed``: a condition on doc_id, which labelled rows may be learnt from.
    The ``lang`` of those rows, where there is one, names the languages whose
    thresholds are calibrated; of a scored row only the text is read.  Null and
    empty texts get the score of a text without words; repeated rows and ties
    are scored alike; a text of any length is read whole; without usable labels
    all scores are low; an empty table gives no rows; a column of the name
    ``toxicity_score`` is replaced, others are kept.
    """
    docs = docs.drop("toxicity_score")
    # Tasks train; the driver gets sums and weights, a few MB, whatever the number of labels.
    model = docs.sparkSession.sparkContext.broadcast(train(saved(every_labelled(docs, labels, allowed))))
    fields = StructType([*docs.schema.fields, StructField("toxicity_score", DoubleType())])
    return docs.select(F.col(text).alias(free_name(docs, "text to score")), "*").mapInArrow(lambda it: _score(it, model), fields)


def score(docs: DataFrame, labels: DataFrame, allowed) -> DataFrame:
    """doc_id and score of every row (see ``with_score``)."""
    columns = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    return with_score(docs.select(*columns), labels, allowed).select("doc_id", F.col("toxicity_score").alias("score"))
