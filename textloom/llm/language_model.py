"""Gated recurrent language model in numpy, scoring whole documents.

Tokens are lower-cased words and one end.  Words fall into groups by their
character trigrams (groups found by clustering all training documents, so
about one a language or source) and into classes of group and frequency.  The
numbers of groups and of learnt words grow with the corpus' vocabulary.  The softmax is factored:
first the class; in the most frequent words' classes then a learnt
softmax, in the others the words' share of the class by corpus count, with a
half for each word and for the unknown one.  So every text has a probability.

The recurrent weights start on the driver from a bounded warm-up sample and
are then trained on every training document: each task runs truncated
backpropagation over its documents, with the state carried from window to
window, and the tasks' weights are averaged by tokens.  Scoring carries the
state over a whole document, many documents side by side.

Counts cover all training documents.  The ``HEAD`` most frequent words are
broadcast; a document's rarer words travel as (row, word, n) and join their
counts by key.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, reached, saved, slices, strings, texts, worker_cache

#: Broadcast words; words with their own output weights and groups, at least (see ``model_sizes``); words of a learnt class.
HEAD, LEARNED, PER_CLASS = 200_000, 2_048, 64
HIDDEN, GROUPS, TRIGRAM_BITS = 32, 8, 13
TRIGRAMS = 1 << TRIGRAM_BITS
#: Seeds and passes of the clustering, for each group and over all training documents; words that it sees; parts its sums come in.
SEEDS, PASSES, SEEN, SUMS = 64, 2, 2_048, 8
#: Warm-up documents (at most) and passes; windows, lanes and rate of training.
WARM_DOCS, WARM_PASSES, WINDOW, LANES, RATE = 600, 4, 32, 64, 0.1
#: Documents scored side by side, steps scored at once, states whose softmax is taken at once; tasks' weights are summed in so many parts.
SIDE, SPAN, ROWS, PARTS = 1_024, 32, 4_096, 32
#: Documents and tokens that a task trains on at once.
TRAINED, TRAINED_TOKENS = 16_384, 6_000_000
#: Logits whose exponentials, and the sums of these, are surely normal numbers of 32 bits.
SAFE = 60
END = b" end"  # no word holds a space


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _counts(batches):
    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())})

    for batch in batches:
        for text in strings(batch.column(0)):
            counts.update(words_of(text))
            counts[END] += 1
            if len(counts) > 400_000:
                yield out()
                counts.clear()
    yield out()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the words, their borders included, one word
    behind another; and the number of each word's."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    if not len(n):
        return np.zeros(0, np.int64), n
    data = np.frombuffer(b"^" + b"$^".join(words) + b"$", np.uint8).astype(np.uint32)
    inside = np.ones(len(data), bool)
    ends = np.cumsum(n + 2)
    inside[ends - 1] = inside[ends - 2] = False
    code = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - TRIGRAM_BITS)
    return code[inside[:-2]].astype(np.int64), n


class Groups:
    """Which group a word is in, by naive Bayes on its trigrams."""

    def __init__(self, table: np.ndarray):
        self.table = table.astype(np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        """The words' groups; long ones by their counts, in bounded memory."""
        out, part, size = np.zeros(len(words), np.int64), [], 0
        for i, w in enumerate(words):
            if len(w) > 2_000:
                out[i] = (np.bincount(trigrams([w])[0], minlength=TRIGRAMS) @ self.table).argmax()
                continue
            part.append(i)
            size += len(w)
            if size > 100_000:
                out[part] = self._of([words[k] for k in part])
                part, size = [], 0
        if part:
            out[part] = self._of([words[k] for k in part])
        return out

    def _of(self, words: list[bytes]) -> np.ndarray:
        at, n = trigrams(words)
        return np.add.reduceat(self.table[at], np.cumsum(n) - n, axis=0).argmax(1)


def model_sizes(n_words: int) -> tuple[int, int]:
    """Learnt words and groups for a vocabulary of ``n_words``."""
    learnt = max(LEARNED, math.ceil(2 * math.sqrt(n_words)))
    return min(HEAD, -(-learnt // PER_CLASS) * PER_CLASS), max(GROUPS, round(n_words**0.2))


def _weights(n: np.ndarray) -> np.ndarray:
    """Roots of the counts, as a vector of length 1."""
    return np.sqrt(n / max(1e-9, float(n.sum())))


def _assigned(batches, centre):
    """Sums of the documents' vectors by nearest centre."""
    total, columns = np.zeros(centre.shape), np.ascontiguousarray(centre.T)
    for batch in batches:
        for at, n in zip(batch.column("seen").to_pylist(), batch.column("n").to_pylist()):
            at, v = np.frombuffer(at, np.uint16), _weights(np.frombuffer(n, np.float32))
            if len(at):
                total[int((v @ columns[at]).argmax()), at] += v
    yield _sums(total)


def _trigram_sums(batches, shared, centre):
    """Trigrams of every word of the documents, by the documents' nearest centre."""
    words = list(_head(shared.value))
    total, columns = np.zeros((TRIGRAMS, len(centre))), np.ascontiguousarray(centre.T)
    heads, rest, held = np.zeros((len(centre), len(words))), [([], []) for _ in centre], 0

    def add(k, own, times):
        for a in range(0, len(own), 20_000):
            at, n = trigrams(own[a : a + 20_000])
            total[:, k] += np.bincount(at, np.repeat(np.asarray(times[a : a + 20_000], float), n), TRIGRAMS)

    for batch in slices(batches):
        for r in batch.to_pylist():
            seen = np.frombuffer(r["seen"], np.uint16)
            k = int((_weights(np.frombuffer(r["n"], np.float32)) @ columns[seen]).argmax()) if len(seen) else 0
            at = np.frombuffer(r["at"], "<i4")
            np.add.at(heads[k], at[at >= 0], 1.0)
            rest[k][0].extend(x["word"] for x in r["rest"] if x["word"] != END)
            rest[k][1].extend(x["k"] for x in r["rest"] if x["word"] != END)
            held += len(r["rest"])
        if held > 100_000:
            for k, own in enumerate(rest):
                add(k, *own)
            rest, held = [([], []) for _ in centre], 0
    for k, own in enumerate(rest):
        add(k, *own)
        some = np.array([i for i in np.flatnonzero(heads[k]).tolist() if words[i] != END], np.int64)
        add(k, [words[i] for i in some.tolist()], heads[k][some])
    yield _sums(total)


def _sums(total: np.ndarray):
    data = total.tobytes()
    return pa.RecordBatch.from_pydict({"part": pa.array([zlib.crc32(data) % SUMS], pa.int32()), "data": pa.array([data], pa.binary())})


def _added(batches):
    total = None
    for batch in batches:
        for data in batch.column("data").to_pylist():
            x = np.frombuffer(data)
            total = x.copy() if total is None else np.add(total, x, out=total)
    if total is not None:
        yield pa.RecordBatch.from_pydict({"data": pa.array([total.tobytes()], pa.binary())})


def _over_all(rows: DataFrame, task, shape: tuple) -> np.ndarray:
    """The sum of the tasks' arrays, added up in ``SUMS`` parts and then in one task; one array reaches the driver."""
    tasks = rows.mapInArrow(task, "part int, data binary").repartition(SUMS, "part").mapInArrow(_added, "data binary")
    return sum((np.frombuffer(r.data).reshape(shape) for r in tasks.repartition(1).mapInArrow(_added, "data binary").collect()), np.zeros(shape))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def trigram_counts(training: DataFrame, words: list[tuple[bytes, int]], n_groups: int) -> np.ndarray:
    """How often each trigram stands in the documents of each group, over all training documents.

    Seeds are drawn from all of them, then k-means passes over all of them
    find the groups.  ``training`` has texts, or what ``_encode`` made of them.
    """
    encoder = head_of(training.sparkSession, words)
    vectors = training if "at" in training.columns else saved(training.select("text").mapInArrow(lambda it: _encode(it, encoder), _ENCODED))
    n_seen = int(encoder.value["seen"].max(initial=-1)) + 1
    # Only draws that can be among the best come to the driver: about as many as there are seeds.
    drawn = vectors.filter("draw is not null").withColumn("draw", 1 / (1e-12 - F.col("draw")))
    drawn = drawn.filter(F.col("draw") >= reached(drawn, SEEDS * n_groups, "draw")).select("draw", "seen", "n").orderBy(F.desc("draw"), "seen", "n").limit(SEEDS * n_groups).collect()
    x = np.zeros((max(1, len(drawn)), max(1, n_seen)))
    for own, r in zip(x, drawn):
        own[np.frombuffer(r.seen, np.uint16)] = _weights(np.frombuffer(r.n, np.float32))
    # Each further centre is the seed least like the centres before it.
    centre = x[:1]
    while len(centre) < min(n_groups, len(x)):
        centre = np.vstack([centre, x[(x @ centre.T).max(1).argmin()]])
    for _ in range(12):
        own = (x @ centre.T).argmax(1)
        centre = _unit(np.array([x[own == k].sum(0) if (own == k).any() else c for k, c in enumerate(centre)]))
    for _ in range(PASSES if drawn else 0):
        now = centre
        total = _over_all(vectors.select("seen", "n"), lambda it: _assigned(it, now), centre.shape)
        centre = np.where(total.any(1)[:, None], _unit(total), centre)
    out = np.zeros((TRIGRAMS, n_groups))
    out[:, : len(centre)] = _over_all(vectors.select("seen", "n", "at", "rest"), lambda it: _trigram_sums(it, encoder, centre), (TRIGRAMS, len(centre)))
    return out


class Symbols:
    """Classes, and the symbols that the network reads: learnt words, then one a counted class.

    ``words``, ``symbol`` and ``log``: the broadcast words, their symbols and
    log10(count + 0.5); learnt words have their symbols by class, ``PER_CLASS``
    to each.
    """

    def __init__(self, words: list[tuple[bytes, int]], groups: Groups, most: int = LEARNED):
        n_groups = groups.table.shape[1]
        self.words = [w for w, _ in words]
        group = groups.of(self.words)
        learnt = sorted(range(min(most, len(words))), key=lambda i: (group[i], -words[i][1], words[i][0]))
        self.n_learnt_classes = max(1, -(-len(learnt) // PER_CLASS))
        self.n_learnt = self.n_learnt_classes * PER_CLASS
        self.n_classes = self.n_learnt_classes + 3 * n_groups
        self.size = self.n_learnt + 3 * n_groups
        half = most + (len(words) - most) // 8
        self.symbol = self.n_learnt + 3 * group + (np.arange(len(words)) >= half)
        self.symbol[learnt] = np.arange(len(learnt))
        self.log = np.log10(np.array([n for _, n in words], float) + 0.5)
        self.end = int(self.symbol[self.words.index(END)]) if END in self.words[:most] else 0


def _squashed(x: np.ndarray, steep: float) -> None:
    """The logistic function of ``steep`` * ``x``, in place; exponentials are fast in numpy where hyperbolic tangents are not."""
    x *= -steep
    np.exp(x, out=x)  # infinity gives 0; ``train`` and ``score`` keep numpy from warning
    x += 1
    np.reciprocal(x, out=x)


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order of small whole numbers of 0 or more; those of 16 bits are sorted by digits."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


def _summed_by(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sum of each one's rows: neighbours of a key are added in pairs, then what is left of them."""
    order = _order(key)
    key, rows = key[order], rows[order]
    while True:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        if len(first) == len(key):
            return key, rows
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        even = np.flatnonzero(place % 2 == 0)
        odd = np.flatnonzero(place % 2)
        rows[odd - 1] += rows[odd]
        key, rows = key[even], rows[even]


class Network:
    """Weights by name; gates are update, reset and candidate."""

    def __init__(self, weights: dict[str, np.ndarray], n_learnt: int, end: int):
        self.w, self.n_learnt, self.end = weights, n_learnt, end
        self.n_learnt_classes = n_learnt // PER_CLASS

    @staticmethod
    def new(symbols: Symbols, used: np.ndarray, seed: int = 4) -> Network:
        """``used``: frequencies of symbols and of classes, for the biases."""
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        by_symbol = np.log(used[: symbols.n_learnt] + 0.5).astype(np.float32)
        by_class = np.append(used[: symbols.n_learnt].reshape(-1, PER_CLASS).sum(1), used[symbols.n_learnt :])
        weights = {
            "input": r(symbols.size, 3 * HIDDEN) * 2,
            "gates": r(HIDDEN, 2 * HIDDEN),
            "candidate": r(HIDDEN, HIDDEN),
            "class": r(HIDDEN, symbols.n_classes),
            "class_bias": np.log(by_class + 0.5).astype(np.float32),
            "word": r(symbols.n_learnt_classes, HIDDEN, PER_CLASS),
            "word_bias": by_symbol.reshape(-1, PER_CLASS),
        }
        weights["input"][:, :HIDDEN] -= 1.0
        return Network(weights, symbols.n_learnt, symbols.end)

    def step(self, u: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gates, candidate and next state from the input's rows and the state."""
        g = h @ self.w["gates"]
        g += u[:, : 2 * HIDDEN]
        _squashed(g, 1)
        c = (g[:, HIDDEN:] * h) @ self.w["candidate"]
        c += u[:, 2 * HIDDEN :]
        _squashed(c, 2)
        c *= 2  # a hyperbolic tangent
        c -= 1
        new = c - h
        new *= g[:, :HIDDEN]
        new += h
        return g, c, new

    def classes(self, y: np.ndarray) -> np.ndarray:
        return np.where(y < self.n_learnt, y // PER_CLASS, y - self.n_learnt + self.n_learnt_classes)

    @staticmethod
    def _softmax(logit: np.ndarray, k: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of column ``k`` of each row; ``logit`` becomes the exponentials, whose sums are returned too.  ``safe``: none of them can leave its type's range."""
        if not safe:
            logit -= logit.max(1, keepdims=True)
        own = logit[np.arange(len(k)), k]
        np.exp(logit, out=logit)
        total = logit @ np.ones(logit.shape[1], logit.dtype)
        return own - np.log(total), total

    def safe(self, most: float = 1.0) -> tuple[bool, bool]:
        """Whether logits of classes and of words stay within ``SAFE`` for states of at most ``most``."""
        bound = lambda w, b: most * float(np.abs(w).sum(-2).max(initial=0)) + float(np.abs(b).max(initial=0)) < SAFE
        return bound(self.w["class"], self.w["class_bias"]), bound(self.w["word"], self.w["word_bias"])

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None, safe: tuple[bool, bool] = (False, False)):
        """Natural-log probabilities of the symbols ``y`` after states ``h``;
        with ``grads``, fills them and returns the states' gradient.  ``safe``: see there."""
        k = self.classes(y)
        logit = h @ self.w["class"]
        logit += self.w["class_bias"]
        out, total = self._softmax(logit, k, safe[0])
        if grads is not None:
            logit *= (weight / total)[:, None]
            logit[np.arange(len(y)), k] -= weight
            grads["class"], grads["class_bias"] = h.T @ logit, logit.sum(0)
            back = logit @ self.w["class"].T
            grads["word"], grads["word_bias"] = np.zeros_like(self.w["word"]), np.zeros_like(self.w["word_bias"])
        rows = np.flatnonzero(y < self.n_learnt)
        if len(rows):
            rows = rows[_order(k[rows])]
            kinds, first = np.unique(k[rows], return_index=True)
            last = [*first[1:], len(rows)]
            own, pos = h[rows], y[rows] % PER_CLASS
            logit = np.empty((len(rows), PER_CLASS), h.dtype)
            for c, a, b in zip(kinds, first, last):
                np.matmul(own[a:b], self.w["word"][c], out=logit[a:b])
                logit[a:b] += self.w["word_bias"][c]
            logp, total = self._softmax(logit, pos, safe[1])
            out[rows] += logp
            if grads is not None:
                w = weight[rows]
                logit *= (w / total)[:, None]
                logit[np.arange(len(rows)), pos] -= w
                add = np.empty_like(own)
                for c, a, b in zip(kinds, first, last):
                    grads["word_bias"][c] = np.ones(b - a, logit.dtype) @ logit[a:b]
                    np.matmul(own[a:b].T, logit[a:b], out=grads["word"][c])
                    np.matmul(logit[a:b], self.w["word"][c].T, out=add[a:b])
                back[rows] += add
        return out if grads is None else (out, back)

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict, float, int]:
        """Truncated backpropagation over one window of steps by lanes: the
        state after it, the gradients of the mean loss, the sum of
        log-probabilities and the number of symbols (``y`` of 0 or more)."""
        n_steps, n = x.shape
        u = self.w["input"][x]
        # A document's first input is the end, which starts from a state of zero.
        going = (x != self.end).astype(u.dtype)[:, :, None]
        before, states, c = (np.empty((n_steps, n, HIDDEN), u.dtype) for _ in range(3))
        gates = np.empty((n_steps, n, 2 * HIDDEN), u.dtype)
        for t in range(n_steps):
            np.multiply(h, going[t], out=before[t])
            gates[t], c[t], h = self.step(u[t], before[t])
            states[t] = h
        flat = y.ravel()
        live = flat >= 0
        alive = int(live.sum())
        grads: dict = {}
        states = states.reshape(-1, HIDDEN)
        logp, back = self.log_probs(states, np.maximum(flat, 0), grads, (live / max(1, alive)).astype(u.dtype), self.safe(float(np.abs(states).max(initial=0))))
        back = back.reshape(c.shape)
        z, r = gates[:, :, :HIDDEN], gates[:, :, HIDDEN:]
        by_c, by_z, by_r, rest = z * (1 - c * c), (c - before) * z * (1 - z), before * r * (1 - r), 1 - z
        d_in, d_h = np.empty_like(u), np.zeros_like(h)
        from_gates, from_c = np.ascontiguousarray(self.w["gates"].T), np.ascontiguousarray(self.w["candidate"].T)
        for t in range(n_steps - 1, -1, -1):
            d_h += back[t]
            d = d_in[t]
            np.multiply(d_h, by_c[t], out=d[:, 2 * HIDDEN :])
            d_rh = d[:, 2 * HIDDEN :] @ from_c
            np.multiply(d_h, by_z[t], out=d[:, :HIDDEN])
            np.multiply(d_rh, by_r[t], out=d[:, HIDDEN : 2 * HIDDEN])
            d_h *= rest[t]
            d_rh *= r[t]
            d_h += d_rh
            d_h += d[:, : 2 * HIDDEN] @ from_gates
            d_h *= going[t]
        d_in = d_in.reshape(-1, 3 * HIDDEN)
        grads["gates"] = before.reshape(-1, HIDDEN).T @ d_in[:, : 2 * HIDDEN]
        grads["candidate"] = (r * before).reshape(-1, HIDDEN).T @ d_in[:, 2 * HIDDEN :]
        grads["input"] = _summed_by(x.ravel(), d_in)
        return h, grads, float(logp[live].sum()), alive

    def train(self, docs: list[np.ndarray], rate: float, sums: dict, lanes: int = LANES) -> float:
        """One pass of truncated backpropagation; documents stand one behind
        another in lanes, and the state is carried from window to window over
        whole documents; only the gradient ends with the window.  Returns the mean log-probability of a symbol."""
        docs = sorted(docs, key=len)
        own: list[list] = [[] for _ in range(min(lanes, len(docs)))]
        load = np.zeros(len(own), np.int64)
        for d in reversed(docs):
            k = int(load.argmin())
            own[k].append(d)
            load[k] += len(d)
        longest = np.argsort(-load, kind="stable")  # full lanes stand first, those that end fall away
        load = load[longest]
        targets = [np.concatenate(own[k]) for k in longest]
        inputs = [np.concatenate([part for d in own[k] for part in ([self.end], d[:-1])]).astype(d.dtype) for k in longest]
        h = np.zeros((len(own), HIDDEN), self.w["gates"].dtype)
        seen, gained = 0, 0.0
        for a in range(0, int(load.max(initial=0)), WINDOW):
            n = int((load > a).sum())
            steps = min(WINDOW, int(load[0]) - a)
            x, y = np.full((n, steps), self.end, np.int64), np.full((n, steps), -1, np.int64)
            for k in range(n):
                part = targets[k][a : a + steps]
                y[k, : len(part)] = part
                x[k, : len(part)] = inputs[k][a : a + steps]
            with np.errstate(over="ignore"):
                h, grads, logp, alive = self.window(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), h[:n])
            seen, gained = seen + alive, gained + logp
            for name, g in grads.items():
                at, g = g if name == "input" else (slice(None), g)
                self._move(name, at, g, rate, sums)
        return gained / max(1, seen)

    def _move(self, name, at, g, rate, sums) -> None:
        """Adagrad."""
        if name not in sums:
            sums[name] = np.full_like(self.w[name], 1e-6)
        s, w = sums[name], self.w[name]
        np.clip(g, -0.05, 0.05, out=g)
        s[at] += g * g
        g *= rate
        g /= np.sqrt(s[at])
        w[at] -= g

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural-log probability of each symbol sequence, state carried
        throughout; ``SPAN`` steps of ``SIDE`` sequences are held at once."""
        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        for a in range(0, len(order), SIDE):
            rows = np.array(order[a : a + SIDE])
            lengths = np.array([len(docs[i]) for i in rows])
            h = np.zeros((len(rows), HIDDEN), self.w["gates"].dtype)
            x = np.full(len(rows), self.end, np.int64)
            for b in range(0, int(lengths[0]), SPAN):
                n = int(np.searchsorted(-lengths, -b, side="left"))  # sequences longer than b stand first
                y = np.full((n, min(SPAN, int(lengths[0]) - b)), self.end, np.int64)
                for k in range(n):
                    part = docs[rows[k]][b : b + SPAN]
                    y[k, : len(part)] = part
                states, ys, who = [], [], []
                for t in range(y.shape[1]):
                    n = int(np.searchsorted(-lengths, -(b + t), side="left"))
                    with np.errstate(over="ignore"):
                        h = self.step(self.w["input"][x[:n]], h[:n])[2]
                    states.append(h)
                    ys.append(y[:n, t])
                    who.append(np.arange(n))
                    x = y[:n, t]
                states, ys = np.concatenate(states), np.concatenate(ys)
                logp = np.concatenate([self.log_probs(states[c : c + ROWS], ys[c : c + ROWS]) for c in range(0, len(ys), ROWS)])
                out[rows] += np.bincount(np.concatenate(who), weights=logp, minlength=len(rows))
        return out


def head_of(spark, words: list[tuple[bytes, int]]):
    """The broadcast words: their log10(count + 0.5), which of them the clustering sees, and its mean."""
    seen = np.array([w != END for w, _ in words], bool)
    seen = np.where(seen & (np.cumsum(seen) <= SEEN), np.cumsum(seen) - 1, -1)
    mean = np.sqrt(np.array([n for (_, n), k in zip(words, seen) if k >= 0], float))
    mean /= max(1e-9, np.linalg.norm(mean))
    log = np.log10(np.array([n for _, n in words], float) + 0.5)
    return spark.sparkContext.broadcast({"name": uuid.uuid4().hex, "words": b"\n".join(w for w, _ in words), "log": log, "seen": seen.astype(np.int32), "mean": mean})


def _head(shared: dict) -> dict:
    """The broadcast words and their rows."""
    return worker_cache(("language model", shared["name"]), lambda: {w: i for i, w in enumerate(shared["words"].split(b"\n") if len(shared["log"]) else [])})


#: ``at``: a token's row in the head, or -1 less its word's place in ``rest``; ``seen``, ``n`` and ``draw`` are the clustering's.
_ENCODED = "n_tokens long, n_known long, base double, at binary, rest array<struct<word:binary,k:int>>, seen binary, n binary, draw double"


def _encode(batches, shared):
    """Per row, besides the columns that it has: tokens, head tokens, the sum of their log10 counts, every token, the words
    outside the head, and the document's clustering vector with a draw that prefers documents unlike the corpus' mean."""
    s = shared.value
    rows, logs, seen_of, mean = _head(s), s["log"], s["seen"], s["mean"]
    for batch in slices(batches, 2_048):
        out: dict = {name: [] for name in ("n_tokens", "n_known", "base", "at", "seen", "n", "draw")}
        flat, times, offsets = [], [], [0]
        for text in strings(batch.column("text")):
            words = [*words_of(text), END]
            at = np.fromiter(map(rows.get, words, itertools.repeat(-1)), np.int32, len(words))
            odd = np.flatnonzero(at < 0)
            head = at[at >= 0] if len(odd) else at
            if len(odd):
                rare: dict = {}
                places = np.array([rare.setdefault(words[i], len(rare)) for i in odd.tolist()], np.int32)
                at[odd] = -1 - places
                flat.extend(rare)
                times.append(np.bincount(places))
            offsets.append(len(flat))
            seen = seen_of[head]
            n = np.bincount(seen[seen >= 0])
            seen = np.flatnonzero(n)
            n = n[seen].astype(np.float32)
            data = at.astype("<i4").tobytes()
            u = (zlib.crc32((text or "").encode("utf-8", "surrogatepass")) + 0.5) / 2**32
            out["n_tokens"].append(len(words))
            out["n_known"].append(len(head))
            out["base"].append(float(logs[head].sum()))
            out["at"].append(data)
            out["seen"].append(seen.astype(np.uint16).tobytes())
            out["n"].append(n.tobytes())
            out["draw"].append(math.log(u) / max(1e-3, 1 - float(_weights(n) @ mean[seen])) if len(seen) else None)
        pairs = pa.StructArray.from_arrays([pa.array(flat, pa.binary()), pa.array(np.concatenate(times) if times else [], pa.int32())], ["word", "k"])
        made = {"n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "base": pa.array(out["base"], pa.float64()), "at": pa.array(out["at"], pa.binary()), "rest": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs), "seen": pa.array(out["seen"], pa.binary()), "n": pa.array(out["n"], pa.binary()), "draw": pa.array(out["draw"], pa.float64())}
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in batch.schema.names if k != "text"} | made)


def _counted(words: list[bytes], s: dict) -> np.ndarray:
    """Symbols of words outside the head."""
    return (s["n_learnt"] + 3 * Groups(s["groups"]).of(words) + 2).astype(np.int32)


def _tokens(batches, s: dict):
    """Each document's tokens (``at``) and their symbols; its other words are column ``words``."""
    for batch in slices(batches, 1_024):
        words = batch.column("words")
        rare, begin = _counted(words.flatten().to_pylist(), s), 0
        for data, n in zip(strings(batch.column("at")), words.value_lengths().to_pylist()):
            at = np.frombuffer(data, "<i4")
            yield at, _symbols(at, rare[begin : begin + n], s)
            begin += n


def _symbols(at: np.ndarray, rare: np.ndarray, s: dict) -> np.ndarray:
    """Symbols of tokens; ``rare``: those of the document's words outside the head."""
    odd = np.flatnonzero(at < 0)
    ids = s["symbol"][np.maximum(at, 0)] if len(s["symbol"]) else np.zeros(len(at), np.int32)
    ids[odd] = rare[-1 - at[odd]]
    return ids


def _train_task(batches, shared):
    s = shared.value
    net = Network({k: v.copy() for k, v in s["weights"].items()}, s["n_learnt"], s["end"])
    sums: dict = {k: v.copy() for k, v in s["sums"].items()}
    tokens, held, block = 0, 0, []

    def learn():
        net.train(block, RATE, sums)

    for _, ids in _tokens(batches, s):
        block.append(ids)
        tokens += len(ids)
        held += len(ids)
        if len(block) >= TRAINED or held >= TRAINED_TOKENS:
            learn()
            block, held = [], 0
    if block:
        learn()
    if tokens:
        flat = np.concatenate([net.w[k].ravel() for k in sorted(net.w)]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"part": pa.array([zlib.crc32(str(tokens).encode() + flat[:64].tobytes()) % PARTS], pa.int32()), "tokens": pa.array([tokens], pa.int64()), "weights": pa.array([flat.tobytes()], pa.binary())})


def _summed(batches):
    tokens, flat = 0, None
    for batch in batches:
        for n, w in zip(batch.column("tokens").to_pylist(), batch.column("weights").to_pylist()):
            w = np.frombuffer(w, np.float32) * float(n)
            flat = w.astype(np.float64) if flat is None else np.add(flat, w, out=flat)
            tokens += n
    if flat is not None:
        yield pa.RecordBatch.from_pydict({"tokens": pa.array([tokens], pa.int64()), "weights": pa.array([(flat / tokens).astype(np.float32).tobytes()], pa.binary())})


def _class_sizes(batches, encoder, shared):
    """Words and tokens of each counted class, by task."""
    s, rows = shared.value, _head(encoder.value)
    size = s["size"]
    n_words, n_tokens = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        words = batch.column(0).to_pylist()
        at = np.fromiter(map(rows.get, words, itertools.repeat(-1)), np.int32, len(words))
        odd = np.flatnonzero(at < 0)
        at[odd] = -1 - np.arange(len(odd))
        k = _symbols(at, _counted([words[i] for i in odd.tolist()], s), s)
        n_words += np.bincount(k, minlength=size)
        np.add.at(n_tokens, k, batch.column(1).to_numpy())
    k = np.flatnonzero(n_words[s["n_learnt"] :]) + s["n_learnt"]
    yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "v": pa.array(n_words[k]), "n": pa.array(n_tokens[k])})


def _score_task(batches, shared):
    """(row, model): the model's log10 probability but for words outside the head."""
    s = shared.value
    net = Network(s["weights"], s["n_learnt"], s["end"])
    shift = s["shift"]  # log10 of each counted class' total, by symbol; zero for learnt ones
    # What a head token adds besides the network's share: its share of a counted class.
    share = np.where(s["symbol"] >= s["n_learnt"], s["log"], 0) - shift[s["symbol"]]
    for batch in slices(batches, 1_024):
        ids, rest = [], []
        for at, own in _tokens([batch], s):
            ids.append(own)
            rest.append(share[at[at >= 0]].sum() - shift[own[at < 0]].sum())
        model = np.array(rest) + (net.score(ids) / math.log(10) if ids else 0)
        yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "model": pa.array(model, pa.float64())})


def score(docs: DataFrame, held_out) -> DataFrame:
    """Every document with its whole text's base and model log10 probability.

    ``held_out``: a condition on doc_id, the rows that nothing is learnt from.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score.  A null or empty text is its end alone; repeated rows are each
    scored (and counted); an empty table gives no rows; without training rows
    every word is unknown; other columns are ignored.  Words of equal counts
    stand in the order of their bytes.  A text of any length is learnt from and
    scored whole, some steps at a time; its symbols are one row.
    """
    spark = docs.sparkSession
    plain = texts(docs).withColumn("held_out", held_out)
    training = plain.filter(~F.col("held_out")).select("doc_id", "text")
    vocab = saved(training.select("text").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_words = total
    least = frequent(vocab, HEAD)
    words = sorted(((bytes(r.word), r.n) for r in vocab.filter(F.col("n") >= least).toLocalIterator()), key=lambda x: (-x[1], x[0]))
    # The end belongs to the learnt words whatever its count.
    words.sort(key=lambda x: x[0] != END)
    encoder = head_of(spark, words)
    kind = dict(plain.dtypes)["doc_id"]
    numbered = plain.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
    rows = saved(numbered.mapInArrow(lambda it: _encode(it, encoder), f"row long, doc_id {kind}, held_out boolean, {_ENCODED}"))
    learning = rows.filter("not held_out")
    learnt, n_groups = model_sizes(n_words)
    n = trigram_counts(learning, words, n_groups) + 0.05
    groups = Groups(np.log(n / n.sum(0)))
    symbols = Symbols(words, groups, learnt)
    shared = {"groups": groups.table, "symbol": symbols.symbol.astype(np.int32), "log": symbols.log, "n_learnt": symbols.n_learnt, "size": symbols.size, "end": symbols.end}
    # The warm-up's documents are the first by a hash; only about as many come to the driver.
    n_docs = sum(n for w, n in words if w == END)
    first = -(1 << 63) + (1 << 64) * min(1.0, 1.5 * WARM_DOCS / max(1, n_docs) + 1e-9)
    nth, tokens = F.xxhash64("doc_id"), ("at", F.col("rest.word").alias("words"))
    warm = learning.filter(nth <= int(min(first, (1 << 63) - 1))).withColumn("nth", nth).orderBy("nth", "doc_id").limit(WARM_DOCS).select(*tokens).collect()
    ids = [_symbols(np.frombuffer(r["at"], "<i4"), _counted(list(map(bytes, r.words)), shared), shared) for r in warm]
    used = np.bincount(np.concatenate(ids), minlength=symbols.size) if ids else np.zeros(symbols.size)
    net, sums = Network.new(symbols, used), {}
    for k in range(WARM_PASSES):
        net.train(ids, RATE / (1 + 0.5 * k), sums)
    b = spark.sparkContext.broadcast(shared | {"weights": net.w, "sums": sums})
    parts = learning.select(*tokens).mapInArrow(lambda it: _train_task(it, b), "part int, tokens long, weights binary")
    summed = parts.repartition(PARTS, "part").mapInArrow(_summed, "tokens long, weights binary")
    for r in summed.repartition(1).mapInArrow(_summed, "tokens long, weights binary").collect():  # one row, of PARTS
        flat, at = np.frombuffer(r.weights, np.float32), 0
        for k in sorted(net.w):
            net.w[k] = flat[at : at + net.w[k].size].reshape(net.w[k].shape).copy()
            at += net.w[k].size
    reader = spark.sparkContext.broadcast(shared)
    sizes = vocab.mapInArrow(lambda it: _class_sizes(it, encoder, reader), "k long, v long, n long").groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    shift = np.zeros(symbols.size)
    shift[symbols.n_learnt :] = math.log10(0.5)
    for r in sizes:
        unknown = (r.k - symbols.n_learnt) % 3 == 2
        shift[r.k] = math.log10(r.n + 0.5 * (r.v + unknown))
    scorer = spark.sparkContext.broadcast(shared | {"weights": net.w, "shift": shift})
    scored = rows.select("row", *tokens).mapInArrow(lambda it: _score_task(it, scorer), "row long, model double")
    rare = rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.k")
    counted = rare.join(vocab.filter(F.col("n") < least), "word", "left")
    part = F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    # One shuffle by row brings the model's scores and the rare words to the rows.
    null = {"doc_id": kind, "held_out": "boolean", "n_tokens": "long", "n_known": "long", "base": "double", "model": "double"}
    with_nulls = lambda d: d.select("row", *(F.col(c) if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in null.items()))
    rest = counted.select("row", F.when(F.col("n") > 0, F.col("k")).otherwise(0).cast("long").alias("n_known"), part.alias("base"), part.alias("model"))
    both = with_nulls(rows).unionByName(with_nulls(scored)).unionByName(with_nulls(rest))
    summed = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("model").alias("model"))
    share = math.log10(n_all + 0.5 * (n_words + 1))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * share).alias("base_score"), F.col("model").alias("score"))
