"""Packing by shortest-pack-first over the length histogram.

Each document becomes token ids plus an end id, cut at multiples of
``capacity`` and then at the last multiple of ``grain``, so that the rest
packs with little padding.  Only the histogram of piece lengths (``capacity``
rows) reaches the driver: it places lengths longest first, each into the
shortest packs that have room, as counts of packing patterns.  Pieces are then
ranked within their length, in salted groups, and joined to patterns by rank.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, strings, texts, worker_cache
from .token_counts import PATTERN, load, specials_of, splitter

#: Distinct pre-tokens, and runs, whose ids a worker remembers in a generation; the longest of them.
REMEMBERED, LONGEST = 200_000, 64
#: Pieces per salted group of a length, about.
GROUP = 100_000


def byte_names() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def piece_encoder(tokenizer):
    """A function from a pre-token to its ids.

    Where the vocabulary is plain byte-level BPE whose merges stand in the order
    of their ids, tiktoken's merge loop on the same vocabulary gives the same
    ids in a fifth of the time; else, and for special strings, the library.
    """
    import tiktoken

    slow = lambda pre: tokenizer.encode(pre, add_special_tokens=False).ids
    model = json.loads(tokenizer.to_str())["model"]
    names = byte_names()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    vocab = {k: i for k, i in model["vocab"].items() if k not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get("".join(m)) for m in pairs]
    if None in made or made != sorted(made) or any(c not in names for k in vocab for c in k) or {i for k, i in vocab.items() if len(k) > 1} != set(made):
        return slow
    ranks = {bytes(names[c] for c in k): i for k, i in vocab.items()}
    fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda pre: [special[pre]] if pre in special else fast(pre.encode("utf-8"))


class _Remembered(dict):
    """What ``made(key)`` gave, in two generations: a full one becomes the old
    one, and what is asked for again comes back from there, so frequent keys stay."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.made(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class _Ids(_Remembered):
    """Ids of a pre-token as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.encode = piece_encoder(tokenizer)

    def made(self, pre: str) -> bytes:
        ids = self.encode(pre)
        return struct.pack(f"<{len(ids)}I", *ids)


class _Words(_Remembered):
    """Ids of a run without spaces, with the space before it."""

    def __init__(self, ids: _Ids, split, specials):
        super().__init__()
        self.ids, self.split, self.whole = ids, split, [x for x in specials if " " in x]

    def made(self, run: str) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.split(" " + run)))

    def of(self, text: str) -> bytes:
        """Ids of a whole text.  A pre-token always starts at a space with a
        visible character behind it, so such texts go run by run."""
        if " " not in text or _ODD_SPACE(text) or any(x in text for x in self.whole):
            return b"".join(map(self.ids.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return b"".join(map(self.ids.__getitem__, self.split(first))) + b"".join(map(self.__getitem__, rest))


#: A space before white space or at the end.
_ODD_SPACE = re.compile(r" (?:\s|$)").search


def cuts(n: int, capacity: int, grain: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    start = n - n % capacity
    for length in (n % capacity // grain * grain, n % capacity % grain):
        if length:
            out.append((start, length))
            start += length
    return out


def _pieces(batches, file, specials, end, capacity, grain):
    ids = worker_cache(("packing", file), lambda: _Words(_Ids(load(file)), splitter(specials), specials))
    tail = np.array([end], dtype="<u4").tobytes()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens")}
        for r, text in enumerate(strings(batch.column(1))):
            data = ids.of(text or "") + tail
            n = len(data) // 4
            for start, length in cuts(n, capacity, grain):
                out["row"].append(r)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(data[4 * start : 4 * (start + length)]))
                out["doc_tokens"].append(n)
        rows = pa.array(out.pop("row"), pa.int64())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(rows)} | {k: pa.array(v, pa.int64()) for k, v in out.items()})


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packs, shortest pack first.

    ``room`` maps free space to stacks of (count, lengths); a pack moves to the
    stack of its new free space, in part if the length has fewer pieces.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {capacity: []}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        moved: list[tuple[int, int, tuple[int, ...]]] = []
        for free in sorted((f for f in room if f >= length), reverse=True):
            while left and room[free]:
                n, lengths = room[free].pop()
                take = min(n, left)
                if take < n:
                    room[free].append((n - take, lengths))
                moved.append((free - length, take, (*lengths, length)))
                left -= take
        if left:
            # Packs that nothing fits: new ones, each filled with as many of this length as fit.
            per = capacity // length
            if left >= per:
                moved.append((capacity - per * length, left // per, (length,) * per))
            if left % per:
                moved.append((capacity - left % per * length, 1, (length,) * (left % per)))
        for free, n, lengths in moved:
            room.setdefault(free, []).append((n, lengths))
        room = {f: s for f, s in room.items() if s}
    return [p for f in sorted(room) for p in room[f]]


def slots(packs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length: columns first rank, first sequence, offset; rows by rank."""
    rank: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for n, lengths in packs:
        offset = 0
        for length in lengths:
            first = rank.get(length, 0)
            out.setdefault(length, []).append((first, sequence, offset))
            rank[length] = first + n
            offset += length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def _placed(batches, where):
    by_length = where.value
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            at, table = np.flatnonzero(length == k), by_length[int(k)]
            slot = np.searchsorted(table[:, 0], rank[at], side="right") - 1
            sequence[at] = table[slot, 1] + rank[at] - table[slot, 0]
            offset[at] = table[slot, 2]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])


def pack(docs: DataFrame, file: str = "byte_bpe_50k.json", capacity: int = 1024, end: int = 0, grain: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; repeated rows are each packed; an
    empty table gives no rows; columns besides doc_id and text are ignored.
    Pieces of equal length go in the order of a hash of id, start and content,
    equal rows in any order; a text of any length is cut, and no id is lost.
    """
    specials = specials_of(docs.sparkSession, file)
    plain = texts(docs)
    kind = dict(plain.dtypes)["doc_id"]
    pieces = saved(plain.mapInArrow(lambda it: _pieces(it, file, specials, end, capacity, grain), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    where = docs.sparkSession.sparkContext.broadcast(slots(patterns(histogram, capacity)))
    salts = 8 * (1 + sum(histogram.values()) // GROUP)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(before.drop("n"), ["length", "salt"])
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).cast("long").alias("rank")).mapInArrow(
        lambda it: _placed(it, where), f"{fields}, sequence_id long, offset long"
    )


def padding(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: sequences, tokens and padding tokens; a total that is a power of two needs none."""
    total = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    free = F.when(F.pow(F.lit(2), F.floor(F.log2("tokens"))) == F.col("tokens"), 0).otherwise(capacity - F.col("tokens"))
    return total.agg(F.count("*").alias("sequences"), F.sum("tokens").alias("tokens"), F.sum(free).alias("padding"))
