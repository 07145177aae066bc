"""N-gram Jaccard join by the chosen-path method.

Texts become sets of ``SHINGLE``-word shingles; equal sets are one node.  A
node is known by ``COORDINATES`` minhash values.  In each of several runs a
tree of buckets grows: a bucket samples coordinates (each with probability
1 / (threshold * coordinates), by a hash of its path) and passes every member
on to the buckets of its values there.  Buckets of at most ``SMALL`` members
are compared by brute force on one-byte sketches; larger ones are split again,
and what is still large at depth ``DEPTH`` (dense groups of near copies) is
compared in full, in blocks.  The number of runs follows from the target
recall.  Buckets hand on connections, not pairs.

Nodes that candidates connect are then compared exactly: every pair of such a
group, in blocks of bounded size, on their whole shingle sets.  That gives
link counts and the final classes without a row per pair.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, saved, slices, strings, texts, worker_cache
from .components import components
from .decontaminate import words_of

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
COORDINATES, SMALL, DEPTH = 64, 64, 3
#: A sketch agreement that true links reach but for about 1 in 30,000 (four standard deviations).
LIKELY = 0.6
#: Members and shingles of a block, for comparing large buckets and groups.
BLOCK, BLOCK_SHINGLES = 4_000, 1_000_000

_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.array([int.from_bytes(hashlib.blake2b(f"coordinate {i}".encode(), digest_size=8).digest(), "little") | 1 for i in range(COORDINATES)], np.uint64)
#: Path hashes below this choose their coordinate.
_MOST = np.uint64(int((1 << 63) / (THRESHOLD * COORDINATES)) * 2)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chosen(path: np.ndarray) -> np.ndarray:
    """Which coordinates each path samples, a row for each coordinate."""
    return mixed(path ^ _A[:, None]) < _MOST


def roots(recall: float = RECALL, depth: int = DEPTH) -> np.ndarray:
    """Root paths of the runs, as many as a pair at the threshold needs to share
    a bucket of ``depth`` levels with the given chance.

    Roots that choose no coordinate are passed over.  The chance is taken over the
    coordinates that each root does choose: a pair shares each with the
    threshold's chance, and runs that choose the same one do not count as
    independent.  Below the root it is a branching process with one shared child
    a level on average.
    """
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - (1 - alive / (THRESHOLD * COORDINATES) * THRESHOLD) ** COORDINATES
    found, uses, r = [], np.zeros(COORDINATES, np.int64), 0
    # A coordinate lost to the pair is lost to every run that chooses it.
    while np.prod(1 - THRESHOLD + THRESHOLD * (1 - alive) ** uses) > 1 - recall:
        r += 1
        path = mixed(np.array([r], np.uint64))
        chosen = _chosen(path)[:, 0]
        if chosen.any():
            found.append(path[0])
            uses += chosen
    return np.array(found, np.uint64)


def runs(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs for a pair at the threshold to share a bucket with the given chance."""
    return len(roots(recall, depth))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        h = zlib.crc32(w) << 32 | zlib.crc32(w, 0x9E3779B9)
        if len(w) <= 64:
            if len(self) >= 150_000:
                self.clear()
            self[w] = h
        return h


def shingles(text: str | None, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * _M + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def _words() -> dict:
    return worker_cache("shingles", _Words)


def _signatures(batches):
    cache = _words()
    for batch in slices(batches, 2_048):
        keys, sizes, mins = [], [], []
        for text in strings(batch.column(1)):
            s = shingles(text, cache)
            sizes.append(len(s))
            keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            if len(s):
                m = np.full(COORDINATES, ~np.uint64(0))
                for a in range(0, len(s), 4096):
                    part = s[a : a + 4096]
                    m = np.minimum(m, ((part[None] ^ _A[:, None]) * _M ^ (part[None] * _A[:, None] >> np.uint64(32))).min(1))
                mins.append(mixed(m).astype(np.uint32).tobytes())
            else:
                mins.append(None)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "key": pa.array(keys, pa.binary()), "size": pa.array(sizes, pa.int64()), "mins": pa.array(mins, pa.binary())})


def _matrix(column, dtype) -> np.ndarray:
    """A binary column of equal lengths as rows."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(len(column), -1) if data else np.zeros((0, COORDINATES), dtype)


def _paths(batches, first):
    """Children of each member's bucket; without a path, of the root of every run."""
    for batch in batches:
        node, mins = batch.column("node").to_numpy(), _matrix(batch.column("mins"), np.uint32)
        starts = [batch.column("path").to_numpy().view(np.uint64)] if "path" in batch.schema.names else [np.full(len(node), r) for r in first]
        paths, nodes = [], []
        for path in starts:
            for c in range(COORDINATES):
                at = mixed(path ^ _A[c])
                chosen = np.flatnonzero(at < _MOST)
                if len(chosen):
                    paths.append(mixed(at[chosen] * _M + mins[chosen, c].astype(np.uint64)).view(np.int64))
                    nodes.append(node[chosen])
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"path": pa.array(np.concatenate(paths) if paths else none), "node": pa.array(np.concatenate(nodes) if nodes else none)})


def _joined_up(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each row's component under the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _merge(root: np.ndarray, i: int, others: np.ndarray) -> None:
    """Joins the components of row ``i`` and ``others``; each is named by its least row."""
    names = np.unique(np.append(root[others], root[i]))
    if len(names) > 1:
        root[np.isin(root, names)] = names[0]


def _groups(batches, key_names):
    """Whole groups of rows that stand together, as few tables as batches: (key starts, table)."""
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([left, t]).combine_chunks() if left is not None else t
        keys = [t.column(k).to_numpy() for k in key_names]
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.flatnonzero(new)
        left = t.slice(starts[-1])
        if starts[-1]:
            yield starts[:-1], t.slice(0, starts[-1])
    if left is not None and len(left):
        yield np.zeros(1, np.int64), left


def _edges(u, v):
    return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _likely(batches):
    """Connections inside small buckets, from sketches; rows sorted by path."""
    least = LIKELY * COORDINATES
    for starts, t in _groups(batches, ["path"]):
        n = len(t)
        bucket = np.zeros(n, np.int64)
        bucket[starts] = 1
        bucket = np.cumsum(bucket)
        sketch, node = _matrix(t.column("sketch").combine_chunks(), np.uint8), t.column("node").to_numpy()
        found_i, found_j = [], []
        for d in range(1, n):
            i = np.flatnonzero(bucket[:-d] == bucket[d:])
            if not len(i):
                break
            for a in range(0, len(i), 200_000):
                p = i[a : a + 200_000]
                hit = p[(sketch[p] == sketch[p + d]).sum(1) >= least]
                found_i.append(hit)
                found_j.append(hit + d)
        if found_i:
            root = _joined_up(n, np.concatenate(found_i), np.concatenate(found_j))
            at = np.flatnonzero(root != np.arange(n))
            yield _edges(node[at], node[root[at]])


def _likely_in_blocks(batches):
    """The same for two blocks of a large bucket; rows sorted by path and block pair."""
    least = LIKELY * COORDINATES
    for starts, t in _groups(batches, ["path", "b1", "b2"]):
        for a, b in zip(starts, [*starts[1:], len(t)]):
            part = t.slice(a, b - a)
            sketch, node = _matrix(part.column("sketch").combine_chunks(), np.uint8), part.column("node").to_numpy()
            root = np.arange(len(node))
            for i in range(len(node) - 1):
                hit = np.flatnonzero((sketch[i + 1 :] == sketch[i]).sum(1) >= least) + i + 1
                if len(hit):
                    _merge(root, i, hit)
            at = np.flatnonzero(root != np.arange(len(node)))
            if len(at):
                yield _edges(node[at], node[root[at]])


def _sets(batches):
    """Texts to whole shingle sets; only rows whose set is the node's."""
    cache = _words()
    for batch in slices(batches):
        rows = batch.to_pydict()
        sets = [shingles(t, cache) for t in rows.pop("text")]
        keep = [i for i, (s, k) in enumerate(zip(sets, rows["key"])) if hashlib.md5(s.tobytes()).digest() == k]
        yield pa.RecordBatch.from_pydict(
            {"node": pa.array([rows["node"][i] for i in keep], pa.int64()), "root": pa.array([rows["root"][i] for i in keep], pa.int64()), "n_blocks": pa.array([rows["n_blocks"][i] for i in keep], pa.int32()), "copies": pa.array([rows["copies"][i] for i in keep], pa.int64()), "shingles": pa.array([sets[i].tobytes() for i in keep], pa.binary())}
        )


def _exact(batches):
    """Links of each node inside two blocks of a group, and the least node they join it to there."""
    for starts, t in _groups(batches, ["root", "b1", "b2"]):
        out_node, out_sets, out_docs, out_v = [], [], [], []
        for a, b in zip(starts, [*starts[1:], len(t)]):
            part = t.slice(a, b - a)
            node, block, copies = part.column("node").to_numpy(), part.column("block").to_numpy(), part.column("copies").to_numpy()
            _, first = np.unique(node, return_index=True)
            size = pc.binary_length(part.column("shingles")).to_numpy()[first] // 8
            first = first[np.argsort(size, kind="stable")]  # by size, so that sets within the length bound stand together
            data = np.frombuffer(b"".join(part.column("shingles").combine_chunks().take(pa.array(first)).to_pylist()), np.uint64)
            node, block, copies, size = node[first], block[first], copies[first], np.sort(size)
            ids = np.unique(data, return_inverse=True)[1].astype(np.int32)
            del data
            begin = np.append(0, np.cumsum(size))
            # Sets that a set can link to have at most 5 / 4 of its size.
            last = np.searchsorted(4 * size, 5 * size, side="right")
            cross = part.column("b1")[0].as_py() != part.column("b2")[0].as_py()
            mark = np.zeros(int(ids.max()) + 1, np.uint8)
            n_sets, n_docs, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.arange(len(node))
            for i in range(len(node) - 1):
                j = i + 1
                if last[i] <= j:
                    continue
                own = ids[begin[i] : begin[j]]
                mark[own] = 1
                shared = np.add.reduceat(mark[ids[begin[j] : begin[last[i]]]], begin[j : last[i]] - begin[j], dtype=np.int64)
                mark[own] = 0
                # In whole numbers: shared / (a + b - shared) >= 4 / 5.
                linked = 9 * shared >= 4 * (size[i] + size[j : last[i]])
                if cross:
                    linked &= block[j : last[i]] != block[i]
                others = np.flatnonzero(linked) + j
                if len(others):
                    n_sets[i] += len(others)
                    n_docs[i] += copies[others].sum()
                    n_sets[others] += 1
                    n_docs[others] += copies[i]
                    _merge(root, i, others)
            out_node.append(node)
            out_sets.append(n_sets)
            out_docs.append(n_docs)
            out_v.append(node[root])
        yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate(out_node)), "n_sets": pa.array(np.concatenate(out_sets)), "n_docs": pa.array(np.concatenate(out_docs)), "v": pa.array(np.concatenate(out_v))})


def blocks_of(df: DataFrame, n_blocks) -> DataFrame:
    """Rows of ``df`` with their block, once for every pair of blocks it is in."""
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), n_blocks.cast("int") - 1))
    return df.withColumn("block", own).withColumn("other", other).withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")).drop("other")


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Every document with its class and its number of links.

    Returns, per row of ``docs``: doc_id; class_id, the least doc_id that links
    (shingle-set Jaccard of ``THRESHOLD`` or more) connect it to; set_id, the
    least doc_id with an equal set; n_set_links, other sets it links to; and
    n_links, other documents it links to, those with an equal set included.

    A text of under ``SHINGLE`` words is one shingle; null and empty texts have
    none and are alone, as are rows without an id.  Repeated rows are copies;
    an id that returns with another text is a document more, linked by its own
    text.  An empty table gives no rows; other columns are ignored.  Of ids that tie for a class the least names
    it.  A text of any length is one whole set, which one task holds.
    """
    first = roots(recall)
    plain = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = plain.mapInArrow(_signatures, "doc_id long, key binary, size long, mins binary")
    signed = saved(signed.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key"))))
    # A set's node is a hash of the set: an id may return with another text.
    nodes = signed.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("mins").alias("mins"))
    nodes = saved(nodes.withColumn("node", F.xxhash64("key")))
    low_bytes = "node long, sketch binary"

    def sketches(batches):
        for batch in batches:
            m = np.ascontiguousarray(_matrix(batch.column(1), np.uint32).astype(np.uint8))
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "sketch": pa.array([r.tobytes() for r in m], pa.binary())})

    sketch = nodes.select("node", "mins").mapInArrow(sketches, low_bytes)
    level = saved(nodes.select("node", "mins").mapInArrow(lambda it: _paths(it, first), "path long, node long"))
    small, big = None, None
    for depth in range(DEPTH):
        counted = saved(level.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"))
        shared = saved(join_hot(level, counted, "path", level.count()).select("path", "node", "n"))
        part = shared.filter(F.col("n") <= SMALL).select("path", "node")
        small = part if small is None else small.unionByName(part)
        big = shared.filter(F.col("n") > SMALL)
        if depth == DEPTH - 1 or big.isEmpty():
            break
        level = saved(big.select("path", "node").join(nodes.select("node", "mins"), "node").mapInArrow(lambda it: _paths(it, first), "path long, node long"))
    near = small.join(sketch, "node").repartition("path").sortWithinPartitions("path").mapInArrow(_likely, "u long, v long")
    wide = blocks_of(big.join(sketch, "node"), F.ceil(F.col("n") / BLOCK))
    dense = wide.repartition("path", "b1", "b2").sortWithinPartitions("path", "b1", "b2").select("path", "b1", "b2", "node", "sketch").mapInArrow(_likely_in_blocks, "u long, v long")
    groups = components(near.unionByName(dense))

    members = saved(groups.join(nodes.select("node", "key", "copies", "size", "least"), "node"))
    volume = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"), F.count("*").alias("n"))
    members = join_hot(members, volume, "root", members.count()).select("node", "root", "key", "copies", "n_blocks", "least")
    # Members grow with the corpus, so they are never broadcast, whatever their size now.
    whole = members.hint("merge").join(plain.withColumnRenamed("doc_id", "least"), "least").mapInArrow(_sets, "node long, root long, n_blocks int, copies long, shingles binary")
    told = blocks_of(whole, F.col("n_blocks")).select("root", "b1", "b2", "block", "node", "copies", "shingles")
    exact = saved(told.repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2").mapInArrow(_exact, "node long, n_sets long, n_docs long, v long"))
    links = exact.groupBy("node").agg(F.sum("n_sets").alias("n_sets"), F.sum("n_docs").alias("n_docs"))
    classes = saved(components(exact.select(F.col("node").alias("u"), "v")).join(nodes.select("node", "least"), "node"))
    names = saved(classes.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n")))
    classes = join_hot(classes.drop("least"), names, "root", classes.count()).select("node", "class_id")
    result = nodes.select("key", "node", "least", F.col("copies").alias("n")).join(links, "node", "left").join(classes, "node", "left")
    result = saved(result.select("key", "n", F.col("least").alias("set_id"), F.coalesce("class_id", "least").alias("class_id"), F.coalesce("n_sets", F.lit(0)).alias("n_sets"), (F.coalesce("n_docs", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    told = join_hot(signed.filter("key is not null").select("doc_id", "key"), result, "key", signed.count())
    alone = signed.filter("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_set_links"), F.lit(0).cast("long").alias("n_links"))
    return told.select("doc_id", "class_id", "set_id", F.col("n_sets").cast("long").alias("n_set_links"), F.col("n_links").cast("long").alias("n_links")).unionByName(alone)


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (class_id, n_links), comparing all pairs."""
    cache = _Words()
    sets = [(i, set(shingles(t, cache).tolist())) for i, t in rows]
    root = {i: i for i, _ in sets}
    n = dict.fromkeys(root, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, z in sets[a + 1 :]:
            if x and z and 5 * len(x & z) >= 4 * len(x | z):
                n[i] += 1
                n[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (find(i), n[i]) for i in root}
