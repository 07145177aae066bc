"""Embedding whitening from an exact covariance, by digit-slice matrix products.

Entries become integers.  Each task shifts them by a fixed pivot, cuts them
into limbs of ``LIMB`` bits and multiplies limb matrices with float64 BLAS, over
so few rows that every product's sum stays below 2**53 and is exact.  Sums of
limb products merge in Spark, exactly, by (dimension, dimension, limb power);
the driver gets that one matrix, recombines the limbs as big integers, centres
it (n * sum of products - product of sums) and decomposes it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SCALE, SHIFT, LIMB, COMPONENTS = 64, 1_000_000, 16, 16
#: Rows of one matrix product: 2 * LIMB bits a product, and 53 in all.
BLOCK_ROWS = 1 << 16
#: Products added up before they're handed on: below 2**63 with room.
BLOCKS = 256
#: Least share of the largest eigenvalue that counts as variance.
LEAST_SHARE = 1e-12
#: Dimensions at most: the driver holds a few numbers for each pair of them.
DIMENSIONS = 2_048
#: Entries times 64 lie within this, so that differences of two fit a long.
BOUND = 2.0**61


def usable(embedding: Column) -> Column:
    """The vector is there, and every entry is a finite number."""
    # A finite entry's difference with itself is 0, and those of NaN and infinities aren't.
    good = F.forall(embedding, lambda c: F.coalesce(c.cast("double") - c.cast("double") == 0, F.lit(False)))
    return F.coalesce((F.size(embedding) > 0) & good, F.lit(False))


def integers(embedding: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry, 64 * c being held within plus and minus ``BOUND``."""
    return F.transform(embedding, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(BOUND)), F.lit(-BOUND))) + F.lit(SHIFT).cast("long"))


def _matrix(column) -> np.ndarray:
    """Equally long lists of longs as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _limbs(x: np.ndarray) -> list:
    """Float64 matrices whose sum, each times 2**(LIMB * its place), is ``x``; the last is signed."""
    out = []
    while True:
        low = x & ((1 << LIMB) - 1) if x.size and (x.min() < -(1 << (LIMB - 1)) or x.max() >= 1 << (LIMB - 1)) else x
        out.append(low.astype(np.float64))
        x = (x - low) >> LIMB
        if not x.any():
            return out


def _products(batches, pivot: int):
    """Exact sums of products (i <= j) by limb power, and sums of entries (j = -1)."""
    total, done = None, 0

    def rows():
        power, i, j = np.nonzero(total)
        return pa.RecordBatch.from_pydict({"power": pa.array(power, pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j - 1, pa.int32()), "v": pa.array(total[power, i, j], pa.int64())})

    for batch in batches:
        for a in range(0, len(batch), BLOCK_ROWS):
            x = _matrix(batch.column(0).slice(a, BLOCK_ROWS)) - pivot
            d = x.shape[1]
            if total is None:
                total = np.zeros((8, d, d + 1), np.int64)  # column 0: sums of entries
            limbs = _limbs(x)
            for p, l in enumerate(limbs):
                total[p, :, 0] += l.sum(axis=0).astype(np.int64)
                for q, r in enumerate(limbs):
                    total[p + q, :, 1:] += np.triu((l.T @ r).astype(np.int64))
            done += 1
            if done == BLOCKS:
                yield rows()
                total, done = None, 0
    if total is not None:
        yield rows()


def _exact(sums: list, d: int) -> tuple:
    """(products, sums of entries) as big integers, from limb sums."""
    products = np.zeros((d, d), object)
    entries = np.zeros(d, object)
    for power, i, j, v in sums:
        v = int(v) << (LIMB * power)
        if j < 0:
            entries[i] += v
        else:
            products[i, j] += v
            if i != j:
                products[j, i] += v
    return products, entries


def _whitened(x: np.ndarray, model: dict) -> np.ndarray:
    """Rows centred by the exact mean and projected on the scaled components."""
    return ((x - model["floor"]) - model["rest"] / model["n"]) @ model["axes"]


def _second(batches, model):
    """Sums of products of whitened values, and of the values, over a task's rows."""
    m = model.value
    k = m["axes"].shape[1]
    total = np.zeros((k, k + 1))
    for batch in batches:
        for a in range(0, len(batch), BLOCK_ROWS):
            w = _whitened(_matrix(batch.column(0).slice(a, BLOCK_ROWS)), m)
            total += np.concatenate((w.sum(axis=0)[:, None], w.T @ w), axis=1)
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel() - 1, pa.int32()), "v": pa.array(total.ravel(), pa.float64())})


def _deviation(x: np.ndarray, m: dict) -> list:
    """Sum of (n * x - S)**2 a row, exact."""
    n, y = m["n"], x - m["floor"]
    if len(y) and (int(np.abs(y).max()) * n + n) ** 2 * x.shape[1] < 1 << 63:
        z = n * y - m["rest"]
        return np.einsum("ij,ij->i", z, z).tolist()
    z = y.astype(object) * n - m["rest"].astype(object)
    return (z * z).sum(axis=1).tolist()


def _project(batches, model):
    m = model.value
    for batch in batches:
        for a in range(0, len(batch), 4_096):
            part = batch.slice(a, 4_096)
            x = _matrix(part.column(1))
            w = _whitened(x, m)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            deviation = pa.array([str(v) for v in _deviation(x, m)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), deviation, lists], names=["vec_id", "deviation", "whitened"])


def fit(vectors: DataFrame) -> dict | None:
    """Mean, components and eigenvalues of the distinct integer vectors in ``x``.

    None if there are no vectors or all are equal.
    """
    fitted = saved(vectors.select("x").distinct())
    n, shape = fitted.count(), fitted.select(F.size("x")).first()
    if not n:
        return None
    if shape[0] > DIMENSIONS:
        raise ValueError(f"vectors of {shape[0]} dimensions; {DIMENSIONS} at most")
    d = shape[0]
    summed = fitted.mapInArrow(lambda it: _products(it, SHIFT), "power int, i int, j int, v long")
    summed = summed.groupBy("power", "i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    columns = summed.toArrow().to_pydict()  # seven powers of d * (d + 3) / 2 numbers at most, and one of small entries
    products, entries = _exact(list(zip(*(columns[c] for c in ("power", "i", "j", "v")))), d)
    centred = n * products - np.outer(entries, entries)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in centred])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    trace = int(sum(centred[i, i] for i in range(d))) / (n * n)
    keep = values[:COMPONENTS] > max(values[0], 0) * LEAST_SHARE
    if not keep.any():
        return None
    values, axes = values[:COMPONENTS][keep], axes[:, :COMPONENTS][:, keep]
    model = {
        "n": n,
        "floor": np.array([s // n + SHIFT for s in entries], np.int64),
        "rest": np.array([s % n for s in entries], np.int64),
        "axes": axes / np.sqrt(values),
        "explained": (values / trace).tolist(),
    }
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    second = fitted.mapInArrow(lambda it: _second(it, shared), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    k = len(values)
    moments = np.zeros((k, k + 1))
    for i, j, v in second:  # k * (k + 1) numbers
        moments[i, j + 1] = v / n
    model["identity_error"] = float(np.abs(moments[:, 1:] - np.outer(moments[:, 0], moments[:, 0]) - np.eye(k)).max())
    return model


def whiten(embeddings: DataFrame) -> DataFrame:
    """Every usable row of ``embeddings`` with its first components, whitened.

    Returns vec_id, n, deviation (digits of the exact number, of any length), whitened, explained (arrays by
    component) and identity_error.  Rows whose vector is null, empty or holds a
    null or a non-finite entry go; where lengths differ, those of the most
    frequent length stay (of a tie, the longer).  Repeated vectors count once in
    the fit, and each of their rows is returned.  Components without variance
    (single vectors, dimensions that follow from others) are left out; without
    any, or without rows, the result is empty.  Equal eigenvalues come in either
    order.  64 times an entry is held within 2**61.
    A null id stays; other columns are ignored.
    """
    good = embeddings.filter(usable(F.col("embedding"))).select("vec_id", integers(F.col("embedding")).alias("x"))
    sizes = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    good = good.filter(F.size("x") == (sizes.d if sizes else 0))
    model = fit(good)
    schema = "vec_id {}, deviation string, whitened array<double>".format(good.schema["vec_id"].dataType.simpleString())
    if model is None:
        rows = good.limit(0).select("vec_id", F.lit("").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        model = {"n": 0, "explained": [], "identity_error": 0.0}
    else:
        shared = good.sparkSession.sparkContext.broadcast(model)
        rows = good.mapInArrow(lambda it: _project(it, shared), schema)
    return rows.select(
        "vec_id",
        F.lit(model["n"]).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, model["explained"])).cast("array<double>").alias("explained"),
        F.lit(model["identity_error"]).alias("identity_error"),
    )


def by_component(found: DataFrame) -> DataFrame:
    """The digest columns: a row for each vector and component; a deviation that doesn't fit a long is null."""
    return found.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "identity_error").select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )
