"""Whitening against exact arithmetic on small tables, and its edges."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import whitening

SMALL = "/root/testdata/sf0.001"


def by_hand(rows):
    """vec_id -> (n, deviation, whitened, explained) by fractions and eigh, for (vec_id, vector) rows."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[float(Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n**3)) for b in range(d)] for a in range(d)]
    e, u = np.linalg.eigh(np.array(cov))
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    out = []
    for i, x in good:
        centred = np.array([float(Fraction(n * c - m, n)) for c, m in zip(x, s)])
        out.append((i, n, sum((n * c - m) ** 2 for c, m in zip(x, s)), centred @ u / np.sqrt(e), e / np.trace(cov)))
    return out


def same(found, wanted):
    found = {r.vec_id: r for r in found}
    assert len(found) == len(wanted)
    signs = None
    for i, n, deviation, w, explained in wanted:
        r = found[i]
        assert (r.n, int(r.deviation)) == (n, deviation)
        if signs is None and np.abs(w).min() > 1e-6:
            signs = np.sign(w) * np.sign(r.whitened)
    for i, _, _, w, explained in wanted:
        assert np.allclose(np.array(found[i].whitened), w * signs, atol=1e-8)
        assert np.allclose(found[i].explained, explained, rtol=1e-9)
        assert found[i].identity_error < 1e-8


@pytest.mark.parametrize("size", (1.0, 3e7, 1e12))
def test_by_hand(spark, size):
    """Entries of one limb, of three and of four."""
    rnd = random.Random(int(size))
    rows = [(i, [rnd.gauss(0, 1 + k) * size for k in range(5)]) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, [1.0, None, 2.0, 3.0, 4.0]), (104, [math.nan] * 5), (105, [math.inf] + [0.0] * 4), (106, []), (107, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit("x").alias(c) for c in ("x", "n", "label", "i", "v", "whitened"))).repartition(4)
    wanted = by_hand([(i, v) for i, v in rows if i != 107])
    same(whitening.whiten(table).collect(), wanted)


def test_limbs_are_exact():
    rnd = np.random.default_rng(1)
    for top in (3, 1 << 15, 1 << 20, 1 << 40, 1 << 62):
        x = rnd.integers(-top, top, size=(50, 4))
        limbs = whitening._limbs(x)
        back = sum(l.astype(np.int64).astype(object) << (whitening.LIMB * p) for p, l in enumerate(limbs))
        assert (back == x.astype(object)).all()
        assert all(np.abs(l).max() <= 1 << 16 for l in limbs)


def test_products_are_exact():
    import pyarrow as pa

    x = np.random.default_rng(2).integers(-(1 << 45), 1 << 45, size=(300, 6))
    batch = pa.RecordBatch.from_pydict({"x": pa.array(list(x + 7), pa.list_(pa.int64()))})
    sums = [tuple(r.values()) for b in whitening._products([batch.slice(0, 120), batch.slice(120)], 7) for r in b.to_pylist()]
    products, entries = whitening._exact(sums, 6)
    big = x.astype(object)
    assert (products == big.T @ big).all() and (entries == big.sum(axis=0)).all()


def test_degenerate(spark):
    """No rows, one vector, a vector repeated, and a dimension that follows from another."""
    make = lambda rows: whitening.by_component(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert make([]).count() == 0
    assert make([(1, [1.0, 2.0])]).count() == 0
    assert make([(i, [1.0, 2.0]) for i in range(5)] + [(None, None)]).count() == 0
    rows = make([(i, [float(i % 7), float(i % 7), 1.0]) for i in range(20)] + [(None, [0.0, 0.0, 1.0])]).collect()
    assert len(rows) == 21 and {r.component for r in rows} == {1} and {r.n for r in rows} == {7}
    assert all(abs(r.explained - 1) < 1e-9 and r.identity_error < 1e-9 for r in rows)


def test_huge_entries(spark):
    """Beyond 2**61 entries are held at the bound, and nothing overflows."""
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0]), (4, [3e18, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 4 and all(math.isfinite(w) for r in found for w in r.whitened)


def test_whole_table(spark):
    from textloom.llm.queries import op12_whitening

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = op12_whitening(spark, SMALL).collect()
    wanted = {i: (n, v, w, e) for i, n, v, w, e in by_hand(rows)}
    assert len(found) == 16 * len(wanted)
    ours = np.zeros((len(wanted), 16))
    place = {i: k for k, i in enumerate(wanted)}
    for r in found:
        n, deviation, _, explained = wanted[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        ours[place[r.vec_id], r.component - 1] = r.whitened
    theirs = np.array([w for _, _, w, _ in wanted.values()])
    assert np.allclose(ours * np.sign((ours * theirs).sum(axis=0)), theirs, atol=1e-8)
