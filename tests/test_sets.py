"""Similar sets against all pairs, and a group that holds every set."""

import random

import pytest

from textloom.plans import sets


def made(n, seed, groups=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [rnd.sample(words, rnd.randint(1, 20)) for _ in range(8)]
    out = []
    for k in range(n):
        own = set(rnd.choice(base)) if rnd.random() < 0.7 else set(rnd.sample(words, rnd.randint(0, 12)))
        for _ in range(rnd.randint(0, 4)):
            own ^= {rnd.choice(words)}
        out.append((f"g{rnd.randrange(groups)}", k, sorted(own)))
    return out


def jaccard(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0


@pytest.mark.parametrize("least", (0.3, 0.5, 0.8, 1.0))
def test_against_all_pairs(spark, least):
    rows = made(150, int(least * 10))
    wanted = sorted((g, a, b) for g, a, x in rows for h, b, y in rows if g == h and a < b and jaccard(x, y) >= least)
    d = spark.createDataFrame(rows, "g string, id long, words array<string>").repartition(4)
    found = sets.similar_sets(d, least=least).collect()
    assert sorted((r.g, r.a, r.b) for r in found) == wanted
    texts = {k: w for _, k, w in rows}
    assert all(abs(r.similarity - jaccard(texts[r.a], texts[r.b])) < 1e-12 for r in found)


def test_two_sides(spark):
    rows = made(120, 5, 1)
    d = spark.createDataFrame(rows, "g string, id long, words array<string>")
    found = sets.similar_sets(d.filter("id < 60"), d.filter("id >= 60"), 0.5)
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((a, b) for _, a, x in rows for _, b, y in rows if a < 60 <= b and jaccard(x, y) >= 0.5)


def test_one_large_group_makes_few_candidates(spark):
    """5,000 passages of one person with common words and own ones: all pairs would be 12 million."""
    rnd = random.Random(9)
    common = [f"the{i}" for i in range(15)]
    rows = [("p", k, [*common, *(f"own{rnd.randrange(40_000)}x{j}" for j in range(20))]) for k in range(5_000)]
    rows += [("p", 5_000 + k, list(rows[k][2])) for k in range(50)]
    d = spark.createDataFrame(rows, "g string, id long, words array<string>").repartition(4)
    assert sets.candidates(d, d, 0.5).filter("a < b").count() < 20_000
    assert sorted((r.a, r.b) for r in sets.similar_sets(d).collect()) == [(k, 5_000 + k) for k in range(50)]
