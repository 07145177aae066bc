"""Near duplicates where one id has several texts."""

import random

from textloom.llm import jaccard_join


def test_an_id_with_several_texts(spark):
    rnd = random.Random(2)
    prose = lambda n: [f"w{rnd.randrange(5_000)}" for _ in range(n)]
    a, b, c = prose(120), prose(120), prose(120)
    edit = lambda w, k: " ".join(w[:k] + ["other"] + w[k + 1 :])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, edit(a, 0)), (6, edit(b, 119)), (6, edit(c, 0)), (7, " ".join(c)), (7, " ".join(c)), (9, "alone with these few words"), (None, " ".join(a))]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted(((r.doc_id, r.class_id, r.set_id, r.n_links) for r in found), key=repr)
    # Text a: rows 1 and 5; text b: rows 1 and 6; text c: rows 6, 7 and 7.
    wanted = [(1, 1, 1, 1), (5, 1, 5, 1), (1, 1, 1, 1), (6, 1, 6, 1), (6, 6, 6, 2), (7, 6, 7, 2), (7, 6, 7, 2), (9, 9, 9, 0), (None, None, None, 0)]
    assert got == sorted(wanted, key=repr)
