"""Secret scans of texts made to be slow, of rows without ids, and the candidate pattern against a plain walk."""

import random
import re
import time

import pytest

from textloom.llm import secrets

CODE = "b7db7aa4a5fcc78305"


def scanned(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return d, secrets.scan(d)


@pytest.mark.parametrize(
    "text",
    (
        "token " + "_" * 1_000_000 + " end",
        "token" * 100_000 + " end",
        "token-" * 100_000 + " end",
        "a_token=" + "_" * 500_000,
        "x" * 400_000 + " key",
        "://" * 200_000 + "a:b",
        "password " + "-----BEGIN PRIVATE KEY-----" * 5_000,
    ),
    ids=("underscores", "names", "names and hyphens", "long value", "long run", "addresses", "key heads"),
)
def test_no_text_is_slow(spark, text):
    start = time.time()
    d, found = scanned(spark, [text, f"password={CODE} x"])
    clean = {r.doc_id: r.text for r in secrets.redacted(d, found).collect()}
    assert clean[1] == "password=[SECRET] x"
    assert time.time() - start < 60


def test_very_many_keys_in_one_text(spark):
    text = "\n".join(f"password=Zq{i:06d}xK" for i in range(100_000))
    start = time.time()
    _, found = scanned(spark, [text])
    assert found.count() >= 100_000 and found.select("value").distinct().count() >= 100_000
    assert time.time() - start < 60


def test_rows_without_an_id_keep_their_secrets_apart(spark):
    d = spark.createDataFrame([(None, f"password={CODE} x"), (None, f"the word {CODE[:8]} and the word {CODE}"), (None, None), (4, f"password={CODE} x"), (4, "password=Zk3Xq9vBn2 x")], "doc_id long, text string")
    rows = [tuple(r) for r in secrets.redacted(d, secrets.scan(d)).collect()]
    assert len(rows) == 5 and (None, None) in rows
    assert rows.count((None, "password=[SECRET] x")) == 1 and rows.count((4, "password=[SECRET] x")) == 2


def test_context_of_every_place(spark):
    """Signs before and after, across the blocks of a long text and with signs beyond the basic plane."""
    rnd = random.Random(6)
    text = "".join(rnd.choice(["é😀 ", "plain words ", f"Zk3Xq9vBn2Lm8Pw5{i:04d}Qd "]) for i in range(900))
    rows = secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) > 200
    for r in rows:
        assert text.index(r.value) == r.at - 1 and r.occurrences == 1
        assert r.before == text[max(0, r.at - 1 - secrets.AROUND) : r.at - 1]
        assert r.after == text[r.at - 1 + len(r.value) :][: secrets.AROUND]


def walk(text):
    """Values of assigned names, by trying every name at every place."""
    names = re.compile(r"(?i)(password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)[A-Za-z0-9_]*[\"']?\s{0,3}[=:]\s{0,3}(\"[^\"\n]{4,}\"|'[^'\n]{4,}'|[^\s\"'][^\s\"']{3,})")
    out, at = [], 0
    while True:
        found = None
        for start in range(at, len(text)):
            found = names.match(text, start)
            if found:
                break
        if not found:
            return out
        out.append(found.group(2).strip("\"'") if found.group(2)[0] in "\"'" else found.group(2))
        at = found.end()


def test_assigned_values_against_a_walk(spark):
    rnd = random.Random(4)
    parts = ["password", "my", "api-key", "api_key", "APIKEY", "x9", "_", "-", "token", "auth", " ", ": ", "=", " = ", '"', "'", "\n", "value1", "abcd efgh", "se cret", "secret"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(3, 25))) for _ in range(400)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {}
    for r in secrets.candidates(d).collect():
        found.setdefault(r.doc_id, set()).add(r.value)
    for i, t in enumerate(texts):
        assert set(walk(t)) <= found.get(i, set()), t
