"""Secret scans: candidate patterns, then a random forest that removes false positives.

Only DataFrame functions and the JVM's random forest.  Candidates are values
assigned to password-like names (whole, of 4 signs or more), passwords in
URLs, private-key blocks, and long runs.  The forest sees their length, character make-up, how likely
their character transitions are in the corpus' words, how much of them the
corpus' dictionary covers, the path, and the neighbouring words.

The forest learns from labelled findings (value, before, after, path, label).
``labelled_findings`` makes the default ones from hashes: secrets of common
shapes, and placeholders, numbers, identifiers and checksums that are none.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, saved

#: Patterns of candidates, in Java's syntax.
_SECRET_NAMES = r"(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential)"
#: A name with any prefix and suffix, and its whole quoted or unspaced value.  A run of a name's signs is tried
#: once, from its beginning, and for the last secret name in it: a suffix that fails behind that one fails behind all.
ASSIGNED = rf"(?i)(?<![A-Za-z0-9_\-])(?>[A-Za-z0-9_\-]*{_SECRET_NAMES})[A-Za-z0-9_]*+[\"']?\s{{0,3}}[=:]\s{{0,3}}(\"[^\"\n]{{4,}}\"|'[^'\n]{{4,}}'|[^\s\"'][^\s\"']{{3,}})"
URL = r"://[^\s/:@]*:([^\s/@]{4,})@"
PRIVATE = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]{0,30}PRIVATE KEY-----|\z)"
LONG = r"[A-Za-z0-9+/_\-]{16,}"
KNOWN = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^xox[abprs]-|^AIza[A-Za-z0-9_\-]{30,}$|^eyJ[A-Za-z0-9_\-]{10,}|^-----BEGIN "
NAMES = r"(?i)((password|passwd|pwd|token|secret|key|auth|credential)(\W{0,6}|\w{0,30}[\"']?\s{0,3}[=:]\s{0,3}[\"']?)|://[^\s/:@]*:)$"
DOUBT = r"(?i)\b(examples?|sample|dummy|placeholder|your|tests?|fake|commit|sha256|sha1|md5|checksum|digest|version|isbn|phone)\b|(?-i:EXAMPLE)|xxxx"
PLAIN_PATH = r"(?i)(^|[/_.-])(test|tests|example|examples|fixture|fixtures|mock|docs?|sample)([/_.-]|$)"
#: Characters of context on either side; the least count that makes a dictionary word.
AROUND, LEAST_COUNT = 48, 5
#: Sizes summed up together; signs of a block of text.
LIST, BLOCK = 256, 1_024
TREES, TREE_DEPTH, FINDINGS, SECRET = 24, 8, 6_000, 0.5
_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"

FEATURES = ("chars", "digit_share", "upper_share", "lower_share", "distinct_share", "changes", "hex_only", "known", "transitions", "coverage", "named", "doubt", "plain_path", "sequence")


def dictionary(docs: DataFrame) -> DataFrame:
    """(word, n) of the corpus' lower-cased alphabetic words seen ``LEAST_COUNT`` times or more, over all documents."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z]+")).alias("word"))
    return saved(words.filter(F.length("word") > 1).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT))


def transitions(words: DataFrame) -> list[float]:
    """Log-probability of each of the 36 signs after each, from the dictionary; unseen pairs at a floor.  1,296 numbers."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = {r.pair: r.n for r in pairs.collect()}  # 26 * 26 rows at most
    out = []
    for a in _SIGNS:
        total = sum(counts.get(a + b, 0) for b in _SIGNS)
        out += [math.log((counts.get(a + b, 0) + 0.1) / (total + 3.6)) for b in _SIGNS]
    return out


def _matches(pattern: str, group: int, from_end: int) -> Column:
    """Where ``pattern`` matches column ``text``: (at, value) structs, 1-based.

    Text between the matches and the matches themselves give each one's place;
    the value is group ``group``, which ends ``from_end`` signs before the match does.
    """
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.length(g).cast("long"))
    rows = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))

    def placed(rows: Column) -> Column:
        ends = _running_sums(F.transform(rows, lambda x: x["gap"] + F.coalesce(F.length(x["whole"]), F.lit(0))))
        one = lambda end, x: F.struct((end + (1 - from_end) - F.length(x["value"])).alias("at"), x["value"].alias("value"))
        return F.filter(F.zip_with(ends, rows, one), lambda m: m["value"].isNotNull())

    return F.when(F.size(whole) > 0, let(rows, placed)).otherwise(F.array().cast("array<struct<at:bigint,value:string>>"))


def _running_sums(sizes: Column) -> Column:
    """Running sums of an array of longs, by lists of ``LIST``: a fold that carries an array would copy it at each step."""
    sum_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    # The sums of the first so many of a list.
    before = lambda a, i: sum_of(F.slice(a, F.lit(1), i))

    def of_lists(lists: Column) -> Column:
        inside = lambda a: F.transform(a, lambda _, i: before(a, i + 1))
        return let(F.transform(lists, sum_of), lambda sums: F.flatten(F.transform(lists, lambda a, k: let(before(sums, k), lambda base: F.transform(inside(a), lambda s: s + base)))))

    lists = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / LIST).cast("int")), lambda k: F.slice(sizes, k * LIST + 1, F.lit(LIST)))
    return let(lists, of_lists)


def _names() -> Column:
    return F.lower("text").rlike("passw|pwd|token|secret|key|auth|credential")


def _may_have() -> Column:
    """Most texts have no candidate: a look for each pattern's beginning.  A null text has none."""
    return F.coalesce(F.col("text").rlike(LONG) | _names() | F.col("text").contains("://") | F.col("text").contains("PRIVATE KEY"), F.lit(False))


def row_key() -> Column:
    """What a row's secrets are known by: its id and text, so rows without an id have keys too."""
    return F.xxhash64("doc_id", "text")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """Each distinct candidate of each row: row_key, doc_id, value, at (1-based, its first match), occurrences (its matches), before, after, path."""
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    d = docs.filter(_may_have()).select(F.monotonically_increasing_id().alias("row"), row_key().alias("row_key"), "doc_id", "text", F.coalesce(where, F.lit("")).alias("path"))
    names = _names()
    none = F.array().cast("array<struct<at:bigint,value:string>>")
    long = F.filter(_matches(LONG, 0, 0), lambda m: m["value"].rlike("[A-Za-z0-9]"))
    bare = lambda m: F.struct((m["at"] + 1).alias("at"), F.substr(m["value"], F.lit(2), F.length(m["value"]) - 2).alias("value"))
    assigned = F.transform(_matches(ASSIGNED, 1, 0), lambda m: F.when(m["value"].rlike("^([\"']).*\\1$"), bare(m)).otherwise(m))
    assigned = F.when(names, assigned).otherwise(none)
    url = F.when(F.col("text").contains("://"), _matches(URL, 1, 1)).otherwise(none)
    private = F.when(F.col("text").contains("PRIVATE KEY"), _matches(PRIVATE, 0, 0)).otherwise(none)
    # The text in blocks too: signs around a place are read from two of them, not counted from the text's beginning.
    d = d.withColumns({"found": F.concat(long, assigned, url, private), "blocks": F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))})

    def near(block: Column, at: Column, first: Column, size: Column) -> Column:
        two = F.concat(F.coalesce(F.get("blocks", block), F.lit("")), F.coalesce(F.get("blocks", block + 1), F.lit("")))
        return F.substr(two, (at + first - block * BLOCK).cast("int"), size.cast("int"))

    def context(m: Column) -> Column:
        at, end = m["at"], m["at"] + F.length(m["value"])
        size = F.least(at - 1, F.lit(AROUND))
        begin = ((at - size - 1) / BLOCK).cast("int")
        return F.struct(at.alias("at"), m["value"].alias("value"), near(begin, at, -size, size).alias("before"), near(((end - 1) / BLOCK).cast("int"), end, F.lit(0), F.lit(AROUND)).alias("after"))

    # The outer form, with its empty rows dropped behind: of the inner one the optimizer makes a filter that matches all patterns a second time.
    own = ("row", "row_key", "doc_id", "path")
    one = d.select(*own, F.explode_outer(F.transform("found", context)).alias("m")).select(*own, "m.*").filter("value is not null")
    # Of a value that several patterns give, a place counts once.
    first = one.groupBy("row", "value").agg(F.min(F.struct("at", "row_key", "doc_id", "path", "before", "after")).alias("m"), F.size(F.collect_set("at")).cast("long").alias("occurrences"))
    return first.select("m.row_key", "m.doc_id", "value", "m.at", "occurrences", "m.before", "m.after", "m.path")


def _share(value: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{chars}]", "")) / F.length(value)


def with_features(found: DataFrame, words: DataFrame, table: list[float]) -> DataFrame:
    """``found`` (value, before, after, path and more) with the forest's features."""
    v = F.col("value")
    # Dictionary coverage: letters of alphabetic runs that are words, by a join on the runs of distinct values.
    # A value goes by its digest: a long one has many runs.
    digest = F.sha2("value", 256).alias("digest")
    distinct = found.select(digest, "value").dropDuplicates(["digest"])
    # Camel case splits too; runs of one letter cover nothing.
    runs = distinct.select("digest", F.explode(F.split(F.lower(F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")).alias("word")).filter(F.length("word") > 2)
    covered = runs.join(words.select("word"), "word").groupBy("digest").agg(F.sum(F.length("word")).alias("covered"))
    plain = F.regexp_replace(F.lower(v), "[^a-z0-9]", "")
    lookup = F.array(*(F.lit(x) for x in table))
    d = found.withColumn("digest", digest).join(covered, "digest", "left").withColumn("plain", plain).withColumn("signs", F.split("plain", "")).withColumn("lookup", lookup)
    # Signs are looked up in their list: a substring of a long value would be counted from its beginning each time.
    mean = F.expr(
        f"""aggregate(sequence(1, greatest(length(plain) - 1, 1)), double(0), (s, i) ->
            s + coalesce(get(lookup, (locate(coalesce(get(signs, i - 1), ''), '{_SIGNS}') - 1) * 36 + locate(coalesce(get(signs, i), ''), '{_SIGNS}') - 1), -5.0))
            / greatest(length(plain) - 1, 1)"""
    )
    in_order = F.expr("aggregate(sequence(1, greatest(length(plain) - 1, 1)), 0, (s, i) -> s + int(ascii(coalesce(get(signs, i), '')) - ascii(coalesce(get(signs, i - 1), '')) in (0, 1))) / greatest(length(plain) - 1, 1)")
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "+/_-", "")
    flag = lambda c: c.cast("double")
    around = F.concat("before", F.lit(" "), v, F.lit(" "), "after")
    return d.withColumns(
        {
            "chars": F.length(v).cast("double"),
            "digit_share": _share(v, "0-9"),
            "upper_share": _share(v, "A-Z"),
            "lower_share": _share(v, "a-z"),
            "distinct_share": F.size(F.array_distinct("signs")) / F.greatest(F.length("plain"), F.lit(1)),
            "changes": F.length(kinds) / F.length(v),
            "hex_only": flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$") & v.rlike("[a-fA-F]")),
            "known": flag(v.rlike(KNOWN)),
            "transitions": mean,
            "coverage": F.coalesce(F.col("covered"), F.lit(0)) / F.length(v),
            "named": flag(F.col("before").rlike(NAMES)),
            "doubt": flag(around.rlike(DOUBT)),
            "plain_path": flag(F.col("path").rlike(PLAIN_PATH)),
            "sequence": in_order,
        }
    ).drop("plain", "signs", "lookup", "covered", "digest")


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``n`` labelled findings made from hashes of their numbers, the same every time."""
    one = "sha2(concat('finding', id), 256)"
    code = "translate(base64(unhex(sha2(concat('code', id), 512))), '+/=', 'xYz')"
    pick = lambda words: f"element_at(array({', '.join(repr(w) for w in words)}), 1 + int(pmod(xxhash64(id, 'w{len(words)}'), {len(words)})))"
    word = lambda k: f"element_at(array('config','version','module','server','release','update','storage','window','client','report','network','archive'), 1 + int(pmod(xxhash64(id, {k}), 12)))"
    size = "int(16 + pmod(xxhash64(id), 25))"
    kinds = [
        (1, f"substring({one}, 1, {size})", pick(["and password=", 'token = "', "secret: ", "the api_key="]), "src1"),
        (1, f"concat('AKIA', substring(upper({code}), 1, 16))", pick(["key is ", "with ", "of the ", "aws "]), "src2"),
        (1, f"substring({code}, 1, {size} + 8)", pick(["token: ", "secret = ", "auth=", "password "]), "app/settings"),
        (1, f"concat('ghp_', substring({code}, 1, 36))", pick(["use ", "with ", "push "]), "src3"),
        (0, f"concat('AKIA', substring(upper({code}), 1, 9), 'EXAMPLE')", pick(["for example ", "key is ", "sample "]), "docs/usage"),
        (0, f"concat({word(1)}, '_', {word(2)}, '_', {word(3)}, id % 10)", pick(["see ", "call ", "key ", "token "]), "src4"),
        (0, f"concat({word(4)}, '/', {word(5)}, '/', {word(6)}, '-', id % 100)", pick(["in ", "from ", "path "]), "src5"),
        (0, f"substring(conv(substring({one}, 1, 15), 16, 10), 1, 16)", pick(["call ", "card ", "number ", "of the "]), "src6"),
        (0, f"repeat(element_at(array('x','0','a','1234567890','abcdef0123'), 1 + int(id % 5)), 20)", pick(["password=", "token: ", "key "]), "src7"),
        (0, f"substring({one}, 1, 40)", pick(["commit ", "sha256 ", "md5 checksum ", "digest "]), "src8"),
        (0, f"concat('your-', {word(7)}, '-key-', id % 10, '-here')", pick(["password=", "api_key: "]), "examples/config"),
        (0, f"concat({word(8)}, initcap({word(9)}), initcap({word(10)}), id % 1000)", pick(["token ", "see ", "class "]), "tests/unit"),
        (1, f"concat(initcap({word(10)}), '&', id % 10, substring({code}, 1, 4), '!')", pick(["password=", "DB_PASSWORD=", "pwd: ", "PASSWORD_PROD = "]), "src9"),
        (1, f"substring({code}, 1, int(5 + pmod(xxhash64(id), 8)))", pick(["pwd=", "auth_token=", 'SECRET_KEY = "', "client_secret: "]), "src1"),
        (1, f"concat({word(11)}, id % 10, {word(12)})", pick(["DB_PASSWORD=", "password: ", "client_secret: ", "passwd="]), "src2"),
        (1, f"substring({code}, 1, int(8 + pmod(xxhash64(id), 8)))", pick(["at postgres://bob:", "mysql://root:", "https://me:"]), "src3"),
        (1, f"substring(translate({code}, '0123456789', 'qXkZvJwHpY'), 1, {size})", pick(["use ", "with ", "of the ", "is "]), "src4"),
        (1, f"concat('-----BEGIN RSA PRIVATE KEY-----', {code}, '-----END RSA PRIVATE KEY-----')", pick(["key ", "file "]), "src5"),
        (0, f"{word(13)}", pick(["password: ", "the token = ", "secret: ", "auth="]), "src6"),
        (0, f"concat({word(14)}, '.', {word(15)}, '()')", pick(["token = ", "auth: ", "password="]), "src7"),
        (0, f"concat({word(16)}, '-', {word(17)}, '-', {word(18)})", pick(["see ", "of the ", "in ", "with "]), "src8"),
        (0, f"concat({word(19)}, initcap({word(20)}), initcap({word(21)}))", pick(["see ", "call ", "class ", "use "]), "src9"),
    ]
    arms = lambda i: " ".join(f"when {k} then {x[i]!r}" if i == 3 else f"when {k} then {x[i]}" for k, x in enumerate(kinds))
    case = lambda i: F.expr(f"case int(id % {len(kinds)}) {arms(i)} end")
    d = spark.range(0, n, 1, 4).select("id", case(0).cast("double").alias("label"), case(1).alias("value"), case(2).alias("before"), case(3).alias("path"))
    return d.withColumn("value", F.expr("substring(value, 1, 200)")).withColumn("after", F.lit(" and the")).filter("length(value) >= 4")


def forest(findings: DataFrame, words: DataFrame, table: list[float]) -> PipelineModel:
    """A random forest from labelled findings (value, before, after, path, label)."""
    rows = saved(with_features(findings, words, table).select("label", *FEATURES))
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="vector", handleInvalid="keep"), RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=TREE_DEPTH, seed=3)]
    return Pipeline(stages=stages).fit(rows)


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """Every candidate of every document with the forest's score.

    Returns row_key, doc_id, value, at, occurrences, score and is_secret, one
    row for each distinct candidate of a row.  Null and empty texts have none; repeated
    rows give repeated rows; an empty table gives no rows; a missing or null
    path counts as an empty one; other columns are ignored.  A value that
    matches several times is one row, at its first place; of a value that
    several patterns give, the places count once.  Texts are searched whole,
    whatever their length.
    """
    words = dictionary(docs)
    table = transitions(words)
    model = forest(findings if findings is not None else labelled_findings(docs.sparkSession), words, table)
    found = with_features(saved(candidates(docs, path)), words, table)
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select("row_key", "doc_id", "value", "at", "occurrences", "score", (F.col("score") >= SECRET).alias("is_secret"))


def report(scanned: DataFrame) -> DataFrame:
    """Findings without the secrets themselves: first characters, length and digest."""
    return scanned.select(
        "doc_id", "at", "occurrences", F.length("value").alias("length"), F.substring("value", 1, 4).alias("begins"), F.sha2("value", 256).alias("sha256"), F.round("score", 6).alias("score"), "is_secret"
    )


def _whole(value: Column) -> Column:
    """A pattern for a value that is no part of a longer run of letters and digits."""
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?<![A-Za-z0-9](?=[A-Za-z0-9]))"), quoted, F.lit("(?!(?<=[A-Za-z0-9])[A-Za-z0-9])"))


def redacted(docs: DataFrame, scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``scanned`` replaced in its text, wherever it stands as a whole; n_chars follows.

    A row's secrets are those found in it (rows of the same id and text are the
    same).  Texts that can't have any stay where they are; columns of any name
    stay as they are.
    """
    n = "n_chars" if "n_chars" in docs.columns else None
    of, values = (free_name(docs, name) for name in ("secret of", "secret values"))
    secrets = scanned.filter("is_secret").groupBy(F.col("row_key").alias(of)).agg(F.collect_set("value").alias(values))
    longest_first = F.transform(F.sort_array(F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    mark = mark.replace("\\", "\\\\").replace("$", "\\$")
    text = F.aggregate(longest_first, F.col("text"), lambda t, v: F.regexp_replace(t, _whole(v), F.lit(mark)))
    looked = docs.filter(_may_have()).withColumn(of, row_key()).join(secrets, of, "left")
    found = F.col(values).isNotNull()
    out = looked.withColumn("text", F.when(found, text).otherwise(F.col("text")))
    if n:
        out = out.withColumn(n, F.when(found, F.length("text").cast(dict(docs.dtypes)[n])).otherwise(F.col(n)))
    return out.select(*docs.columns).unionByName(docs.filter(~_may_have()))
