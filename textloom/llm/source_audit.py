"""Source divergence audit: how far each source's words are from its neighbours' and its language's.

Terms are counted by (lang, source, term); a language keeps those in at least
``LEAST_DOCS`` of its documents.  Every group gives every kept term an integer
share p, and two shares differ by f = (p - q)**2 div q.

*Pairs of sources.*  Most terms are in neither or in one of two sources, where
a share is the group's baseline.  So the sum over all kept terms is taken
sparsely: all terms at both baselines, corrections from each source's histogram
of shares, and a correction for each term that both have.  Those come from the
terms' posting lists, in tiles, summed by pair in the tasks.

*Terms of a source.*  The first ``TOP`` by value are found by radix selection:
histograms over the value's bits, from the top, find each group's threshold
digit by digit; ties at the last one refine by bytes of the term.  No group is
sorted but the rows that are returned.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, saved, slices, strings

LEAST_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: Distinct (group, term) entries that a task holds before it hands them on.
ENTRIES = 400_000
#: A document in the upper bits of a task's count.
ONE = 1 << 40
#: Sources of one tile of a term's posting list, and of one matrix of pair sums.
TILE, PAIRED = 256, 1_024
#: Bits of a digit of a value, digits of a value, bytes of a digit of a term.
BITS, DIGITS, BYTES = 16, 4, 2
#: Parts over which the sources of one language are spread before they meet.
SPREAD = 32
#: A-Z in lower case, a-z and all bytes from 0x80 kept, the rest a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GROUP = ["lang", "source"]


def terms_of(text: str | None) -> list[bytes]:
    """Runs of letters A-Z, a-z and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _count(batches):
    """(lang, source, term, occurrences, documents) over a task's rows."""
    groups: dict = {}
    size = 0

    def rows():
        out = ([], [], [], [], [])
        for (lang, source), seen in groups.items():
            k = len(seen)
            values = list(seen.values())
            for column, more in zip(out, ([lang] * k, [source] * k, seen, [v & ONE - 1 for v in values], [v >> 40 for v in values])):
                column.extend(more)
        text = [pa.array(c, pa.string()) for c in out[:2]]
        return pa.RecordBatch.from_arrays([*text, pa.array(out[2], pa.binary()).cast(pa.string()), *(pa.array(c, pa.int64()) for c in out[3:])], names=["lang", "source", "term", "n", "docs"])

    for batch in slices(batches):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2))):
            seen = groups.setdefault((lang, source), {})
            size -= len(seen)
            for term, n in Counter(terms_of(text)).items():
                seen[term] = seen.get(term, 0) + n + ONE
            size += len(seen)
            if size > ENTRIES:
                yield rows()
                groups, size = {}, 0
    if groups:
        yield rows()


def postings(docs: DataFrame) -> DataFrame:
    """(lang, term, lang_n, found) of every kept term; ``found`` has (source, seen) of each source that has it.

    Tasks count their own rows first; a term's counts then meet once, and all
    that follows for it happens where they are.
    """
    counted = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = F.collect_list(F.struct("source", F.col("n").alias("seen"))).alias("found")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), found).filter(F.col("docs") >= LEAST_DOCS).drop("docs")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + kept)), in decimals, as n may be of any size; 1 where no term is kept."""
    up = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.when(kept > 0, F.lit(1) + _div(up, (total + kept).cast("decimal(20,0)"))).otherwise(F.lit(1)).cast("long")


def _distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _meet(batches):
    """For each two sources of a term, what both having it changes in their sum; added up over a task's terms."""
    index: dict = {}
    total = np.zeros((PAIRED, PAIRED), np.int64)

    def rows():
        a, b = np.nonzero(total)
        names = list(index)
        a, b = a[a != b].tolist(), b[a != b].tolist()
        text = [pa.array(c, pa.string()) for c in ([names[i][0] for i in a], [names[i][1] for i in a], [names[i][1] for i in b])]
        return pa.RecordBatch.from_arrays([*text, pa.array(total[a, b], pa.int64())], names=["lang", "source", "item", "v"])

    def f(p, q):
        return (p - q) ** 2 // q

    for batch in slices(batches):
        shares = [[np.array(v, np.int64) for v in strings(c)] for c in batch.columns[2:]]
        for lang, sources, p, base in zip(batch.column(0).to_pylist(), strings(batch.column(1)), *shares):
            tiles = [slice(a, a + TILE) for a in range(0, len(sources), TILE)]
            for s in tiles:
                for t in tiles:
                    if len(index) + 2 * TILE > PAIRED:
                        yield rows()
                        index.clear()
                        total[:] = 0
                    i, j = ([index.setdefault((lang, x), len(index)) for x in sources[y]] for y in (s, t))
                    p1, p0, q1, q0 = p[s][:, None], base[s][:, None], p[t][None], base[t][None]
                    total[np.ix_(i, j)] += f(p1, q1) - f(p1, q0) - f(p0, q1) + f(p0, q0)
    if index:
        yield rows()


def pair_values(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language: the sum of f over all kept terms."""
    spread = F.pmod(F.xxhash64("source"), F.lit(SPREAD)).cast("int")
    mine = groups.select(*_GROUP, "kept", "base", spread.alias("part"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("base2"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    both = mine.join(other, ["lang", "part"]).filter("source <> item")
    zero = _distance(F.col("base"), F.col("base2"))
    shares = scored.groupBy(*_GROUP, "p").agg(F.count("*").alias("k")).groupBy(*_GROUP).agg(F.collect_list(F.struct("p", "k")).alias("shares"))

    def moved(of):
        return F.coalesce(F.aggregate("shares", F.lit(0).cast("long"), lambda a, x: a + x["k"] * (of(x["p"]) - zero)), F.lit(0).cast("long"))

    both = both.join(shares, _GROUP, "left").select("lang", "source", "item", "kept", "base", "base2", moved(lambda p: _distance(p, F.col("base2"))).alias("a"))
    both = both.join(shares.withColumnRenamed("source", "item"), ["lang", "item"], "left").withColumn("b", moved(lambda q: _distance(F.col("base"), q)))
    lists = scored.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("x")).filter(F.size("x") > 1)
    met = lists.select("lang", "x.source", "x.p", "x.base").mapInArrow(_meet, "lang string, source string, item string, v long")
    met = met.groupBy("lang", "source", "item").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("c"))
    value = (F.col("kept") * zero + F.col("a") + F.col("b")).cast("decimal(38,0)") + F.coalesce(F.col("c"), F.lit(0).cast("decimal(38,0)"))
    return both.join(met, ["lang", "source", "item"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def _digit(step: int) -> Column:
    """Digit ``step`` of the order (value descending, bytes of the item ascending), as text in that order."""
    if step < DIGITS:
        top = (1 << BITS) - 1
        bits = F.shiftright("value", BITS * (DIGITS - 1 - step)).bitwiseAND(F.lit(top))
        return F.lpad(F.hex(F.lit(top) - bits), BITS // 4, "0")
    bytes_ = F.substring(F.encode("item", "utf-8"), BYTES * (step - DIGITS) + 1, BYTES)
    return F.rpad(F.hex(bytes_), 2 * BYTES, " ")  # an item that ends comes first


def first_rows(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of every (lang, source) by value descending, item ascending, ranked.

    ``rows`` has lang, source, item, value (0 or more), each item once a group;
    it should be a written table.  Digit by digit, histograms by group give the
    digit that the last wanted row has; smaller ones are in, larger ones out,
    and equal ones go on.
    """
    left, taken = rows.withColumn("need", F.lit(top).cast("long")), []
    step = 0
    while True:
        left = left.withColumn("digit", _digit(step))
        sums = Window.partitionBy(*_GROUP).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counted = left.groupBy(*_GROUP, "digit").agg(F.count("*").alias("c"), F.min("need").alias("need"))
        upto = counted.withColumn("upto", F.sum("c").over(sums))  # a row for each digit that occurs
        inside = F.col("upto") - F.col("c") < F.col("need")
        bound = saved(
            upto.groupBy(*_GROUP).agg(
                F.max(F.when(inside, F.col("digit"))).alias("last"),
                (F.max(F.when(inside, F.col("upto"))) <= F.min("need")).alias("done"),
                (F.min("need") - F.max(F.when(inside, F.col("upto") - F.col("c")))).alias("then"),
                F.sum("c").alias("n"),
            )
        )
        total = bound.agg(F.sum("n")).first()[0]
        if not total:
            break
        found = saved(join_hot(left.drop("need"), bound, _GROUP, total).filter("digit <= last"))
        taken.append(found.filter("digit < last or done").select(*_GROUP, "item", "value"))
        left = found.filter("digit = last and not done").select(*_GROUP, "item", "value", F.col("then").alias("need"))
        step += 1
        if bound.filter("not done").isEmpty():
            break
    out = taken[0] if taken else rows.select(*_GROUP, "item", "value")
    for t in taken[1:]:
        out = out.unionByName(t)
    return _ranked(out)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Divergence of every (lang, source) group from the other sources of its language, and its first terms.

    Returns lang, source, part (``pair`` or ``term``), item, value and rank.
    Null text, lang and source are empty strings; a row is a document, repeated
    rows too.  A group without kept terms still has its pairs (0 if its language
    keeps none) and no terms; a language of one source has no pairs.  Ties rank
    by the item's UTF-8 bytes.  A text of any length is read whole; an empty
    table gives no rows; other columns are ignored.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*_GROUP, "text")))
    kept = saved(postings(named))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    rows = kept.select("lang", "term", "lang_n", F.explode("found").alias("f")).select("lang", "term", "lang_n", "f.*")
    sizes = rows.groupBy(*_GROUP).agg(F.sum("seen").alias("total"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    groups = named.select(*_GROUP).distinct().join(sizes, _GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "n", "kept", "lang_total"])
    groups = saved(groups.withColumn("base", _share(zero, F.col("total"), F.col("kept"))))
    scored = saved(
        join_hot(rows, groups, _GROUP, kept.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]).select(
            *_GROUP, "term", "base", _share(F.col("seen"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")
        )
    )
    pairs = _ranked(pair_values(scored, groups))
    above = scored.filter("p > q").select(*_GROUP, F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    terms = first_rows(above, top).withColumn("part", F.lit("term"))
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.select(*columns))


def brute_force(rows: list[tuple], top: int = TOP) -> list[tuple]:
    """(lang, source, part, item, value, rank) of (text, lang, source) rows, every pair over every kept term."""
    docs, seen = {}, {}
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", [t.decode("utf-8", "surrogatepass") for t in terms_of(text)]
        docs.setdefault(lang, Counter()).update(set(terms))
        seen.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
    out = []
    for lang, sources in seen.items():
        kept = [t for t, n in docs[lang].items() if n >= LEAST_DOCS]

        def shares(counts):
            down = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + UNIT * (counts[t] + 1) // down for t in kept}

        p = {s: shares(c) for s, c in sources.items()}
        q = shares(sum(sources.values(), Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass")))
                out += [(lang, s, part, *x, r) for r, x in enumerate(found[: None if part == "pair" else top], 1)]
    return out


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for ``audit``."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{letters}', '{letters.lower()}') as t from {table}),
    w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
    k as (select lang, term, count(*) as lang_n from w group by lang, term having count(distinct r) >= {LEAST_DOCS}),
    g as (select distinct lang, source from d),
    n as (select lang, source, term, count(*) as n from w group by lang, source, term),
    c as (select lang, source, term, coalesce(n, 0) as n, lang_n, sum(coalesce(n, 0)) over s + count(*) over s as down, sum(lang_n) over s + count(*) over s as lang_down
          from g join k using (lang) left join n using (lang, source, term) window s as (partition by lang, source)),
    p as (select lang, source, term, n, (1 + {UNIT} * (n + 1)::hugeint // down)::bigint as p, (1 + {UNIT} * (lang_n + 1)::hugeint // lang_down)::bigint as q from c),
    v as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as v from p a join p b using (lang, term) where a.source <> b.source group by all),
    x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(v, 0)::bigint as value from g a join g b using (lang) left join v on v.lang = a.lang and v.source = a.source and v.item = b.source where a.source <> b.source
          union all select lang, source, 'term', term, (p - q) * (p - q) // q from p where n > 0 and p > q)
    select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from x
    qualify part = 'pair' or rank <= {TOP}"""
