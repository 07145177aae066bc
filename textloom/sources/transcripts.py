"""Readers and parsers of transcripts, threads and dataset files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as X

from textloom.functions import text as T
from textloom.functions.text import WS

TURN = X.StructType([X.StructField(n, t) for n, t in (("speaker_name", X.StringType()), ("speaker_id", X.StringType()), ("speaker_role", X.StringType()), ("depth", X.IntegerType()), ("timestamp", X.StringType()), ("content", X.StringType()))])
ITEM = X.StructType(
    [X.StructField(n, X.StringType()) for n in ("item_id", "group_name", "person_name", "person_title", "person_id", "item_title", "source_url", "publish_date", "view_count", "like_count", "source_name", "transcript_text")]
    + [X.StructField("duration_secs", X.DoubleType()), X.StructField("turns", X.ArrayType(TURN))]
)

#: Beginnings of a stripped line in the two transcript formats, and what ends a line.
STAMPED = r"\A(\d{1,2}:\d{2}:\d{2})[" + WS + r"]*(.*)\z"
LABELLED = r"\A\*{0,2}([A-Za-z][\p{L}\p{N}_ .'\-]{0,39}?)\*{0,2}[" + WS + r"]*:\*{0,2}[" + WS + r"]*(.*)\z"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """A dataset file: a JSON array of item objects; broken files fail, unknown keys are ignored."""
    return spark.read.schema(ITEM).option("multiLine", True).option("mode", "FAILFAST").json(path)


def missing_ids(items: DataFrame) -> DataFrame:
    """Items that break the contract: no item id."""
    return items.filter(F.col("item_id").isNull())


def read_threads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, one object a line; a broken line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def split_lines(text) -> Column:
    """The lines of a text; a line end at its very end begins no further line."""
    lines = F.split(text, LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def _paragraphs(content: bytes) -> list[str]:
    """Texts of the paragraphs of a .docx file's body, in order; tabs and breaks are kept as such."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(w + "body")
    sign = {w + "tab": "\t", w + "br": "\n", w + "cr": "\n"}
    out = []
    for p in body.findall(w + "p"):
        runs = [r for child in p for r in ([child] if child.tag == w + "r" else child.findall(w + "r") if child.tag == w + "hyperlink" else [])]
        out.append("".join(x.text or "" if x.tag == w + "t" else sign.get(x.tag, "") for r in runs for x in r))
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, line_no, line) of .txt and .docx files (lines, or paragraphs), named by their paths; other files are left out."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("item_id"), "content")
    docx = F.lower("item_id").endswith(".docx")

    def paragraphs(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"item_id": batch.column(0), "lines": pa.array([_paragraphs(c.as_py()) for c in batch.column(1)], pa.list_(pa.string()))})

    words = files.filter(docx).mapInArrow(paragraphs, "item_id string, lines array<string>")
    plain = files.filter(F.lower("item_id").endswith(".txt")).select("item_id", split_lines(F.decode("content", "UTF-8")).alias("lines"))
    return words.unionByName(plain).select("item_id", F.posexplode("lines").alias("line_no", "line"))


def _in_order() -> Window:
    return Window.partitionBy("item_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _texts(d: DataFrame, speaker: Column, timestamp: Column) -> DataFrame:
    """Turns of lines numbered by ``turn``: the first line's speaker and timestamp, and the lines' texts that aren't empty."""
    said = F.transform(F.sort_array(F.collect_list(F.when(F.col("said") != "", F.struct("line_no", "said")))), lambda x: x["said"])
    g = d.filter("turn > 0").groupBy("item_id", "turn").agg(F.min_by(F.struct(speaker.alias("s"), timestamp.alias("t")), "line_no").alias("first"), F.array_join(said, " ").alias("content"))
    return g.filter("content <> ''").select("item_id", (F.col("turn") - 1).cast("long").alias("turn_index"), F.col("first.s").alias("speaker_name"), F.col("first.t").alias("timestamp"), "content")


def stamped_turns(lines: DataFrame) -> DataFrame:
    """Turns of lines that begin with H:MM:SS and a label; other lines go on the turn before, preamble goes.

    Header lines are numbered by a running count inside each item, so the parse is one sort and one group.
    """
    d = lines.select("item_id", "line_no", T.strip("line").alias("line"))
    head = F.col("line").rlike(STAMPED)
    d = d.withColumn("head", head).withColumn("turn", F.sum(F.col("head").cast("int")).over(_in_order()))
    d = d.withColumn("said", F.when(F.col("head"), "").otherwise(F.col("line")))
    label = T.strip(F.regexp_extract("line", STAMPED, 2))
    return _texts(d, F.nullif(label, F.lit("")), F.regexp_extract("line", STAMPED, 1))


def labelled_turns(lines: DataFrame, least: int = 2, most_words: int = 5) -> DataFrame:
    """Turns of ``Name: text`` lines; a label counts if seen ``least`` times, and an item needs two such labels.

    A line with another label goes on the turn before, without that label.
    """
    d = lines.select("item_id", "line_no", T.strip("line").alias("line")).filter("line <> ''")
    label = T.strip(F.regexp_extract("line", LABELLED, 1))
    d = d.withColumn("label", F.when((label != "") & (T.word_count(label) <= most_words), label))
    d = d.withColumn("said", F.when(F.col("label").isNotNull(), T.strip(F.regexp_extract("line", LABELLED, 2))).otherwise(F.col("line")))
    known = d.filter("label is not null").groupBy("item_id", "label").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    # One row an item with its labels; an item without two has no turns.
    known = known.groupBy("item_id").agg(F.collect_list("label").alias("known")).filter("size(known) >= 2")
    d = d.join(known, "item_id").withColumn("head", F.coalesce(F.array_contains("known", F.col("label")), F.lit(False)))
    d = d.withColumn("turn", F.sum(F.col("head").cast("int")).over(_in_order()))
    return _texts(d, F.col("label"), F.lit(None).cast("string"))


def transcript_turns(lines: DataFrame) -> DataFrame:
    """Turns of each item in the first format that fits, with its name: timestamped, else labeled; items of neither have none."""
    first = stamped_turns(lines).withColumn("format", F.lit("timestamped"))
    other = labelled_turns(lines).withColumn("format", F.lit("labeled"))
    return first.unionByName(other.join(first.select("item_id").distinct(), "item_id", "left_anti"))


def _runs(turns: DataFrame, *order: str) -> DataFrame:
    """Neighbours of one speaker joined (null equals null): item_id, turn_index (the first one's), speaker_name, content, and what else the first has."""
    w = Window.partitionBy("item_id").orderBy(*order)
    new = (F.row_number().over(w) == 1) | ~F.col("speaker_name").eqNullSafe(F.lag("speaker_name").over(w))
    d = turns.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = [c for c in turns.columns if c not in ("item_id", "content", *order)]
    at = F.struct(*order)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("at"), "content"))), lambda x: x["content"]), " ")
    g = d.groupBy("item_id", "run").agg(F.min_by(F.struct(*order, *rest), at).alias("first"), text.alias("content"))
    return g.select("item_id", "first.*", "content")


def bridge_backchannels(turns: DataFrame, most_words: int = 8) -> DataFrame:
    """Turns (item_id, turn_index, speaker_name, content and more) with interjections behind the speech they interrupt.

    Empty turns go, and neighbours of one speaker are one block.  A run of short
    blocks that ask nothing, between a block and one more of its speaker, goes
    behind the two, which join; so no speaker has two turns in a row.

    Whether a long block joins what stands before depends on whether the one
    before did: then a run's last short block is what stands there.  That
    chain, of "yes", "no", "as before" and "other than before", is solved by
    running counts, so an item's turns are sorted but never folded in Python.
    """
    others = [c for c in turns.columns if c not in ("item_id", "turn_index", "speaker_name", "content")]
    blocks = _runs(turns.withColumn("content", T.strip(F.coalesce("content", F.lit("")))).filter("content <> ''"), "turn_index")
    short = (T.word_count("content") <= most_words) & ~F.col("content").endswith("?")
    w = Window.partitionBy("item_id").orderBy("turn_index")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = blocks.withColumn("long", ~short).withColumn("g", F.sum(F.col("long").cast("int")).over(upto))
    # A group is a long block and the run of short ones behind it; group 0 is what comes before the first.
    who = lambda cond, pick: pick(F.when(cond, F.struct("turn_index", "speaker_name")))
    g = b.groupBy("item_id", "g").agg(who(F.col("long"), F.max).alias("lead"), who(~F.col("long"), F.max).alias("last"))
    by = Window.partitionBy("item_id").orderBy("g")
    g = g.filter("g > 0").withColumn("next", F.lead("lead").over(by)).withColumn("before", F.when(F.lag("g").over(by) > 0, F.lag("last").over(by)))
    bridges = F.col("last").isNotNull() & F.col("next").isNotNull()
    free = bridges & F.col("lead.speaker_name").eqNullSafe(F.col("next.speaker_name"))
    taken = bridges & F.col("before").isNotNull() & F.col("before.speaker_name").eqNullSafe(F.col("next.speaker_name"))
    g = g.withColumns({"free": free, "taken": taken})
    to_now = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Of a group: does its run take the next long block, if its own long block was taken by the run before, and if not?
    g = g.withColumn("turns", F.sum((F.col("free") & ~F.col("taken")).cast("int")).over(to_now)).withColumn("sure", F.when(F.col("free") == F.col("taken"), F.struct("free", "turns")))
    sure = F.last("sure", ignorenulls=True).over(to_now)
    odd = lambda n: n % 2 == 1
    g = g.withColumn("takes", F.when(sure.isNull(), odd(F.col("turns"))).otherwise(sure["free"] != odd(F.col("turns") - sure["turns"])))
    g = g.withColumn("is_taken", F.coalesce(F.lag("takes").over(by), F.lit(False)))
    # A taken block's text goes behind that of the long block before, or of the run's last short block where that long block is taken itself.
    joins = g.filter("takes").select("item_id", F.when(F.col("is_taken"), F.col("before.turn_index")).otherwise(F.col("lead.turn_index")).alias("turn_index"), F.col("next.turn_index").alias("from"))
    moved = b.join(joins.select("item_id", F.col("from").alias("turn_index"), F.col("turn_index").alias("to")), ["item_id", "turn_index"], "left")
    added = moved.filter("to is not null").select("item_id", F.col("to").alias("turn_index"), F.col("content").alias("more"))
    kept = moved.filter("to is null").select("item_id", "turn_index", "speaker_name", *others, "content").join(added, ["item_id", "turn_index"], "left")
    kept = kept.withColumn("content", F.concat_ws(" ", "content", "more")).drop("more")
    out = _runs(kept, "turn_index")
    index = F.row_number().over(w) - 1
    return out.withColumn("turn_index", index.cast("long")).select("item_id", "turn_index", "speaker_name", *others, "content")


def assign_roles(turns: DataFrame, roles: dict[str, str], unlabelled: str = "other") -> DataFrame:
    """A role a turn: by its label, ``other`` for labels without one, ``unlabelled`` for turns without a label."""
    known = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)) if roles else F.create_map().cast("map<string,string>")
    role = F.coalesce(F.element_at(known, F.col("speaker_name")), F.lit("other"))
    return turns.withColumn("speaker_role", F.when(F.col("speaker_name").isNull(), unlabelled).otherwise(role))


def transcript_records(turns: DataFrame, about: DataFrame) -> DataFrame:
    """Canonical items of role-assigned turns (item_id, turn_index, speaker_name, speaker_role, timestamp, content).

    ``about``: item_id with group_name, person_name, person_title, item_title
    and publish_date, and ``record_id``, which may be null: then the id is made
    from the names.  Turns of unnamed speakers are "Unknown".
    """
    name = F.coalesce(F.nullif("speaker_name", F.lit("")), F.lit("Unknown"))
    none = lambda t: F.lit(None).cast(t)
    turn = F.struct(name.alias("speaker_name"), none("string").alias("speaker_id"), "speaker_role", F.lit(0).alias("depth"), "timestamp", "content")
    t = turns.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn_index", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    d = about.join(t, "item_id")
    line = lambda x: F.concat(F.lit("["), x["speaker_name"], F.lit("] "), T.strip(x["content"]))
    text = F.array_join(F.transform(F.filter("turns", lambda x: x["content"] != ""), line), "\n")
    made = T.item_key(*(F.col(c) for c in ("group_name", "person_name", "item_title", "publish_date")))
    own = {"item_id": F.coalesce(F.nullif(F.col("record_id").cast("string"), F.lit("")), made), "transcript_text": text}
    empty = {"person_id": "string", "source_url": "string", "duration_secs": "double", "view_count": "string", "like_count": "string", "source_name": "string"}
    return d.withColumns(own | {c: none(k) for c, k in empty.items()}).select(*(f.name for f in ITEM.fields))


def renamed(records: DataFrame, names: dict[str, str], id_field: str = "item_id") -> DataFrame:
    """Old field names to new ones, the id as string; a table that has the new names is left as it is."""
    todo = {a: b for a, b in names.items() if a in records.columns and b not in records.columns}
    d = records.withColumnsRenamed(todo)
    return d.withColumn(id_field, F.col(id_field).cast("string")) if id_field in d.columns else d


def write_pair(items: DataFrame, path: str) -> None:
    """The dataset as JSON lines and, without the nested turns, as CSV with a header."""
    items.write.mode("overwrite").json(f"{path}/json")
    items.drop("turns").write.mode("overwrite").option("header", True).csv(f"{path}/csv")
