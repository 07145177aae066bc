"""Dataset files and their registry, turn and label files, seed packs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as X

from textloom.functions import text as T
from textloom.sources.committed import TRIES, Conflict, change, latest, publish, read_pair, stage_pair

REGISTRY = "id string, label string, kind string, source_id string, created_at string, count long, json_file string, csv_file string"
EXPORTED = ["group_name", "person_name", "person_title", "person_id", "item_id", "item_title", "source_url", "publish_date", "duration_secs", "view_count", "like_count", "source_name", "transcript_text", "turns"]
LABEL_COLUMNS = ("segment_id", "item_id", "theme_id", "label", "label_source", "item_read_in_full_status", "inferred_by_coverage")


def load_registry(spark: SparkSession, root: str) -> DataFrame:
    """The registered datasets; a missing registry is an empty one."""
    return _entries(spark, latest(f"{root}/_index")[1])


def _entries(spark: SparkSession, content: dict | None) -> DataFrame:
    names = [f.name for f in X._parse_datatype_string(REGISTRY).fields]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in (content or {}).get("datasets", []) if e.get("id") is not None], REGISTRY)


def save_registry(entries: DataFrame, root: str) -> None:
    """``entries`` in the place of all registered ones."""
    rows = [r.asDict() for r in entries.collect()]  # a row a dataset
    change(entries.sparkSession, f"{root}/_index", lambda _: {"datasets": rows})


def write_export(items: DataFrame, path: str) -> None:
    """A dataset as JSON lines and, without its nested turns, as CSV with fixed fields; both appear at once, in one version."""
    spark = items.sparkSession
    parts = stage_pair(_exported(items), path)
    change(spark, f"{path}/_manifest", lambda _: {"parts": parts})


def _exported(items: DataFrame) -> DataFrame:
    return items.select(*(F.col(c) if c in items.columns else F.lit(None).cast("string").alias(c) for c in EXPORTED))


def read_export(spark: SparkSession, path: str, kind: str = "json", schema=None) -> DataFrame | None:
    """The newest version of an exported dataset, from its JSON or its CSV files."""
    return read_pair(spark, path, kind, schema)


def register(spark: SparkSession, root: str, **entry) -> None:
    """One more registered dataset; entries that others make meanwhile stay."""
    names = [f.name for f in X._parse_datatype_string(REGISTRY).fields]
    row = {n: entry.get(n) for n in names}
    change(spark, f"{root}/_index", lambda now: {"datasets": [*(now or {}).get("datasets", []), row]})


def append_dataset(spark: SparkSession, root: str, dataset_id: str, more: DataFrame, noun: str = "interview(s)") -> None:
    """More items in a registered dataset; ids that it has already are refused, and its count and label follow.

    Only the new items are written; the dataset's next version names the old
    files and the new ones.  If another version came meanwhile, the ids are
    checked again with that one.
    """
    entry = load_registry(spark, root).filter(F.col("id") == dataset_id).first()
    if entry is None:
        raise KeyError(f"no registered dataset {dataset_id}")
    path, parts = f"{root}/{entry.json_file}", None
    for _ in range(TRIES):
        number, found = latest(f"{path}/_manifest")
        old = (found or {}).get("parts", [])
        have = read_pair(spark, path, "json", "item_id string", old)
        both = have.join(more.select("item_id").distinct(), "item_id", "left_semi").select("item_id").limit(5).collect()
        if both:
            raise ValueError(f"item ids that stand already: {sorted(r.item_id for r in both)}")
        parts = stage_pair(_exported(more), path) if parts is None else parts
        try:
            publish(spark, f"{path}/_manifest", number + 1, {"parts": [*old, *parts]})
            break
        except Conflict:
            continue
    else:
        raise Conflict(f"{path} changed {TRIES} times meanwhile")

    def counted(now):
        # Whatever version is newest by now: the last of several writers counts all.
        n = sum(p["rows"] for p in latest(f"{path}/_manifest")[1]["parts"])
        out = []
        for e in now["datasets"]:
            label = re.sub(r"\s+—\s+\d+\s+\S+\(s\)$", "", e["label"] or "") + f" — {n} {noun}"
            out.append(e | {"count": n, "label": label} if e["id"] == dataset_id else e)
        return {"datasets": out}

    change(spark, f"{root}/_index", counted)


def read_turn_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Turn exports of several companies in spoken order; headers name the columns, and comment ids stay text."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(list(paths))
    first = d.columns[0]
    d = d.withColumnRenamed(first, first.lstrip("\ufeff"))
    return d.withColumns({c: F.col(c).cast("long") for c in ("interview_id", "turn_id", "word_count") if c in d.columns}).orderBy("interview_id", "turn_id")


def write_turn_files(turns: DataFrame, path: str) -> None:
    """Turns as CSV, a folder for each company and one for all; every file begins with a byte-order mark, for spreadsheets."""
    spark = turns.sparkSession

    def mark(d, where):
        head = F.concat(F.lit("\ufeff"), F.lit(",".join(d.columns)))
        cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
        line = F.concat_ws(",", *(cell(c) for c in d.columns))
        key = [c for c in ("interview_id", "turn_id") if c in d.columns]
        top = spark.range(1).select(F.lit(0).alias("part"), *(F.lit(None).cast(dict(d.dtypes)[c]).alias(c) for c in key), head.alias("value"))
        d.select(F.lit(1).alias("part"), *key, line.alias("value")).unionByName(top).orderBy("part", *key).coalesce(1).select("value").write.mode("overwrite").text(where)

    mark(turns, f"{path}/all")
    for r in turns.select("company").distinct().orderBy("company").collect():  # a file a company is the feature
        mark(turns.filter(F.col("company") == r.company), f"{path}/{r.company}")


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    """A labels file as text columns; missing columns and labels other than pos and neg are errors."""
    d = spark.read.option("header", True).option("escape", '"').csv(path)
    first = d.columns[0]
    d = d.withColumnRenamed(first, first.lstrip("\ufeff")).na.fill("")
    missing = sorted(set(LABEL_COLUMNS) - set(d.columns))
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    bad = [r[0] for r in d.filter("label not in ('pos', 'neg')").select("label").distinct().limit(5).collect()]
    if bad:
        raise ValueError(f"{path}: unexpected labels {sorted(bad)}")
    return d


def read_codebook(spark: SparkSession, path: str, known: list[str] | None = None) -> tuple[str, dict]:
    """(kind, document) of a codebook file: an app's export by its ``format`` key, else a seed pack; unknown versions and topics are errors."""
    text = spark.read.text(path, wholetext=True).first()[0]
    d = json.loads(text)
    kind = "seed_pack"
    if isinstance(d, dict) and "format" in d:
        if d["format"] != "codebook_topics" or d.get("format_version") != 1:
            raise ValueError(f"{path}: unknown format {d['format']} {d.get('format_version')}")
        kind = "codebook"
    topics = d["topics"] if isinstance(d, dict) else d
    if known is not None:
        odd = [t["topic_id"] for t in topics if t["topic_id"] not in known]
        if odd:
            raise ValueError(f"{path} has topics that nothing scores: {odd}")
    return kind, d


def write_stage(outputs: dict[str, DataFrame], path: str, title: str) -> str:
    """A stage's tables as Parquet and a Markdown report of their rows; returns the report."""
    lines = [f"# {title}", ""]
    for name, d in outputs.items():
        d.write.mode("overwrite").parquet(f"{path}/{name}")
        lines.append(f"* {name}: {d.sparkSession.read.parquet(f'{path}/{name}').count()} rows, columns {', '.join(d.columns)}")
    report = "\n".join(lines) + "\n"
    spark = next(iter(outputs.values())).sparkSession
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return report


def parse_json_lines(texts: DataFrame) -> DataFrame:
    """(path, line_no, value) of the lines that aren't blank; a line that is no JSON object is an error."""
    from textloom.sources.transcripts import split_lines

    d = texts.select("path", F.posexplode(split_lines(F.col("value"))).alias("line_no", "value")).withColumn("value", T.strip("value")).filter("value <> ''")
    ok = F.get_json_object("value", "$").isNotNull() & F.col("value").startswith("{")
    return d.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no JSON object in line "), (F.col("line_no") + 1).cast("string"))).cast("string")))
