"""A sink with a commit: numbered manifests name the files that count, and a version is published once.

Tasks write parts under names of their own and report them; the driver publishes
a manifest that names the parts of all tasks that ended well.  Readers follow
the newest manifest, so they see a whole version or the one before it, and a
writer that read an older version than the newest can't publish over it.
"""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from dataclasses import dataclass

from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows that a task turns to text at a time; tries of a change that others keep getting ahead of.
ROWS, TRIES = 1_024, 50


class Conflict(Exception):
    """Somebody published the version first."""


def _at(path: str):
    return store.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (store.LocalFileSystem(), path)


def latest(root: str) -> tuple[int, dict | None]:
    """Number and content of the newest version under ``root``; (0, None) if there is none."""
    files, where = _at(root)
    found = files.get_file_info(store.FileSelector(where, allow_not_found=True))
    numbers = sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())
    if not numbers:
        return 0, None
    with files.open_input_stream(f"{where}/{numbers[-1]:010d}.json") as f:
        return numbers[-1], json.loads(f.read().decode("utf-8"))


def publish(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Version ``number`` of ``root``, whole or not at all; ``Conflict`` if it's there already.

    The file is written beside its place and put there by one step that fails
    where a file stands: a hard link on a local disk, a rename without
    overwriting elsewhere (atomic on HDFS).
    """
    files, where = _at(root)
    files.create_dir(where, recursive=True)
    new, place = f"{where}/new-{uuid.uuid4().hex}", f"{where}/{number:010d}.json"
    with files.open_output_stream(new) as f:
        f.write(json.dumps(content, ensure_ascii=False).encode("utf-8"))
    try:
        if isinstance(files, store.LocalFileSystem):
            os.link(new, place)
        else:
            jvm, name = spark._jvm, root.rstrip("/")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(name), spark._jsc.hadoopConfiguration())
            P = jvm.org.apache.hadoop.fs.Path
            context.rename(P(f"{name}/{new.rsplit('/', 1)[1]}"), P(f"{name}/{number:010d}.json"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except FileExistsError as e:
        raise Conflict(f"{root} has a version {number}") from e
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{root} has a version {number}") from e
        raise
    finally:
        if files.get_file_info(new).type != store.FileType.NotFound:
            files.delete_file(new)


def change(spark: SparkSession, root: str, make) -> dict:
    """Publishes ``make(content)`` as the next version; where others were first, of what they published."""
    for _ in range(TRIES):
        number, content = latest(root)
        new = make(content)
        try:
            publish(spark, root, number + 1, new)
            return new
        except Conflict:
            continue
    raise Conflict(f"{root} changed {TRIES} times meanwhile")


# ------------------------------------------------------------------ pairs of JSON and CSV parts


@dataclass
class Part(WriterCommitMessage):
    json: str
    csv: str
    rows: int


class PairWriter(DataSourceArrowWriter):
    """Each task writes its rows as a JSON part and, without nested columns, as a CSV part."""

    def __init__(self, path: str, token: str, flat: list[str]):
        self.path, self.token, self.flat = path, token, flat

    def write(self, iterator):
        files, where = _at(self.path)
        name = f"data/{self.token}/{uuid.uuid4().hex}"
        files.create_dir(f"{where}/data/{self.token}", recursive=True)
        rows = 0
        with files.open_output_stream(f"{where}/{name}.json") as lines, files.open_output_stream(f"{where}/{name}.csv") as table:
            table.write((",".join(self.flat) + "\n").encode("utf-8"))
            for batch in iterator:
                for a in range(0, len(batch), ROWS):
                    part = batch.slice(a, ROWS).to_pylist()
                    lines.write("".join(json.dumps(_bare(r), ensure_ascii=False, default=str) + "\n" for r in part).encode("utf-8"))
                    text = io.StringIO()
                    csv.writer(text, lineterminator="\n").writerows([r[c] for c in self.flat] for r in part)
                    table.write(text.getvalue().encode("utf-8"))
                    rows += len(part)
        return Part(f"{name}.json", f"{name}.csv", rows)

    def commit(self, messages):
        """The list of parts, not published yet."""
        files, where = _at(self.path)
        files.create_dir(f"{where}/staged", recursive=True)
        parts = [{"json": m.json, "csv": m.csv, "rows": m.rows} for m in messages if m is not None and m.rows]
        with files.open_output_stream(f"{where}/staged/{self.token}.json") as f:
            f.write(json.dumps(parts).encode("utf-8"))

    def abort(self, messages):
        files, where = _at(self.path)
        for m in messages:
            for name in (m.json, m.csv) if m is not None else ():
                if files.get_file_info(f"{where}/{name}").type != store.FileType.NotFound:
                    files.delete_file(f"{where}/{name}")


def _bare(value):
    """Without empty fields, as Spark writes JSON."""
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in value.items() if v is not None}
    return [_bare(v) for v in value] if isinstance(value, list) else value


class PairSink(DataSource):
    """``export_pair``: options path, token."""

    @classmethod
    def name(cls):
        return "export_pair"

    def writer(self, schema, overwrite):
        flat = [f.name for f in schema.fields if f.dataType.typeName() not in ("array", "struct", "map")]
        return PairWriter(self.options["path"], self.options["token"], flat)


def stage_pair(rows: DataFrame, path: str) -> list[dict]:
    """Writes ``rows`` as parts that no manifest names yet; returns them."""
    spark, token = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(PairSink)
    rows.write.format("export_pair").option("path", path).option("token", token).mode("append").save()
    files, where = _at(path)
    with files.open_input_stream(f"{where}/staged/{token}.json") as f:
        parts = json.loads(f.read().decode("utf-8"))
    files.delete_file(f"{where}/staged/{token}.json")
    return parts


def read_pair(spark: SparkSession, path: str, kind: str = "json", schema=None, parts: list[dict] | None = None) -> DataFrame | None:
    """The newest version's rows from its JSON or its CSV parts; None if there is none and no schema.

    ``parts`` reads those of another version.
    """
    if parts is None:
        found = latest(f"{path}/_manifest")[1]
        parts = found["parts"] if found else []
    names = [f"{path}/{p[kind]}" for p in parts]
    if not names:
        return spark.createDataFrame([], schema) if schema is not None else None
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.json(names) if kind == "json" else r.option("header", True).option("multiLine", True).option("escape", '"').csv(names)
