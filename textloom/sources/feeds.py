"""Paged remote feeds as Spark data sources, with retry, and the downloads made of them."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from textloom.functions import text as T

#: Tries of a page, and the wait before the next, doubled each time.
TRIES, WAIT = 4, 1.0
PAGE = 500
ROW = "entity_id string, company_id string, item_id string, publish_date string, item string"


def get_page(url: str, key: str, endpoint: str, wait: float = WAIT, **params) -> dict:
    """One page of a JSON API; a server's error or a lost connection is tried again, four times in all."""
    if not url or not key:
        raise ValueError("a feed needs its url and key")
    where = f"{url.rstrip('/')}/api/{endpoint}/?{urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})}"
    for attempt in range(TRIES):
        try:
            with urllib.request.urlopen(urllib.request.Request(where, headers={"X-API-Key": key}), timeout=90) as r:
                return json.loads(r.read().decode("utf-8"))
        except urllib.error.HTTPError as e:
            if e.code < 500:
                raise
        except OSError:
            if attempt == TRIES - 1:
                raise
        time.sleep(wait * 2**attempt)
    raise RuntimeError(f"{endpoint} kept failing: {where}")


def search(kind: str, keyword: str, url: str, key: str, page_size: int = 25, wait: float = WAIT) -> list[dict]:
    """Companies or entities by keyword; one page."""
    if kind not in ("companies", "entities"):
        raise ValueError(f"can't search {kind}")
    return get_page(url, key, f"get_{kind}", wait, keyword=keyword, page_size=page_size).get("results", [])


class _Part(InputPartition):
    """A task's share: one entity (or company), items with ids in (above, upto], and publish dates in [after, before)."""

    def __init__(self, name: str, value: str, after: str | None = None, before: str | None = None, above: int | None = None, upto: int | None = None):
        self.name, self.value, self.after, self.before, self.above, self.upto = name, value, after, before, above, upto

    def has(self, item: dict) -> bool:
        day = str(item.get("publish_date") or "")[:10]
        return (not self.after or day >= self.after[:10]) and (not self.before or day < self.before[:10])


def date_ranges(after: str | None, before: str | None, days: int) -> list[tuple[str | None, str | None]]:
    """[after, before) cut every ``days`` days; a missing bound leaves its side open, in one range if both are missing.

    With an open end there is a range from the last cut on; items without a
    publish date are in ranges without a lower bound only.
    """
    if not after or not before or days <= 0:
        return [(after, before)]
    at, end, out = date.fromisoformat(after[:10]), date.fromisoformat(before[:10]), []
    while at < end:
        upto = min(end, at + timedelta(days=days))
        out.append((at.isoformat(), upto.isoformat()))
        at = upto
    return out


def _named(options) -> list[tuple[str, str]]:
    for name in ("entity_id", "company_id"):
        values = json.loads(options.get(name + "s", "[]"))
        if values:
            return [(name, str(v)) for v in values]
    raise ValueError("a feed needs entity_ids or company_ids")


def _page(options, part: _Part, last, size: int) -> dict:
    wait = float(options.get("wait", WAIT))
    return get_page(options.get("url"), options.get("key"), "get_feed", wait, page_size=size, filter_after_dt=part.after, filter_before_dt=part.before, before_feed_item_id=last, **{part.name: part.value})


def _items(options, part: _Part):
    """Rows of a part, newest first: pages follow the last id seen until there are no more, or the ids are below the part's."""
    last = None if part.upto is None else part.upto + 1
    while True:
        page = _page(options, part, last, int(options.get("pagesize", PAGE)))
        for item in page.get("results", []):
            if part.above is not None and int(item["id"]) <= part.above:
                return
            ids = {part.name: part.value}
            yield item, (ids.get("entity_id"), ids.get("company_id"), str(item["id"]) if item.get("id") is not None else None, item.get("publish_date"), json.dumps(item, ensure_ascii=False))
        last = page.get("last_seen_id")
        if not page.get("page_has_next") or last is None:
            return


class FeedReader(DataSourceReader):
    """A partition for each entity (or company), or with ``rangeDays`` for each of its date ranges."""

    def __init__(self, options: dict):
        self.o = options
        self.after, self.before = options.get("after"), options.get("before")

    def pushFilters(self, filters):
        """Bounds on publish_date go to the API; all filters are checked again by Spark."""
        for f in filters:
            if getattr(f, "attribute", None) == ("publish_date",):
                kind = type(f).__name__
                if kind in ("GreaterThan", "GreaterThanOrEqual"):
                    self.after = max(filter(None, (self.after, f.value)))
                elif kind in ("LessThan", "LessThanOrEqual"):
                    self.before = min(filter(None, (self.before, f.value)))
            yield f

    def partitions(self):
        days = int(self.o.get("rangedays", 0))
        if not days or not self.after:
            return [_Part(*n, self.after, self.before) for n in _named(self.o)]
        ranges = date_ranges(self.after, self.before or (date.today() + timedelta(days=1)).isoformat(), days)
        # The outer bounds stay the API's own; only the cuts between ranges are made here.
        return [_Part(*n, a, b) for n in _named(self.o) for a, b in ranges]

    def read(self, partition):
        cut = int(self.o.get("rangedays", 0)) > 0 and partition.after
        try:
            for item, row in _items(self.o, partition):
                if not cut or partition.has(item):
                    yield row
        except (OSError, RuntimeError):
            # One entity's failure doesn't end a bulk download when that's asked for.
            if str(self.o.get("skipfailures", "false")).lower() != "true":
                raise


class FeedStreamReader(DataSourceStreamReader):
    """The feed as a stream: the offset is, for each entity, the newest item id seen (and its date).

    A batch reads the items with ids above the old offset and up to the new
    one, so a batch that was cut short is read again in full from its
    checkpoint, and none is read twice by two batches.  An entity's first batch
    is its history, a task for each ``rangeDays`` days of it since ``after``;
    what is older is one more task, unless ``after`` bounds the stream.
    """

    def __init__(self, options: dict):
        self.o = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for name, value in _named(self.o):
            found = _page(self.o, _Part(name, value, self.o.get("after")), None, 1).get("results", [])
            if found:
                out[value] = {"id": int(found[0]["id"]), "date": str(found[0].get("publish_date") or "")[:10]}
        return out

    def partitions(self, start: dict, end: dict):
        after, days, out = self.o.get("after"), int(self.o.get("rangedays", 0)), []
        for name, value in _named(self.o):
            if value not in end:
                continue
            old, new = start.get(value), end[value]
            if old is None and days and after:
                # The last range is open, as an item with a smaller id may have a later date.
                ranges = date_ranges(after, new["date"] or after, days)
                out += [_Part(name, value, a, b, None, new["id"]) for a, b in ranges]
                out.append(_Part(name, value, max(after[:10], new["date"]), None, None, new["id"]))
            elif old is None:
                out.append(_Part(name, value, after, None, None, new["id"]))
            elif old["id"] < new["id"]:
                out.append(_Part(name, value, after, None, old["id"], new["id"]))
        return out

    def read(self, partition):
        for item, row in _items(self.o, partition):
            if partition.has(item):
                yield row

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """``feed``, as a table and as a stream: options url, key, entity_ids or company_ids (JSON lists), after, before
    (tables), rangeDays, pageSize, skipFailures (tables), wait."""

    @classmethod
    def name(cls):
        return "feed"

    def schema(self):
        return ROW

    def reader(self, schema):
        return FeedReader(self.options)

    def streamReader(self, schema):
        return FeedStreamReader(self.options)


def read_feed(spark: SparkSession, **options) -> DataFrame:
    """The feed's rows; bounds on publish_date are pushed to the API, which needs the session's switch for Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
    return spark.read.format("feed").options(**options).load()


def stream_feed(spark: SparkSession, **options) -> DataFrame:
    """The feed as a stream that goes on where its checkpoint is."""
    spark.dataSource.register(FeedSource)
    return spark.readStream.format("feed").options(**options).load()


def records(feed: DataFrame, company: str) -> DataFrame:
    """Feed items as canonical records; the newest of repeated ids stays."""
    turns = "array<struct<speaker_name:string,speaker_id:string,speaker_role:string,depth:int,timestamp:string,content:string>>"
    get = lambda k: F.get_json_object("item", f"$.{k}")
    d = feed.withColumn("turns", F.from_json(get("enhanced_transcript"), turns)).withColumn("blocks", F.from_json(get("transcript"), "array<string>"))
    line = lambda t: F.concat(F.lit("["), F.coalesce(t["speaker_name"], F.lit("unknown")), F.lit("] "), T.strip(t["content"]))
    said = F.array_join(F.transform(F.filter("turns", lambda t: F.coalesce(t["content"], F.lit("")) != ""), line), "\n")
    # Captions: each block has two lines of its own before its words.
    words = F.transform("blocks", lambda b: T.strip(F.array_join(F.slice(F.split(b, "\n"), F.lit(3), F.greatest(F.size(F.split(b, "\n")) - 2, F.lit(0))), " ")))
    plain = F.array_join(F.filter(words, lambda w: w != ""), " ")
    out = d.select(
        F.lit(company).alias("group_name"), get("entity.name").alias("person_name"), get("entity.title").alias("person_title"), F.col("entity_id").alias("person_id"), "item_id", get("title").alias("item_title"),
        get("source_url").alias("source_url"), "publish_date", get("channel_name").alias("source_name"), F.when(F.size("turns") > 0, said).otherwise(F.coalesce(plain, F.lit(""))).alias("transcript_text"), F.coalesce("turns", F.array().cast(turns)).alias("turns"),
    )
    return out.groupBy("item_id").agg(F.max_by(F.struct(*(c for c in out.columns if c != "item_id")), F.struct("publish_date", "transcript_text")).alias("r")).select("item_id", "r.*")


def resolve_company(name: str, found: list[dict]) -> tuple[str, str] | None:
    """(id, name) of the one result with that very name, or of the only result; else None."""
    label = lambda r: r.get("name") or r.get("full_name") or f"company_id {r.get('company_id')}"
    exact = [r for r in found if label(r).lower() == name.lower()]
    one = exact[0] if len(exact) == 1 else found[0] if len(found) == 1 else None
    return (str(one["company_id"]), label(one)) if one else None


def company_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a list file, one a line; blank lines and comments go."""
    return [r[0] for r in spark.read.text(path).select(T.strip("value").alias("v")).filter("v <> '' and v not like '#%'").collect()]


def download_company(spark: SparkSession, name: str, url: str, key: str, wait: float = WAIT) -> DataFrame | None:
    """Records of all of a company's people, a partition each; people whose feed fails are left out.  None if the name isn't clear."""
    found = resolve_company(name, search("companies", name, url, key, wait=wait))
    if found is None:
        return None
    people = get_page(url, key, "get_entities", wait, company_id=found[0], page_size=PAGE)["results"]
    feed = read_feed(spark, url=url, key=key, entity_ids=json.dumps([p["id"] for p in people]), skipFailures="true", wait=str(wait))
    return records(feed, found[1])
