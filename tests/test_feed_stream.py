"""The feed as a stream over a local stand-in: restarts, failures between pages, date ranges."""

import json
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from textloom.sources import feeds as S


class Server(BaseHTTPRequestHandler):
    """Items by entity, newest first, three a page; ``broken`` pages answer with an error."""

    items: dict = {}
    broken: set = set()
    asked: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Server.asked.append(q)
        if (q["entity_id"], q.get("before_feed_item_id")) in Server.broken:
            return self.answer(500, {})
        size = min(3, int(q["page_size"]))
        found = [(i, d) for i, d in sorted(Server.items[q["entity_id"]], reverse=True) if "before_feed_item_id" not in q or i < int(q["before_feed_item_id"])]
        found = [(i, d) for i, d in found if q.get("filter_after_dt", "") <= d <= q.get("filter_before_dt", "9")]
        page = [{"id": i, "publish_date": d} for i, d in found[:size]]
        self.answer(200, {"results": page, "page_has_next": len(found) > size, "last_seen_id": page[-1]["id"] if page else None})

    def answer(self, code, body):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture()
def url():
    Server.items, Server.broken, Server.asked = {"1": [], "2": []}, set(), []
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def days(first, n, step=1):
    return [(i, (date(2024, 1, 1) + timedelta(days=i * step)).isoformat()) for i in range(first, first + n)]


def run(spark, url, folder, **options):
    feed = S.stream_feed(spark, url=url, key="k", entity_ids="[1, 2]", wait="0.01", **options)

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    feed.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def seen(spark, folder):
    return sorted((r.entity_id, int(r.item_id)) for r in spark.read.parquet(f"{folder}/out").collect())


def wanted():
    return sorted((e, i) for e, found in Server.items.items() for i, _ in found)


def test_goes_on_where_it_was(spark, url, tmp_path):
    Server.items = {"1": days(1, 8), "2": []}
    run(spark, url, tmp_path)
    assert seen(spark, tmp_path) == wanted()
    Server.items["1"] += days(9, 5)
    Server.items["2"] += days(100, 2)
    Server.asked.clear()
    run(spark, url, tmp_path)
    assert seen(spark, tmp_path) == wanted()
    # The second run reads no page below what was seen.
    assert all(int(q.get("before_feed_item_id", 99)) > 8 for q in Server.asked if q["entity_id"] == "1")
    run(spark, url, tmp_path)
    assert seen(spark, tmp_path) == wanted()


def test_ended_between_pages(spark, url, tmp_path):
    """The third page fails for good: the run ends; items that come meanwhile aren't lost, none is there twice."""
    Server.items = {"1": days(1, 10), "2": days(50, 4)}
    Server.broken = {("1", "5")}
    with pytest.raises(Exception, match="kept failing"):
        run(spark, url, tmp_path)
    Server.broken = set()
    before = wanted()
    Server.items["1"] += days(11, 3)
    run(spark, url, tmp_path)  # the batch that was cut short, as it was planned
    assert seen(spark, tmp_path) == before
    run(spark, url, tmp_path)
    assert seen(spark, tmp_path) == wanted()


def test_history_is_read_by_date_ranges(spark, url, tmp_path):
    Server.items = {"1": days(0, 40), "2": days(5, 1)}
    feed = S.FeedStreamReader({"url": url, "key": "k", "entity_ids": "[1, 2]", "after": "2024-01-01", "rangedays": "7"})
    parts = feed.partitions({}, feed.latestOffset())
    assert len(parts) == 6 + 1 + 1 + 1  # 39 days in weeks, 5 days, and an open range each
    run(spark, url, tmp_path, after="2024-01-01", rangeDays="7")
    assert seen(spark, tmp_path) == wanted()


def test_a_table_by_date_ranges(spark, url):
    Server.items = {"1": days(0, 40), "2": days(5, 1)}
    whole = S.read_feed(spark, url=url, key="k", entity_ids="[1, 2]", wait="0.01", after="2024-01-03", before="2024-02-05")
    cut = S.read_feed(spark, url=url, key="k", entity_ids="[1, 2]", wait="0.01", after="2024-01-03", before="2024-02-05", rangeDays="5")
    assert cut.rdd.getNumPartitions() == 14
    rows = lambda d: sorted((r.entity_id, r.item_id) for r in d.filter("publish_date < '2024-02-05'").collect())
    assert rows(cut) == rows(whole) and len(rows(cut)) == 34


def test_ranges():
    assert S.date_ranges("2024-01-01", "2024-01-10", 4) == [("2024-01-01", "2024-01-05"), ("2024-01-05", "2024-01-09"), ("2024-01-09", "2024-01-10")]
    assert S.date_ranges(None, "2024-01-10", 4) == [(None, "2024-01-10")] and S.date_ranges("2024-01-02", "2024-01-01", 4) == []
