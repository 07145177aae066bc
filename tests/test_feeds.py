"""Remote feeds over a local stand-in, dataset files and their registry."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from textloom.sources import feeds as S
from textloom.sources import registry_files as R


class Server(BaseHTTPRequestHandler):
    """Five items for each of two people, two a page; every first try of a page fails; a third person's feed always does."""

    tried: set = set()
    asked: list = []

    def do_GET(self):
        u = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        Server.asked.append((u.path, q))
        if self.headers.get("X-API-Key") != "k":
            return self.answer(403, {})
        if u.path == "/api/get_companies/":
            both = [{"company_id": 7, "name": "Acme"}, {"company_id": 8, "name": "Acme Two"}]
            return self.answer(200, {"results": both if q["keyword"] == "acme" else []})
        if u.path == "/api/get_entities/":
            return self.answer(200, {"results": [{"id": i, "name": f"P{i}", "title": "CEO"} for i in (1, 2, 3)]})
        if q.get("entity_id") == "3":
            return self.answer(500, {})
        if self.path not in Server.tried:
            Server.tried.add(self.path)
            return self.answer(503, {})
        ids = [i for i in range(5, 0, -1) if "before_feed_item_id" not in q or i < int(q["before_feed_item_id"])]
        ids = [i for i in ids if f"2024-01-0{i}" >= q.get("filter_after_dt", "")]
        items = [{"id": f"{q['entity_id']}{i}", "publish_date": f"2024-01-0{i}", "title": "t", "entity": {"name": "P"}, **({"enhanced_transcript": [{"speaker_name": "A", "content": " hi "}, {"content": "yo"}]} if i % 2 else {"transcript": ["1\n0:01\nhello\nthere", "2\n0:02"]})} for i in ids[:2]]
        self.answer(200, {"results": items, "page_has_next": len(ids) > 2, "last_seen_id": ids[1] if len(ids) > 1 else None})

    def answer(self, code, body):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_pages_and_retries(spark, url):
    feed = S.read_feed(spark, url=url, key="k", entity_ids="[1, 2]", pageSize="2", wait="0.01")
    rows = feed.collect()
    assert sorted(r.item_id for r in rows) == sorted(f"{e}{i}" for e in (1, 2) for i in range(1, 6)) and feed.rdd.getNumPartitions() == 2
    some = S.read_feed(spark, url=url, key="k", entity_ids="[1]", after="2024-01-04", wait="0.01").collect()
    assert {r.item_id for r in some} == {"14", "15"}
    with pytest.raises(ValueError):
        S.get_page(url, "", "get_feed")
    with pytest.raises(Exception):  # noqa: B017
        S.get_page(url, "wrong", "get_feed", 0.01)


def test_search_and_download(spark, url):
    found = S.search("companies", "acme", url, "k")
    assert S.resolve_company("ACME", found) == ("7", "Acme") and S.resolve_company("other", found) is None and S.resolve_company("x", found[:1]) == ("7", "Acme")
    assert S.download_company(spark, "nobody", url, "k", 0.01) is None
    got = {r.item_id: r for r in S.download_company(spark, "acme", url, "k", 0.001).collect()}
    assert len(got) == 10 and got["11"].transcript_text == "[A] hi\n[unknown] yo" and got["12"].transcript_text == "hello there" and got["11"].group_name == "Acme"


def test_registry_and_append(spark, tmp_path):
    root = str(tmp_path)
    assert R.load_registry(spark, root).count() == 0
    items = spark.createDataFrame([("1", "a, \"b\"\nc", [("A", "x")])], "item_id string, item_title string, turns array<struct<speaker_name:string,content:string>>")
    R.write_export(items, f"{root}/one")
    R.register(spark, root, id="q1", label="One — 1 interview(s)", kind="company", count=1, json_file="one", csv_file="one")
    R.register(spark, root, id="q2", label="Two", kind="company", count=0, json_file="two", csv_file="two")
    assert [r.id for r in R.load_registry(spark, root).orderBy("id").collect()] == ["q1", "q2"]
    more = R.read_export(spark, f"{root}/one").withColumn("item_id", F.lit("2"))
    R.append_dataset(spark, root, "q1", more)
    entry = R.load_registry(spark, root).filter("id = 'q1'").first()
    assert (entry["count"], entry.label) == (2, "One — 2 interview(s)")
    csv = R.read_export(spark, f"{root}/one", "csv")
    assert "turns" not in csv.columns and {r.item_title for r in csv.collect()} == {"a, \"b\"\nc"} and csv.count() == 2
    with pytest.raises(ValueError, match="stand already"):
        R.append_dataset(spark, root, "q1", more)
    with pytest.raises(KeyError):
        R.append_dataset(spark, root, "nope", more)
    (tmp_path / "bad" / "_index").mkdir(parents=True)
    (tmp_path / "bad" / "_index" / "part-0.json").write_text("{broken")
    assert R.load_registry(spark, f"{root}/bad").count() == 0


def test_turn_and_label_files(spark, tmp_path):
    turns = spark.createDataFrame([(2, 1, "acme", 'say "x", y'), (1, 2, "acme", "b"), (1, 1, "beta", "c\nd")], "interview_id long, turn_id long, company string, body string")
    R.write_turn_files(turns, str(tmp_path / "t"))
    first = next((tmp_path / "t" / "all").glob("part-*")).read_bytes()
    assert first.startswith(b"\xef\xbb\xbfinterview_id,")
    back = R.read_turn_files(spark, str(tmp_path / "t" / "acme"), str(tmp_path / "t" / "beta"))
    assert [(r.interview_id, r.turn_id, r.body) for r in back.collect()] == [(1, 1, "c\nd"), (1, 2, "b"), (2, 1, 'say "x", y')]
    head = ",".join(R.LABEL_COLUMNS)
    (tmp_path / "ok.csv").write_text("\ufeff" + head + "\ns1,1,t,pos,code,confirmed,true\n", encoding="utf-8")
    (tmp_path / "odd.csv").write_text(head + "\ns1,1,t,maybe,code,confirmed,true\n")
    (tmp_path / "short.csv").write_text("segment_id,label\ns1,pos\n")
    assert R.read_label_file(spark, str(tmp_path / "ok.csv")).first().segment_id == "s1"
    for bad in ("odd", "short"):
        with pytest.raises(ValueError):
            R.read_label_file(spark, str(tmp_path / f"{bad}.csv"))


def test_codebook_files(spark, tmp_path):
    write = lambda n, d: (tmp_path / n).write_text(json.dumps(d))
    write("seed.json", {"topics": [{"topic_id": "a"}]})
    write("app.json", {"format": "codebook_topics", "format_version": 1, "topics": []})
    write("new.json", {"format": "codebook_topics", "format_version": 9, "topics": []})
    assert R.read_codebook(spark, str(tmp_path / "seed.json"), ["a", "b"])[0] == "seed_pack" and R.read_codebook(spark, str(tmp_path / "app.json"))[0] == "codebook"
    for name, known in (("new.json", None), ("seed.json", ["b"])):
        with pytest.raises(ValueError):
            R.read_codebook(spark, str(tmp_path / name), known)


def test_json_lines(spark):
    d = spark.createDataFrame([("p", '{"a": 1}\n\n  {"a": 2}  \r\n')], "path string, value string")
    assert [r.value for r in R.parse_json_lines(d).orderBy("line_no").collect()] == ['{"a": 1}', '{"a": 2}']
    with pytest.raises(Exception, match="no JSON object in line 2"):
        R.parse_json_lines(spark.createDataFrame([("p", '{"a": 1}\n{bad')], "path string, value string")).collect()


def test_stage_outputs(spark, tmp_path):
    report = R.write_stage({"turns": spark.range(3), "topics": spark.range(2)}, str(tmp_path / "s"), "Stage 0")
    assert "turns: 3 rows" in report and spark.read.parquet(str(tmp_path / "s/topics")).count() == 2
