"""The paged source over HTTP, with a server that counts its requests and fails at times, and over recorded pages."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import paged

DOCS = [
    {"id": i, "content": f"text {i}\nline" if i % 5 else None, "tags": [7, 8] if i % 2 else [{"id": 9, "name": "receipt"}], "custom_fields": [{"field": 1, "value": i}, {"field": 2, "value": None}] if i % 3 == 0 else []} for i in range(3, 210, 2)
]


@pytest.fixture
def server():
    asked, docs, faults = [], list(DOCS), Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            where = urlparse(self.path)
            asked.append((self.path, self.headers.get("Authorization")))
            parts = [x for x in where.path.split("/") if x]
            if faults[self.path] > 0:
                faults[self.path] -= 1
                self.send_error(503)
                return
            if len(parts) == 3:
                body = next((d for d in docs if d["id"] == int(parts[2])), None)
            else:
                query = {k: int(v[0]) for k, v in parse_qs(where.query).items()}
                first = (query["page"] - 1) * query["page_size"]
                rest = docs[first : first + query["page_size"]]
                body = {"count": len(docs), "next": "more" if first + query["page_size"] < len(docs) else None, "results": rest} if rest else None
            if body is None:
                self.send_error(404)
                return
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    found.asked, found.docs, found.faults, found.url = asked, docs, faults, f"http://127.0.0.1:{found.server_port}/"
    yield found
    found.shutdown()


def rows(df):
    return sorted((r.id, r.content, [tuple(t) for t in r.tags], [tuple(f) for f in r.custom_fields]) for r in df.collect())


def test_all_pages_side_by_side(spark, server):
    df = paged.documents(spark, url=server.url, token="secret", page_size=10, pages_per_partition=3)
    assert rows(df) == [paged.row(d) for d in DOCS]
    assert df.rdd.getNumPartitions() == 4
    pages = Counter(p for p, _ in server.asked)
    assert all(f"/api/documents/?page={n}&page_size=10" in pages for n in range(1, 12)) and {t for _, t in server.asked} == {"Token secret"}


def test_a_lookup_asks_for_its_documents_only(spark, server):
    df = paged.documents(spark, url=server.url)
    server.asked.clear()
    found = paged.lookup(df, 7, 8, 203).where("content IS NOT NULL")
    assert [r[0] for r in rows(found)] == [7, 203]
    assert {p for p, _ in server.asked} == {f"/api/documents/{i}/" for i in (7, 8, 203)}
    assert rows(df.where("id = 9 AND id IN (9, 11)")) == [paged.row(DOCS[3])]
    assert df.where("id = 9 AND id = 11").collect() == []
    assert df.where("id > 200").count() == 5


def test_failing_pages_are_asked_for_again(spark, server):
    page = "/api/documents/?page=2&page_size=60"
    server.faults[page] = 2
    df = paged.documents(spark, url=server.url, page_size=60, pages_per_partition=1)
    assert len(rows(df)) == len(DOCS)
    server.faults[page] = 100
    with pytest.raises(Exception, match="503"):
        df.collect()


def test_documents_added_after_the_count_are_read(spark, server):
    reader = paged.PagedReader(paged.HttpPages(server.url, page_size=10), 4)
    parts = reader.partitions()
    server.docs += [{"id": 1000 + i, "content": "late", "tags": None} for i in range(25)]
    assert len({r[0] for p in parts for r in reader.read(p)}) == len(DOCS) + 25
    assert [(p.first, p.last) for p in parts] == [(1, 4), (5, 8), (9, None)]


def test_recorded_pages(spark, tmp_path):
    schema = "id long, content string, tags array<struct<id:int,name:string>>, custom_fields array<struct<field:int,value:string>>"
    docs = spark.createDataFrame([*map(paged.row, DOCS), (None, "no id", None, None), (4000, "far", None, None)], schema)
    paged.record(docs, f"file://{tmp_path}/pages", 25)
    df = paged.documents(spark, path=f"file://{tmp_path}/pages", page_size=25, pages_per_partition=2)
    assert rows(df) == [*map(paged.row, DOCS), (4000, "far", [], [])]
    assert rows(paged.lookup(df, 4000, 5)) == [paged.row(DOCS[1]), (4000, "far", [], [])]
    (tmp_path / "pages" / "page=2").rename(tmp_path / "elsewhere")
    assert rows(paged.lookup(df, 5)) == [paged.row(DOCS[1])], "a lookup reads its own page only"
    assert df.where("id BETWEEN 25 AND 49").count() == 0
    with pytest.raises(Exception, match="url or path"):
        paged.documents(spark).collect()
    assert spark.range(1).select(F.lit(1)).count() == 1
