"""Sources over HTTP against a server of this process, and reports."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from playledger import contracts
from playledger.sources import http, report

SEEN: dict[str, int] = {}


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        u = urlparse(self.path)
        SEEN[u.path] = SEEN.get(u.path, 0) + 1
        if u.path == "/flaky.csv" and SEEN[u.path] < 3:
            self.send_error(503)
            return
        if u.path.endswith(".csv"):
            body = 'id,name\r\n1,"a, ""b"""\n2,"two\nlines"\n3,\n'
        elif u.path == "/rows":
            q = {k: int(v[0]) for k, v in parse_qs(u.query).items()}
            body = json.dumps([{"id": i} for i in range(q["offset"], min(25, q["offset"] + q["limit"]))])
        elif u.path == "/page":
            body = json.dumps({"data": [{"id": 1, "v": "é"}, {"id": None}]})
        else:
            self.send_error(404)
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_csv_and_json(spark, base):
    got = http.csv_over_http(spark, [f"{base}/a.csv", f"{base}/flaky.csv"], "id int, name string", wait_s=0.01, tasks=1)
    assert sorted(got.collect(), key=str) == sorted([(1, 'a, "b"'), (2, "two\nlines"), (3, None)] * 2, key=str)
    assert SEEN["/flaky.csv"] == 3
    assert [tuple(r) for r in http.json_over_http(spark, [f"{base}/page"], "id:int,v:string", at="data").collect()] == [(1, "é"), (None, None)]
    assert sorted(r.id for r in http.ranged_table(spark, f"{base}/rows", "id:int", rows=25, page=10).collect()) == list(range(25))


def test_failures_are_rows(spark, base):
    urls = spark.createDataFrame([(f"{base}/none",), (None,), (f"{base}/a.csv",), ("http://127.0.0.1:9/",)], "url string")
    got = {r.url: (r.body is not None, r.error, r.tries) for r in http.fetch(urls, tries=2, wait_s=0.01).collect()}
    assert got[f"{base}/none"] == (False, "status 404", 1) and got[None] == (False, "no address", 0) and got[f"{base}/a.csv"] == (True, None, 1)
    assert got["http://127.0.0.1:9/"][0] is False and got["http://127.0.0.1:9/"][2] == 2
    with pytest.raises(contracts.ContractError):
        http.csv_over_http(spark, [f"{base}/none"], "id int")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>"), (2, None)], "k int, v string")
    report.write_html(df, str(tmp_path / "r.html"), "T & U")
    text = (tmp_path / "r.html").read_text()
    assert "&lt;b&gt;" in text and "T &amp; U" in text and text.count("<tr>") == 3
    with pytest.raises(contracts.ContractError):
        report.table_html(df, "x", most=1)
