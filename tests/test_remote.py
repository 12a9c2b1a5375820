import json
import re
import struct
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pagewright.functions.codec import pack
from pagewright.sources import remote


class Handler(BaseHTTPRequestHandler):
    """Answers as a recogniser does, and nothing else: two paths, files `images` of raw crops, a form field `batch_size`; a crop of the letter x breaks its request, and
    so do more than `most` crops worked on in batches of over `large`."""

    def _give(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):  # noqa: N802
        if self.path != "/health":
            return self._give(404, {})
        return self._give(200, {"status": "ok", "num_replicas": 2})

    def do_POST(self):  # noqa: N802
        data = self.rfile.read(int(self.headers["Content-Length"]))
        if self.path != "/recognize_batch":
            return self._give(404, {})
        edge = b"--" + self.headers["Content-Type"].split("boundary=")[1].encode()
        crops, hint = [], None
        for part in data.split(edge)[1:-1]:
            head, body = part.split(b"\r\n\r\n", 1)
            name = re.search(rb'[; ]name="(\w+)"', head)[1]
            if name == b"images":
                crops.append(body.removesuffix(b"\r\n"))
            elif name == b"batch_size":
                hint = int(body)
        self.server.seen.append((len(crops), hint))
        if not crops or hint is None:
            return self._give(400, {"error": "no images"})
        results = []
        for crop in crops:
            h, w, c = struct.unpack(">III", crop[:12])
            assert len(crop) == 12 + h * w * c
            results.append({"text": crop[12:].decode(), "conf": 0.5})
        if any("x" in r["text"] for r in results) or (len(crops) > 2 and hint > self.server.large):
            return self._give(500, {"error": "out of memory"})
        return self._give(200, {"results": results, "model_time": 0.25, "decode_time": 0.0})

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    httpd.seen, httpd.large = [], 1000
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    httpd.url = f"http://127.0.0.1:{httpd.server_port}"
    yield httpd
    httpd.shutdown()


DEAD = "http://127.0.0.1:9"


def crops(spark, texts):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "frame_id long, word_id int, text string").coalesce(1)
    data = F.when(F.col("text") != "", pack(F.lit(1), F.length("text"), F.lit(1), F.encode("text", "UTF-8"))).when(F.col("text") == "", F.lit(b""))
    return rows.select("frame_id", "word_id", data.alias("data"))


def answers(df):
    return {r.word_id: (r.text, r.conf, r.error is None) for r in df.collect()}


def test_bad_crops_stand_alone(spark, server):
    texts = ["a", "b", "x", "c", "", None, "d"] + [f"w{i}" for i in range(40)] + ["xx"]
    got = answers(remote.reader([DEAD, server.url])(crops(spark, texts)))
    assert got == {i: ("", 0.0, False) if "x" in t else (t, 0.5, True) for i, t in enumerate(texts) if t}
    assert sorted(n for n, _ in server.seen)[-2:] == [23, 23]  # two replicas, two requests at first


def test_too_large_batches_are_halved(spark, server):
    server.large = 20
    texts = [f"w{i}" for i in range(30)]
    df = remote.reader([server.url])(crops(spark, texts))
    rows = df.collect()
    assert [(r.text, r.error, r.model_seconds) for r in sorted(rows, key=lambda r: r.word_id)] == [(t, None, 0.25) for t in texts]
    assert {h for _, h in server.seen} == {64, 32, 16} and max(n for n, h in server.seen if h == 16) <= 4


def test_batches_of_a_given_size(spark, server):
    assert len(answers(remote.reader([server.url], batch=8)(crops(spark, ["w"] * 50)))) == 50
    assert max(n for n, _ in server.seen) <= 8 and {h for _, h in server.seen} == {8}


def test_a_server_that_goes_away(spark, server):
    up = lambda urls: {u: {"num_replicas": 1} for u in urls}  # noqa: E731  it was there when health was asked
    got = answers(remote.reader([DEAD, server.url], health=up)(crops(spark, ["a", "b", "c"])))
    assert got == {0: ("a", 0.5, True), 1: ("b", 0.5, True), 2: ("c", 0.5, True)}
    none = remote.reader([DEAD], health=up)(crops(spark, ["a", "b"])).collect()
    assert [(r.text, r.error.startswith(DEAD)) for r in none] == [("", True)] * 2


def test_health(server):
    assert remote.healthy([DEAD, server.url]) == {server.url: {"status": "ok", "num_replicas": 2}}
    with pytest.raises(RuntimeError):
        remote.healthy([DEAD])


def test_plans_cover_all_crops_once():
    for n in (1, 2, 3, 7, 64, 257, 1000):
        for servers in ({"a": 1}, {"a": 2, "b": 1}, {"a": 1, "b": 4, "c": 2}):
            for batch in (None, 10):
                plan = remote.planned(n, servers, batch, 5)
                assert sorted(i for _, part in plan for i in part) == list(range(n)) and all(len(part) for _, part in plan)
                assert max(len(part) for _, part in plan) <= (batch or remote.MOST)
    assert [len(p) for _, p in remote.planned(12, {"a": 2, "b": 1})] == [3, 3, 6] and [u for u, _ in remote.planned(2, {"a": 1, "b": 1}, None, 1)] == ["b", "a"]
