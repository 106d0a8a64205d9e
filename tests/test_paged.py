"""The paged source against a server on localhost: partitions, back-off, loads that resume, streams that go on."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from ledgerlark.sources import paged


class Server:
    """``total`` rows; offsets in ``broken`` fail for good, those in ``shaky`` fail once."""

    def __init__(self) -> None:
        self.total, self.broken, self.shaky, self.asked = 0, set(), set(), Counter()
        world = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                at = urlparse(self.path)
                if at.path == "/count":
                    return self.say(200, {"total": world.total})
                q = {k: int(v[0]) for k, v in parse_qs(at.query).items()}
                world.asked[q["offset"]] += 1
                if q["offset"] in world.broken or q["offset"] in world.shaky and world.asked[q["offset"]] == 1:
                    return self.say(503, {})
                return self.say(200, {"rows": list(range(q["offset"], min(world.total, q["offset"] + q["limit"])))})

            def say(self, code, body):
                data = json.dumps(body).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{self.http.server_port}"
        self.urls = {"url": base + "/rows?offset={offset}&limit={limit}", "count_url": base + "/count"}


@pytest.fixture
def server():
    s = Server()
    yield s
    s.http.shutdown()


def rows(pages):
    return sorted(x for r in pages.collect() for x in json.loads(r.body)["rows"])


def test_a_partition_a_page_with_back_off(spark, server):
    spark.dataSource.register(paged.PagedSource)
    server.total, server.shaky = 95, {20, 90}
    df = spark.read.format("paged").options(**server.urls, page_size="10", pause="0.01").load()
    assert df.rdd.getNumPartitions() == 10 and rows(df) == list(range(95))
    assert server.asked[20] == server.asked[90] == 2 and server.asked[0] == 1


def test_a_stopped_load_resumes_without_asking_twice(spark, server, tmp_path):
    path = str(tmp_path / "pages")
    server.total, server.broken = 87, {50}
    with pytest.raises(Exception, match="503"):
        paged.land_pages(spark, path=path, page_size=10, at_once=2, tries=2, pause=0.01, **server.urls)
    done = paged.landed_offsets(spark, path)
    assert done == [0, 10, 20, 30]
    server.broken, before = set(), Counter(server.asked)
    assert rows(paged.land_pages(spark, path=path, page_size=10, at_once=2, tries=2, pause=0.01, **server.urls)) == list(range(87))
    assert all(server.asked[o] == before[o] == 1 for o in done)
    server.total = 100
    assert rows(paged.land_pages(spark, path=path, page_size=10, **server.urls)) == list(range(100))
    assert paged.landed_offsets(spark, path) == list(range(0, 100, 10)) and server.asked[0] == 1


def test_nothing_and_refusals(spark, server, tmp_path):
    assert rows(paged.land_pages(spark, path=str(tmp_path / "none"), page_size=10, **server.urls)) == []
    with pytest.raises(OSError):
        paged.fetch(server.urls["count_url"].replace("/count", "/rows?offset=x&limit=1"), tries=2, pause=0.01)


def test_a_stream_goes_on_from_the_last_page(spark, server, tmp_path):
    spark.dataSource.register(paged.PagedSource)

    def run():
        stream = spark.readStream.format("paged").options(**server.urls, page_size="10", pause="0.01").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return rows(spark.read.parquet(str(tmp_path / "out")))

    server.total = 34
    assert run() == list(range(30))
    server.total = 55
    assert run() == list(range(50)) and set(server.asked.values()) == {1}
