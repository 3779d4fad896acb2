"""The chapter source against a server on this machine."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest

from hexapla.sources import readers
from hexapla.sources.chapters import ChapterReader, chapter_files, read_remote_chapters
from hexapla.sources.named_files import named_files

ANSWERS = {"one": {"fulltext": ["first", "second"]}, "two": {"fulltext": "whole"}, "three": {}, "four": {"fulltext": None}, "flaky": {"fulltext": "at last"}, "ü/x y": {"fulltext": "中文"}}


@pytest.fixture(scope="module")
def server():
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            slug = unquote(self.path.partition("urn=")[2])
            asked[slug] += 1
            broken = slug == "gone" or slug == "flaky" and asked[slug] < 3
            body = b"not json" if slug == "text" else b"[1]" if slug == "list" else json.dumps(ANSWERS.get(slug, {})).encode()
            self.send_response(500 if broken else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/gettext?urn={{slug}}", asked
    s.shutdown()


def test_chapters_failures_and_retries(spark, server, tmp_path):
    url, asked = server
    slugs = ["one", "two", "gone", "three", "four", "flaky", "text", "list", "ü/x y"]
    rows = {r.ord: r for r in read_remote_chapters(spark, slugs, url, partitions=3, delay=0.01).collect()}
    assert [rows[i + 1].slug for i in range(9)] == slugs
    assert [rows[i].text for i in (1, 2, 4, 5, 6, 9)] == ["first\n\nsecond", "whole", "", "", "at last", "中文"]
    assert all(rows[i].error is None for i in (1, 2, 4, 5, 6, 9)) and all(rows[i].error and rows[i].text is None for i in (3, 7, 8))
    assert "500" in rows[3].error and asked["gone"] == asked["flaky"] == 3 and asked["one"] == 1
    assert read_remote_chapters(spark, [], url).count() == 0

    kept = read_remote_chapters(spark, ["one", "gone", "two"], url, delay=0.0, attempts=1)
    named_files(chapter_files(kept, "suwen"), str(tmp_path), ".txt")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["suwen_ch01.txt", "suwen_ch03.txt"]
    assert [(r.chapter_num, r.text) for r in readers.read_chapters(spark, f"{tmp_path}/suwen_ch*.txt").collect()] == [(1, "first\n\nsecond"), (3, "whole")]


def test_pauses_between_requests(server, monkeypatch):
    url, _ = server
    pauses = []
    monkeypatch.setattr("hexapla.sources.chapters.time.sleep", pauses.append)
    reader = ChapterReader({"url": url, "slugs": json.dumps(["one", "gone", "two"]), "delay": "1.5", "attempts": "2", "partitions": "2"})
    parts = reader.partitions()
    assert [(p.first, p.slugs) for p in parts] == [(1, ("one", "gone")), (3, ("two",))]
    assert [r[0] for p in parts for r in reader.read(p)] == [1, 2, 3] and pauses == [1.5, 3.0]
