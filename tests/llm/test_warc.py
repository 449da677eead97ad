import base64
import hashlib
import html
import re

from cairnlight.llm import warc

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B
 page </title><style>p{}</style><script>var t="</p>";</script></head><body><!-- hidden --><p>One<b>two</b><br>three &copy; é</p>
<ul><li><a href="/x?a=1&amp;b=2">X</a></li></ul><script>open to the end"""


def run(spark, rows, extra=False):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    if extra:
        pages = pages.selectExpr("*", "'x' AS record_id", "'y' AS body", "1 AS k", "2 AS block")
    return warc.derivatives(warc.responses(pages)).collect()


def test_records_of_a_page(spark):
    rows = {r["warc_type"]: r for r in run(spark, [(1, "http://a/b", PAGE)], extra=True)}
    text, meta = rows["conversion"], rows["metadata"]
    assert text["block"] == "A & B\npage\nOnetwo\nthree © é\nX"
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b.encode()).digest()).decode()
    assert text["block_digest"] == sha(text["block"]) and meta["block_digest"] == sha(meta["block"])
    assert meta["block"].split("\r\n") == [
        "http-status-line: HTTP/1.1 200 OK", "http-header: Content-Type: text/html; charset=utf-8", f"http-header: Content-Length: {len(PAGE.encode())}",
        f"payload-digest: {sha(PAGE)}", "title: A & B page", "outlink: /x?a=1&b=2", "",
    ]
    assert text["refers_to"] == meta["refers_to"] and text["record_id"] != meta["record_id"]
    for r in (text, meta):
        head = dict(x.split(": ", 1) for x in r["header"].split("\r\n")[1:])
        assert head["WARC-Refers-To"] == f"<{r['refers_to']}>" and head["WARC-Record-ID"] == f"<{r['record_id']}>"
        assert int(head["Content-Length"]) == len(r["block"].encode()) == r["content_length"]
        assert head["WARC-Target-URI"] == "http://a/b" and re.fullmatch(r"urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r["record_id"])


def test_serialized_round_trip(spark):
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>é {k}</p>") for k in range(5)], "page_id long, url string, html string")
    data = b"".join(bytes(r[0]) for r in warc.serialized(warc.derivatives(warc.responses(pages))).collect())
    found = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        data, found = rest[size + 4 :], found + 1
    assert found == 10


def test_odd_rows(spark):
    rows = run(spark, [(1, None, None), (2, "u", ""), (None, "u", "<p"), (3, "u\r\nX: 1", "x" * 400_000 + "<script"), (3, "u", "a"), (3, "u", "a")])
    assert len(rows) == 12
    empty = [r for r in rows if r["target_uri"] is None]
    assert {r["block"] for r in empty if r["warc_type"] == "conversion"} == {""}
    assert all("WARC-Target-URI" not in r["header"] for r in empty)
    assert all("\r\nX: 1" not in r["header"] for r in rows)
    assert max(r["content_length"] for r in rows) == 400_000
    ids = [r["record_id"] for r in rows]
    assert len(set(ids)) == 10
    assert run(spark, []) == []


def test_many_unclosed_parts(spark):
    page = "<script <!-- <style <p " * 2000
    assert [r["block"] for r in run(spark, [(1, "u", page)]) if r["warc_type"] == "conversion"] == [""]
    assert html.unescape("&copy;") == dict(warc.ENTITIES)["&copy;"]


def test_links_and_real_headers(spark):
    body = """<a class=x href='/one'>1</a> <A data-href="/no" HREF = "/two&amp;x">2</A><a href=/three>3</a><a name="href">n</a><area href="/area">"""
    header = "HTTP/1.0 404 Not Found\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Folded: one\r\n\ttwo\r\n   three\r\nServer: s\r\n\r\n"
    source = spark.createDataFrame([("urn:uuid:1", "http://a", "2020-02-02T00:00:00Z", header, body), ("urn:uuid:2", None, None, None, None)], "record_id string, target_uri string, warc_date string, http_header string, body string")
    rows = {(r["refers_to"], r["warc_type"]): r for r in warc.derivatives(source).collect()}
    lines = rows["urn:uuid:1", "metadata"]["block"].split("\r\n")
    assert lines[:5] == ["http-status-line: HTTP/1.0 404 Not Found", "http-header: Set-Cookie: a=1", "http-header: Set-Cookie: b=2", "http-header: X-Folded: one two three", "http-header: Server: s"]
    assert lines[5].startswith("payload-digest: sha1:") and lines[6:] == ["outlink: /one", "outlink: /two&x", "outlink: /three", ""]
    assert "WARC-Date: 2020-02-02T00:00:00Z" in rows["urn:uuid:1", "conversion"]["header"]
    assert rows["urn:uuid:2", "conversion"]["block"] == "" and "WARC-Target-URI" not in rows["urn:uuid:2", "metadata"]["header"]
