import base64
import gzip
import hashlib
import html
import zlib

from fixtures import empty
from pyspark.sql import functions as F

from grainsift.llm import warc

PAGE = (
    '<!DOCTYPE html><html lang="fr"><head><title>A\n B</title><style>p{}</style></head><body><script>var t="</p>";</script><!-- no --><nav><a href="/x">X</a> <a href="/x">X</a></nav>'
    "<p>One &amp; two &lt;b&gt;<br>three</p></body></html>"
)
HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html"


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def responses(spark, rows):
    return spark.createDataFrame(rows, warc.RESPONSES + ", block string, TARGET_URI string")


def test_linked_records(spark):
    rows = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "sha1:X", "sha1:P", HEADERS, PAGE, "b", "T")]
    got = {r["warc_type"]: r for r in warc.derive(responses(spark, rows)).collect()}
    meta, text = got["metadata"], got["conversion"]
    assert text["block"] == "X X\nOne & two <b>\nthree"
    assert meta["refers_to"] == text["refers_to"] == "<urn:uuid:1>"
    assert (meta["concurrent_to"], text["concurrent_to"]) == (text["record_id"], meta["record_id"])
    assert meta["source_digest"] == "sha1:X" and meta["source_payload_digest"] == "sha1:P" and text["source_headers"] == HEADERS
    assert meta["block"].split("\r\n") == ["title: A B", "language: fr", "source-digest: sha1:X", "source-headers: HTTP/1.1 200 OK; Content-Type: text/html", "outlink: /x", ""]
    for r in got.values():
        assert r["block_digest"] == sha1(r["block"])
        assert r["content_length"] == len(r["block"].encode())


def test_nulls_repeats_and_empty(spark):
    rows = [(None,) * 9, ("a", "u", None, None, None, None, "", None, None), ("a", "u", None, None, None, None, "", None, None), ("b", "u", "d", "g", "p", "h", "<p>" + "é " * 50_000, None, None)]
    got = warc.derive(responses(spark, rows)).collect()
    assert len(got) == 8
    assert sum(r["record_id"] is None for r in got) == 2
    assert {r["block"] for r in got if r["warc_type"] == "conversion" and r["refers_to"] == "a"} == {""}
    assert warc.derive(responses(spark, [])).count() == 0
    assert warc.responses_of(empty(spark).selectExpr("doc_id page_id", "text url", "text html")).count() == 0


def test_files_round_trip(spark):
    body = HEADERS.encode() + b"\r\n\r\n" + PAGE.encode()
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Block-Digest": "sha1:X"}
    other = warc.write_record({"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:2>"}, b"GET /", compress=False)
    packed = warc.write_record(head, body) + gzip.compress(other) + warc.write_record(head | {"WARC-Record-ID": "<urn:uuid:3>"}, HEADERS.encode() + b"\r\n\r\nna\xefve")
    plain = other + warc.write_record(head, body, compress=False)
    assert [h["warc-type"] for h, _ in warc.parse_records(packed)] == ["response", "request", "response"]
    assert next(b for h, b in warc.parse_records(plain) if h["warc-type"] == "response") == body
    assert list(warc.parse_records(plain[:-60])) == list(warc.parse_records(plain))[:1]
    files = spark.createDataFrame([(packed,), (plain,), (None,), (b"",), (b"junk",)], "content binary")
    got = warc.read_responses(files).collect()
    assert sorted((r["record_id"], r["html"]) for r in got) == [("<urn:uuid:1>", PAGE), ("<urn:uuid:1>", PAGE), ("<urn:uuid:3>", "naïve")]
    assert {r["http_headers"] for r in got} == {HEADERS}


def test_damage_costs_one_record():
    one, two, three = (warc.write_record({"WARC-Type": "response", "WARC-Record-ID": str(i)}, b"x" * 500 + bytes([i]) * 3000, compress=i != 9) for i in (1, 2, 3))

    def ids(data):
        return [h["warc-record-id"] for h, _ in warc.parse_records(data)]

    assert ids(one + two + three) == ["1", "2", "3"]
    broken = bytearray(two)
    broken[20:30] = b"\xff" * 10
    assert ids(one + bytes(broken) + three) == ["1", "3"]
    assert ids(one + two[:40] + three) == ["1", "3"]
    plain = [warc.write_record({"WARC-Type": "response", "WARC-Record-ID": str(i)}, b"body %d" % i, compress=False) for i in (1, 2, 3)]
    assert ids(b"".join(plain)) == ["1", "2", "3"]
    assert ids(plain[0] + plain[1].replace(b"Content-Length: 6", b"Content-Length: 6a") + plain[2]) == ["1", "3"]
    assert ids(plain[0] + plain[1].replace(b"Content-Length: 6", b"Content-Length: 99999") + plain[2]) == ["1", "3"]
    assert ids(plain[0] + plain[1][:25] + plain[2]) == ["1", "3"]


def test_bodies_are_decoded():
    page = "<p>naïve – déjà</p>"
    data = page.encode()
    chunked = b"5\r\n" + data[:5] + b"\r\n" + b"%x;q=1\r\n" % (len(data) - 5) + data[5:] + b"\r\n0\r\n\r\n"
    line = "HTTP/1.1 200 OK\r\n"
    assert warc.payload(line + "Transfer-Encoding: chunked", chunked) == page
    assert warc.payload(line + "content-encoding: gzip", gzip.compress(data)) == page
    assert warc.payload(line + "Content-Encoding: gzip\r\nTransfer-Encoding: chunked", b"%x\r\n" % len(gzip.compress(data)) + gzip.compress(data) + b"\r\n0\r\n\r\n") == page
    assert warc.payload(line + "Content-Encoding: deflate", zlib.compress(data)) == page
    assert warc.payload(line + "Content-Encoding: gzip", data) == page  # said, but not done
    assert warc.payload(line + "Transfer-Encoding: chunked", data) == page
    assert warc.payload(line + 'Content-Type: text/html; charset="iso-8859-1"', "café".encode("latin-1")) == "café"
    assert warc.payload(line, '<meta charset="shift_jis">日本'.encode("shift_jis")) == '<meta charset="shift_jis">日本'
    assert warc.payload(line + "Content-Type: text/html; charset=nonsense", data) == page
    assert warc.payload(line, b"caf\xe9") == "café"
    assert warc.payload("", b"") == ""


def test_references_as_another_parser_has_them(spark):
    names = sorted(warc.ENTITIES)
    texts = ["&" + n + ";" for n in names if n != "nbsp"] + [f"a&#{n};b" for n in (0, 9, 65, 128, 150, 0x2019, 0xD800, 0x1F600, 0x110000, 999999999)]
    texts += ["&#x27;&#X41;&#x1F600;", "&amp;lt;", "&nosuch; & &; &#; &#x; &amp", "a & b &copy; c&middot;&eacute;", "", None, "&" * 5000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(warc.unescape(F.col("t"))).collect()]
    for text, out in zip(texts, got, strict=True):
        if text is None:
            assert out is None
        elif "&amp" not in text or text.endswith(";"):
            assert out == html.unescape(text), text
    assert got[texts.index("&nosuch; & &; &#; &#x; &amp")] == "&nosuch; & &; &#; &#x; &amp"


def test_headers_stay_and_fields_cannot_be_forged(spark):
    page = '<head><title>T&amp;C &#8217;</title></head><header>Top</header><p>&copy;&nbsp;x</p><a href="x\r\nWARC: y?a=1&amp;b">l</a>'
    row = ("r", "u", "d", "g", None, "HTTP/1.1 200 OK\nA: b\r\n\r\nC: d", page, None, None)
    got = {r["warc_type"]: r for r in warc.derive(responses(spark, [row])).collect()}
    assert got["conversion"]["block"] == "Top\n© x\nl"
    assert got["metadata"]["block"].split("\r\n") == ["title: T&C ’", "language: ", "source-digest: g", "source-headers: HTTP/1.1 200 OK; A: b; C: d", "outlink: xWARC: y?a=1&b", ""]


def test_written_records_are_read_again(spark):
    rows = [("<urn:uuid:1>", "http://a/\r\nX: y", "2024-01-01T00:00:00Z", "sha1:X", None, HEADERS, PAGE, None, None), (None,) * 9]
    derived = warc.derive(responses(spark, rows))
    want = {(r["record_id"], r["block"]) for r in derived.collect()}
    data = b"".join(r["content"] for r in warc.to_records(derived).collect())
    records = list(warc.parse_records(data))
    assert {(h.get("warc-record-id"), b.decode()) for h, b in records} == want
    assert {h.get("warc-target-uri") for h, _ in records} == {"http://a/ X: y", None}
    assert {h.get("warc-refers-to") for h, _ in records} == {"<urn:uuid:1>", None}
