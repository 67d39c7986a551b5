import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from skerry.llm import htmltext, urls, warc


@pytest.mark.parametrize(
    ("url", "host", "path"),
    [
        ("http://WWW.Example.com/en/1?x=/y#z", "www.example.com", "/en/1"),
        ("https://a.net", "a.net", ""),
        ("https://a.net?q=://b/", "a.net", ""),
        ("https://a.net#/es/", "a.net", ""),
        ("ftp://É.Example.org/ÀB", "É.example.org", "/ÀB"),
        ("no scheme/en/", "", ""),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_host_and_path(spark, url, host, path):
    df = spark.createDataFrame([(url,)], "url string").select(urls.host_of(F.col("url")).alias("h"), urls.path_of(F.col("url")).alias("p"))
    assert tuple(df.first()) == (host, path)


def test_rules_and_reputation(spark):
    rows = [(1, "http://example.com/en/a"), (2, "http://www.example.com/en/a"), (3, "http://x.www.example.com/en/"), (4, "http://notexample.com/en/"), (5, "http://a.net/es/"), (6, "http://a.net/de/"), (7, "http://spam.org/1"), (8, None), (9, "http://com/")]
    rows += [(100 + i, f"http://bad{i % 5}.spam.org/{i}") for i in range(200)] + [(400 + i, f"http://good{i % 5}.fine.org/{i}") for i in range(200)] + [(7, "http://spam.org/1"), (None, "http://b.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, True) for i in range(190)] + [(400 + i, i % 10 == 0) for i in range(190)] + [(None, True)], "page long, bad boolean")
    got = {r.page_id: r for r in urls.judge_urls(pages, labels).collect()}
    assert urls.judge_urls(pages, labels).count() == len(rows)
    assert [got[i].rule for i in (1, 2, 3, 4, 5, 6, 8, 9)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "com/", "net/es/", None, None, "com/"]
    assert [got[i].verdict for i in (1, 2, 3, 4, 5, 6)] == ["block", "allow", "allow", "allow", "block", "allow"]
    assert got[7].verdict == "block", "an unlabelled host follows its domain"
    assert all(got[100 + i].verdict == "block" and got[400 + i].verdict == "allow" for i in range(200))
    assert urls.judge_urls(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages.filter("page_id = 7"), labels.limit(0)).collect()} == {"allow"}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header>Head</header>
<nav><ul><li><a href="/a">A</a><li>B</ul></nav><!-- <p>gone</p> --><div class="ad">Buy, now.</div><div class="notice">We use cookies, really.</div>
<article><h1>Title &lt;1&gt;</h1><p><b>One,\n two<i>three</i>.<br><p>Caf&eacute; &#8212; x&nbsp;y.</p><aside>Side, note.</aside><form>Your name <input></form><p></p><p>Ok.</article>
<section id="comments"><p>I like it, very much so, it is great.</p></section><footer>&copy; me</footer></body>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Title <1> One, twothree. Café — x y. Ok."
    for empty in (None, "", "   ", "<html><body></body></html>", "<nav>menu</nav>"):
        assert htmltext.main_text(empty) == ""
    assert htmltext.main_text("<p>Just one paragraph, no article.") == "Just one paragraph, no article."
    long = "word, " * 200_000
    assert htmltext.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert "Head" in htmltext.plain_text(PAGE) and "var t" not in htmltext.plain_text(PAGE)


def test_fragments_keep_all_blocks():
    assert htmltext.main_text("<h1>T</h1><p>long one</p><p>long two</p>") == "T long one long two"
    assert htmltext.main_text("Bare text, no tag.") == "Bare text, no tag."
    assert htmltext.main_text("Bare, first.<p>Then a block.</p><nav>menu</nav>") == "Bare, first. Then a block."


def test_extract_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (None, None, None)], "page_id long, html string, text string")
    out = htmltext.extract(df)
    assert out.columns == ["page_id", "html", "text"] and sorted(r.text for r in out.collect())[0] == ""
    assert out.count() == 3 and htmltext.extract(df.limit(0)).count() == 0


def test_derivatives(spark, tmp_path):
    body = "<p>Hällo &amp; bye</p><p>two</p>".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-A: 1\r\nX-A: 2\r\n\r\n" + body
    zipped = b"HTTP/1.1 404 Not Found\r\nContent-Encoding: gzip\r\nContent-Type: text/plain\r\n\r\n" + gzip.compress(b"plain")
    source = [warc.serialise([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Target-URI", "http://x/"), ("WARC-Date", "2024"), ("Content-Length", str(len(m)))], m) for i, m in enumerate((http, zipped))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in source))
    (tmp_path / "b.warc").write_bytes(b"".join(source))
    responses = warc.read_responses(spark, str(tmp_path))
    assert responses.count() == 4
    got = warc.derivatives(responses.dropDuplicates(["record_id"])).collect()
    assert len(got) == 4
    for row in got:
        headers, block = next(warc.parse(bytes(row.record)))
        assert headers["WARC-Refers-To"] == row.refers_to and headers["WARC-Record-ID"] == row.record_id == warc.record_uri(row.refers_to, row.kind)
        assert bytes(row.block) == block and headers["WARC-Block-Digest"] == warc.digest(block) and int(headers["Content-Length"]) == row.content_length
    by = {(r.refers_to, r.kind): bytes(r.block).decode() for r in got}
    assert by["<urn:0>", "conversion"] == "Hällo & bye\ntwo" and by["<urn:1>", "conversion"] == "plain"
    assert "http-header: X-A: 1\r\nhttp-header: X-A: 2" in by["<urn:0>", "metadata"] and hashlib.sha1(body).digest()
    nulls = spark.createDataFrame([(None, None, None, None, 5)], "record_id string, target_uri string, date string, message binary, kind int")
    assert warc.derivatives(nulls).count() == 2 and warc.derivatives(nulls.limit(0)).count() == 0


def test_registered_domains(spark, tmp_path):
    (tmp_path / "rules").write_text("// a list\n\nco.uk\n*.ck\n!www.ck\ngithub.io  note\na.b.c\n")
    rules = urls.Suffixes.read(str(tmp_path / "rules"))
    want = {
        "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.b.foo.ck": ("b.foo.ck", "foo.ck"), "www.ck": ("www.ck", "ck"), "x.www.ck": ("www.ck", "ck"), "ck": ("ck", "ck"), "me.github.io": ("me.github.io", "github.io"),
        "q.a.b.c": ("q.a.b.c", "a.b.c"), "z.q.a.b.c:8080": ("q.a.b.c", "a.b.c"), "b.c": ("b.c", "c"), "10.0.0.1": ("10.0.0.1", ""), "10.0.0.1:80": ("10.0.0.1", ""), "": ("", ""), "localhost": ("localhost", "localhost"), "a.com:": ("a.com", "com"),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r.h: (r.d, r.s) for r in df.select("h", *[c.alias(n) for c, n in zip(rules.of(F.col("h")), "ds")]).collect()} == want


def test_urls_with_clashing_columns_and_long_urls(spark):
    long = "http://a.org/" + "x" * 200_000 + "?q"
    pages = spark.createDataFrame([(1, long, "h", "p", 1), (1, long, "h", "p", 1), (2, "http://a.org:8080/y", None, None, 2)], "page_id long, url string, host string, page string, n int")
    labels = spark.createDataFrame([(1, True, "z"), (1, True, "z")], "page long, bad boolean, host string")
    got = sorted((r.page_id, r.host, len(r.path), r.rule) for r in urls.judge_urls(pages, labels).collect())
    assert got == [(1, "a.org", 200_001, None), (1, "a.org", 200_001, None), (2, "a.org:8080", 2, None)]


def brute_parse(data):
    """Records of a plain, well-formed file, read line by line."""
    out, at = [], 0
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        fields = [tuple(x.split(b": ", 1)) for x in head.split(b"\r\n")[1:]]
        size = int(dict(fields)[b"Content-Length"])
        out.append((fields, rest[:size]))
        at += len(head) + 4 + size + 4
    return out


def test_records_equal_brute_force(spark):
    """Every record of odd responses, read again by a plain reader: nothing of a value becomes a header or a record of its own."""
    import base64
    import uuid

    sources = [
        (1, "<urn:1>", "http://x/\nWARC-Type: response", "2024\r\nX: 1", b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nA: 1\r\n b\r\n\r\nWARC/1.1\r\n\r\n", "WARC-Payload-Digest: sha1:ABC\nWARC-Truncated: length\nX-Other: no"),
        (2, "<urn:2>", None, None, b"no header at all", None),
        (3, None, "http://y/", "2023", None, ""),
        (4, "<urn:4>", "http://z/\x85q r", "d", b"HTTP/1.1 200\nContent-Type: text/html; charset=latin-1\n\n<p>\xe9t\xe9</p>", "warc-payload-digest: md5:z"),
        (4, "<urn:4>", "http://z/\x85q r", "d", b"HTTP/1.1 200\nContent-Type: text/html; charset=latin-1\n\n<p>\xe9t\xe9</p>", "warc-payload-digest: md5:z"),
    ]
    df = spark.createDataFrame([(*s, "extra") for s in sources], "n int, record_id string, target_uri string, date string, message binary, headers string, kind string")
    rows = warc.derivatives(df, key="n").collect()
    assert len(rows) == 2 * len(sources)
    for n, rid, target, date, message, headers in sources:
        payload = {1: b"WARC/1.1\r\n\r\n", 2: message, 3: b"", 4: b"<p>\xe9t\xe9</p>"}[n]
        sha = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for kind in ("metadata", "conversion"):
            row = next(r for r in rows if r.n == n and r.kind == kind)
            (fields, block), = brute_parse(bytes(row.record))
            assert [k.decode() for k, _ in fields] == ["WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Source-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length"]
            by = {k.decode(): v.decode() for k, v in fields}
            assert by["WARC-Type"] == kind and by["WARC-Refers-To"] == (rid or "") and block == bytes(row.block)
            assert by["WARC-Record-ID"] == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid or str()}/{kind}')}>"
            assert by["WARC-Source-Payload-Digest"] == {1: "sha1:ABC", 4: "md5:z"}.get(n, sha)
            assert by["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            if kind == "conversion":
                assert block.decode() == {1: "WARC/1.1\r\n\r\n", 2: "no header at all", 3: "", 4: "été"}[n]
            elif n == 1:
                assert block.decode().split("\r\n") == ["http-status: HTTP/1.1 200 OK", "http-header: Content-Type: text/plain", "http-header: A: 1 b", f"payload-length: {len(payload)}", f"payload-digest: {sha}", "source-header: WARC-Payload-Digest: sha1:ABC", "source-header: WARC-Truncated: length", ""]


def test_codings_and_malformed_records(spark, tmp_path):
    import zlib

    body = b"plain text, " * 50
    cut = gzip.compress(body)[:-20]
    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(body) + raw.flush()
    cases = [("Content-Encoding: deflate", zlib.compress(body), body), ("Content-Encoding: deflate", raw, body), ("Content-Encoding: x-gzip", gzip.compress(body), body), ("Transfer-Encoding: chunked", chunked, b"hello world"), ("Transfer-Encoding: chunked", b"not chunked", b"not chunked"), ("Content-Encoding: br", b"\x01", b""), ("Content-Encoding: gzip", b"junk", b""), ("Content-Encoding: identity", body, body)]
    for header, payload, want in cases:
        got = warc.derive("<i>", "t", "d", f"HTTP/1.1 200 OK\r\n{header}\r\nContent-Type: text/plain; charset=nonsense\r\n\r\n".encode() + payload)
        assert got[1]["block"] == want, header
    assert body.startswith(warc.derive("<i>", "t", "d", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/plain\r\n\r\n" + cut)[1]["block"])
    good = warc.serialise([("WARC-Type", "response"), ("warc-record-id", "<urn:9>"), ("Content-Length", "3")], b"abc")
    odd = [b"WARC/1.0\r\nContent-Length: many\r\n\r\n", b"WARC/1.0\r\nContent-Length: -4\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\n\r\n"]
    found = list(warc.parse(b"".join(odd) + good + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut"))
    assert [b for _, b in found] == [b"", b"", b"", b"abc"] and found[3][0].get("WARC-Record-ID") == "<urn:9>" == found[3][0]["WARC-RECORD-ID"]
    broken = bytearray(gzip.compress(good * 40))
    broken[30:60] = bytes(30)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(good) + bytes(broken) + gzip.compress(good))
    assert [(r.record_id, bytes(r.message)) for r in warc.read_responses(spark, str(tmp_path)).collect()].count(("<urn:9>", b"abc")) >= 2
    assert list(warc.parse(b"")) == []
