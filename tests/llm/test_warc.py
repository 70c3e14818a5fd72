import base64
import hashlib
import html.parser
import json
import re
import time

from conftest_llm import rows
from pyspark.sql import functions as F

from loomslice.llm import queries, warc

PAGE = """<!doctype html><html lang="de"><head><title>Ein &amp; Titel</title><style>p {x: 1}</style></head><body>
<!-- <p>hidden</p> --><script>var a = "<p>no</p>";</script><h1>Kopf</h1><p>Erster   Absatz mit <a href="/a?x=1&amp;y=2">Link</a>.<br>Neue&nbsp;Zeile</p>
<ul><li>eins<li>zwei</ul><a href='b'>b</a> <a href=c>c</a></body></html>"""

SCHEMA = "record_id string, target_uri string, date string, http_headers string, payload_digest string, payload string"


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_text_and_description():
    assert warc.plain_text(PAGE).split("\n") == ["Kopf", "Erster Absatz mit Link.", "Neue Zeile", "eins", "zwei", "b c"]
    d = warc.describe(PAGE, {"A": "b"})
    assert (d["title"], d["language"], d["outlinks"], d["source_headers"]) == ("Ein & Titel", "de", ["/a?x=1&y=2", "b", "c"], {"A": "b"})


def test_records_link_to_their_source(spark):
    src = ("<urn:uuid:1>", "http://x/", "2020-01-01T00:00:00Z", '{"Status": "200 OK"}', "sha1:GIVEN", PAGE)
    got = {r["record_type"]: r for r in warc.derivatives(spark.createDataFrame([src], SCHEMA)).collect()}
    assert set(got) == {"conversion", "metadata"}
    for kind, r in got.items():
        fields = dict(line.split(": ", 1) for line in r["headers"].strip().split("\r\n")[1:])
        assert r["headers"].startswith("WARC/1.1\r\n") and r["headers"].endswith("\r\n\r\n")
        assert fields["WARC-Type"] == kind and fields["WARC-Refers-To"] == r["refers_to"] == "<urn:uuid:1>"
        assert fields["WARC-Target-URI"] == "http://x/" and fields["WARC-Refers-To-Date"] == "2020-01-01T00:00:00Z"
        assert fields["WARC-Source-Payload-Digest"] == "sha1:GIVEN"
        assert fields["WARC-Block-Digest"] == sha1(r["block"]) and int(fields["Content-Length"]) == len(r["block"].encode())
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
    assert json.loads(got["metadata"]["block"])["source_headers"] == {"Status": "200 OK"}
    assert got["conversion"]["block"] == warc.plain_text(PAGE) and got["conversion"]["record_id"] != got["metadata"]["record_id"]


def test_query_covers_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    out = queries.op1_warc(spark, sf)
    assert out.count() == 2 * pages.count() == out.select("record_id").distinct().count()
    src = {r["record_id"]: r for r in warc.responses_of_pages(pages).collect()}
    for r in out.collect():
        assert r["refers_to"] in src and r["source_digest"] == sha1(src[r["refers_to"]]["payload"] or "")
        assert r["block_digest"] == sha1(r["block"]) and "<" + "p>" not in r["block"].lower() or r["record_type"] == "metadata"
    assert rows(out) == rows(queries.op1_warc(spark, sf))  # runs agree, ids included


def test_serialised_records_read_back(spark, sf):
    """A plain reader walks the records by Content-Length alone."""
    made = warc.warc_text(queries.op1_warc(spark, sf)).collect()
    data = "".join(r["record"] for r in made).encode()
    at, seen = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().strip().split("\r\n")[1:])
        body = data[end : end + int(fields["Content-Length"])]
        assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        at = end + len(body)
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
        seen.append(fields["WARC-Record-ID"])
    assert seen == [r["record_id"] for r in made]


def test_odd_pages(spark):
    data = [("a", None, None, None, None, None), ("a", None, None, "not json", "", ""), ("b", "u", "d", "{}", None, "<p"), ("b", "u", "d", "{}", None, "<p"), (None, "u", "d", "[]", None, "<script>" * 2000), ("c", "u", "d", None, None, "&lt;b&gt; &#0; \x85 " + "x" * 100_000)]
    df = spark.createDataFrame(data, SCHEMA)
    out = warc.derivatives(df)
    assert out.count() == 12 and out.where("record_type = 'conversion' and block is null").count() == 0
    assert "WARC-Target-URI" not in out.where("source_id = 'a'").first()["headers"]
    assert out.where("source_id = 'b'").select("record_id").distinct().count() == 2
    more = df.select("*", F.lit(1).alias("block"), F.lit(2).alias("RECORD_ID"), F.lit(3).alias("source_id"))
    assert rows(warc.derivatives(more), "record_id", "block", "headers") == rows(out, "record_id", "block", "headers")
    assert warc.derivatives(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(None, None, None), (1, None, "<p>x"), (1, None, "<p>x")], "page_id long, url string, html string")
    assert warc.derivatives(warc.responses_of_pages(pages)).count() == 6


def test_hostile_pages_take_linear_time():
    began = time.process_time()
    for unit in ("<a ", "<script>", "<!-- ", "<a href='", "</script ", "<title>", "<p <p", "<html lang=", "&amp<", "<head>"):
        page = unit * (1_000_000 // len(unit))
        warc.plain_text(page)
        warc.describe(page, {})
    assert time.process_time() - began < 30  # a second or so each, with room for a slow machine


def test_values_cannot_add_header_lines(spark):
    src = ("<urn:uuid:1>", "http://x/\r\nInjected: yes", "2020", "{}", None, "x")
    for r in warc.derivatives(spark.createDataFrame([src], SCHEMA)).collect():
        assert not any(line.startswith("Injected") for line in r["headers"].split("\r\n"))


def test_responses_without_an_id_have_records_of_their_own(spark):
    data = [(None, "u1", "d", "{}", None, "x"), (None, "u2", "d", "{}", None, "x"), (None, "u1", "d", "{}", None, "y")]
    out = warc.derivatives(spark.createDataFrame(data, SCHEMA))
    assert out.select("record_id").distinct().count() == 6 and out.where("headers like '%WARC-Refers-To:%'").count() == 0


class Reader(html.parser.HTMLParser):
    """Text and links of a page by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc._HIDDEN
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]
        self.out.append("\n" if tag in warc._BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in warc._HIDDEN
        self.out.append("\n" if tag in warc._BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_text_and_links_are_brute_force(spark, sf):
    """On all pages of the table whose tags are balanced where it matters."""
    pages = [r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    seen = 0
    for page in pages:
        reader = Reader()
        reader.feed(page)
        reader.close()
        if reader.hidden:
            continue
        seen += 1
        lines = ["".join(re.split(r"\s", x)) for x in "".join(reader.out).split("\n")]
        assert ["".join(re.split(r"\s", x)) for x in warc.plain_text(page).split("\n") if x] == [x for x in lines if x]
        assert warc.describe(page, {})["outlinks"] == reader.links
    assert seen > 0.9 * len(pages)
