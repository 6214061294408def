"""Catalogs as a data source: feeds kept as files and asked over a local server, slow and broken ones too."""

import http.server
import json
import threading
import time
import urllib.parse

import pytest

from sifthouse.sources import catalogs, readers

RSS = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>x</title>%s</channel></rss>"""
ITEM = """<item><title>%s /</title><link>http://o/cgi?biblionumber=%d</link><description>&lt;p&gt;About &amp;amp; more&lt;/p&gt;</description><dc:creator>Lee, Ann</dc:creator><dc:identifier>ISBN 978-3-16-148410-0</dc:identifier></item>"""
DISCOVER = {"_embedded": {"searchResult": {"_embedded": {"objects": [
    {"hitHighlights": {"dc.title": ["a <em>t</em>"], "fulltext": ["in <em>full</em>"]}, "_embedded": {"indexableObject": {"handle": "1/2", "metadata": {
        "dc.title": [{"value": "Deep"}], "dc.date.issued": [{"value": "2019-05"}], "dc.identifier.doi": [{"value": "https://doi.org/10.1234/ab"}], "dc.contributor.author": [{"value": "A"}, {"value": "B"}]}}}},
    {"_embedded": {"indexableObject": {"handle": "1/3", "metadata": None}}}, {"_embedded": {}}]}}}}


@pytest.fixture(scope="module")
def server():
    class Feeds(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            path, _, query = self.path.partition("?")
            words = urllib.parse.parse_qs(query).get("q", [""])[0]
            if path == "/slow":
                time.sleep(4)
            body = {"/rss": RSS % "".join(ITEM % (f"Book {words} {i}", i) for i in range(2)), "/any": RSS % (ITEM % ("Either", 7) if " OR " in words else ""), "/html": "<html><body>sorry</body></html>"}.get(path)
            self.send_response(200 if body else 500)
            self.end_headers()
            self.wfile.write((body or "").encode())

        def log_message(self, *_):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Feeds) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{s.server_port}"
        s.shutdown()


def test_every_catalog_says_how_it_went(spark, server, tmp_path):
    (tmp_path / "page-1.json").write_text(json.dumps(DISCOVER))
    (tmp_path / "page-2.json").write_text("{}")
    (tmp_path / "bomb.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><rss>&a;</rss>')
    asked = [
        {"name": "books", "kind": "rss", "url": server + "/rss?q={words}&page={page}", "pages": 2}, {"name": "either", "kind": "rss", "url": server + "/any?q={words}"}, {"name": "late", "kind": "rss", "url": server + "/slow"},
        {"name": "ill", "kind": "rss", "url": server + "/none"}, {"name": "page", "kind": "rss", "url": server + "/html"}, {"name": "kept", "kind": "discover", "url": f"file://{tmp_path}/page-{{page}}.json", "pages": 3}, {"name": "bomb", "kind": "rss", "url": f"file://{tmp_path}/bomb.xml"}]
    read = lambda: catalogs.read_catalogs(spark, asked, "red wine", 1.0)
    rows = read().collect()
    status = {(r["catalog"], r["page"]): r["status"].split(":")[0] for r in rows if r["status"]}
    assert status == {
        ("books", 1): "ok", ("books", 2): "ok", ("either", 1): "any word", ("late", 1): "too late", ("ill", 1): "failed", ("page", 1): "failed", ("kept", 1): "ok", ("kept", 2): "failed", ("kept", 3): "failed", ("bomb", 1): "failed"}
    found = {(r["catalog"], r["page"], r["native_id"]): r for r in rows if r["rank"] is not None}
    assert set(found) == {("books", p, str(i)) for p in (1, 2) for i in (0, 1)} | {("either", 1, "7"), ("kept", 1, "1/2"), ("kept", 1, "1/3")}
    one, other = found["books", 1, "0"], found["kept", 1, "1/2"]
    assert (one["title"], one["description"], one["authors"], one["isbn"]) == ("Book red wine 0", "About & more", ["Lee, Ann"], ["9783161484100"])
    assert (other["title"], other["year"], other["doi"], other["highlight"], other["authors"]) == ("Deep", "2019", "10.1234/ab", "in full", ["A", "B"])
    assert found["kept", 1, "1/3"]["title"] == "1/3"
    assert read().rdd.getNumPartitions() == 10  # a catalog's pages are read beside each other
    assert {r["catalog"] for r in read().filter("catalog = 'books'").collect()} == {"books"}


def test_a_filter_leaves_a_catalogs_pages():
    reader = catalogs.CatalogReader({"catalogs": json.dumps([{"name": n, "kind": "rss", "url": "file:///none", "pages": 2} for n in "abc"])})
    kept = list(reader.pushFilters([catalogs.In(("catalog",), ("a", "c")), catalogs.EqualTo(("catalog",), "c"), catalogs.EqualTo(("title",), "x")]))
    assert len(kept) == 3 and [(p.catalog, p.page) for p in reader.partitions()] == [("c", 1), ("c", 2)]


def test_identifiers_and_files_of_marc_records(spark):
    field = lambda tag, *subs: f'<datafield tag="{tag}">' + "".join(f'<subfield code="{c}">{v}</subfield>' for c, v in subs) + "</datafield>"
    rows = [(1, "<record>" + field("245", ("a", "Title /")) + field("024", ("a", "978"), ("2", "isan")) + field("024", ("a", " 10.5/x "), ("2", "DOI")) + field("856", ("u", "http://a/b.pdf")) + field("856", ("u", "ftp://c")) + "</record>"),
            (2, "<record>" + field("024", ("a", "10.7/y")) + "</record>"), (3, "<record/>")]
    got = {r["title"]: (r["doi"], r["files"]) for r in readers.parse_marc(spark.createDataFrame(rows, "id long, x string"), "x").collect()}
    assert got["Title"] == ("10.5/x", ["http://a/b.pdf"])
    assert {r["doi"] for r in readers.parse_marc(spark.createDataFrame(rows[1:], "id long, x string"), "x").collect()} == {"10.7/y", None}
