"""Library catalogs as a Spark data source: a partition for each catalog and page, records as rows, and a status row for each page asked.

``read_catalogs`` registers the source and asks; ``spark.read.format("catalogs")`` does so with the
options ``catalogs`` (JSON: a list of name, kind, url and pages), ``words`` and ``timeout``, where
``spark.sql.python.filterPushdown.enabled`` is set. A url holds ``{words}`` and ``{page}``; it may name files of feeds that were kept. A catalog that
fails, answers too late or with something else costs its own rows alone.
"""

from __future__ import annotations

import html
import json
import re
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = ("catalog string, page int, status string, hits int, rank int, native_id string, title string, url string, description string, "
          "authors array<string>, isbn array<string>, year string, doi string, highlight string")
#: Bytes of an answer that are read: a feed that never ends is broken.
MOST_BYTES = 32 << 20

# What feeds' records and numbers look like.
RECORD = r"biblionumber=(\d+)"
ISBN = r"\b(?:97[89][- ]?)?(?:\d[- ]?){9}[\dXx]\b"
YEAR, DOI = r"\b(1[5-9]\d\d|20\d\d)\b", r"(10\.\d{4,9}/\S+)"
ENDS = " /:;,.="
# End of fixed values.


class Broken(Exception):
    """An answer that is no feed."""


def _plain(text: str | None) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", html.unescape(text or ""))).split())


def rss_records(payload: bytes) -> Iterator[dict]:
    """Records of an RSS or Atom feed that link to a catalog's record."""
    if b"<!ENTITY" in payload or b"<!DOCTYPE" in payload[:4096]:
        raise Broken("a feed with entities of its own")
    try:
        root = ElementTree.fromstring(payload)
    except ElementTree.ParseError as e:
        raise Broken(f"no feed: {e}") from e
    if re.sub(r"^\{.*\}", "", root.tag).lower() not in ("rss", "feed", "rdf"):
        raise Broken(f"no feed but {root.tag}")
    for item in (e for e in root.iter() if re.sub(r"^\{.*\}", "", e.tag) in ("item", "entry")):
        said: dict[str, str] = {}
        for c in item:
            said.setdefault(re.sub(r"^\{.*\}", "", c.tag), (c.text or "").strip() or c.get("href", ""))
        link = next((said[k] for k in ("link", "guid", "id") if said.get(k)), "")
        if found := re.search(RECORD, link):
            yield {
                "native_id": found[1], "title": _plain(said.get("title")).rstrip(ENDS) or f"Record {found[1]}", "url": link, "description": _plain(said.get("description") or said.get("summary")) or None,
                "authors": [a for a in [_plain(said.get("creator"))] if a], "isbn": [re.sub("[- ]", "", x).upper() for x in re.findall(ISBN, said.get("identifier", ""))]}


def discover_records(payload: bytes) -> Iterator[dict]:
    """Records of a discovery answer in JSON; of the places a word was found in, the full text's comes first, then the abstract's."""
    try:
        found = json.loads(payload)["_embedded"]["searchResult"]["_embedded"]["objects"]
    except (ValueError, KeyError, TypeError) as e:
        raise Broken(f"no discovery answer: {e!r}") from e
    for one in found:
        item = (one.get("_embedded") or {}).get("indexableObject") or {}
        meta = item.get("metadata") or {}
        all_ = lambda k, meta=meta: [v["value"] for v in meta.get(k, []) if v.get("value")]
        marks = one.get("hitHighlights") or {}
        best = next((marks[k] for k in ("fulltext", "dc.description.abstract", *marks) if marks.get(k)), [None])
        year, doi = re.search(YEAR, "".join(all_("dc.date.issued")[:1])), re.search(DOI, "".join(all_("dc.identifier.doi")[:1]))
        if item.get("handle"):
            yield {
                "native_id": item["handle"], "title": _plain("".join(all_("dc.title")[:1])) or item["handle"], "url": (all_("dc.identifier.uri") or [None])[0], "description": _plain("".join(all_("dc.description.abstract")[:1])) or None,
                "authors": all_("dc.contributor.author"), "isbn": [re.sub("[- ]", "", x).upper() for v in all_("dc.identifier.isbn") for x in re.findall(ISBN, v)],
                "year": year and year[1], "doi": doi and doi[1], "highlight": _plain(best[0]) or None}


KINDS = {"rss": rss_records, "discover": discover_records}


@dataclass
class Page(InputPartition):
    catalog: str
    kind: str
    url: str
    page: int


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.words = options.get("words", "").split()
        self.timeout = float(options.get("timeout", "10"))
        self.catalogs = json.loads(options["catalogs"])
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A filter on catalogs leaves their pages alone; Spark applies it to the rows too."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("catalog",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            yield f

    def partitions(self) -> list[Page]:
        return [Page(c["name"], c["kind"], c["url"], n) for c in self.catalogs if self.only is None or c["name"] in self.only for n in range(1, 1 + int(c.get("pages", 1)))]

    def _ask(self, part: Page, words: str) -> list[dict]:
        url = part.url.replace("{words}", urllib.parse.quote(words)).replace("{page}", str(part.page))
        with urllib.request.urlopen(url, timeout=self.timeout) as answer:
            payload = answer.read(MOST_BYTES + 1)
        if len(payload) > MOST_BYTES:
            raise Broken("an answer without end")
        return list(KINDS[part.kind](payload))

    def read(self, part: Page) -> Iterator[tuple]:
        """A page's status, then its records; words that find nothing together are asked for as alternatives."""
        rows: list[dict] = []
        try:
            rows = self._ask(part, " ".join(self.words))
            status = "ok"
            if not rows and part.page == 1 and len(self.words) > 1 and "{words}" in part.url:
                rows, status = self._ask(part, " OR ".join(self.words)), "any word"
        except TimeoutError:
            status = "too late"
        except (OSError, ValueError, KeyError, Broken) as e:
            # a time-out while connecting comes as an error of its own
            status = "too late" if isinstance(getattr(e, "reason", None), TimeoutError) else f"failed: {type(e).__name__}: {e}"[:300]
        yield (part.catalog, part.page, status, len(rows), *[None] * 10)
        for i, r in enumerate(rows):
            yield (part.catalog, part.page, None, None, i, *(r.get(k) for k in ("native_id", "title", "url", "description", "authors", "isbn", "year", "doi", "highlight")))


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(self.options)


def read_catalogs(spark: SparkSession, catalogs: list[dict], words: str, timeout: float = 10.0) -> DataFrame:
    """Rows of all ``catalogs`` for ``words``: a status for each page, and its records."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)
    return spark.read.format("catalogs").option("catalogs", json.dumps(catalogs)).option("words", words).option("timeout", str(timeout)).load()
