"""Sources: folders, text, tables, HTML pages and catalog feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import html_title, kind_of, strip_html

#: Folder names that a scan passes over.
IGNORED = ["node_modules", "__pycache__", "$recycle.bin", "system volume information", "thumbnails"]


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """``rel_path, name, ext, kind, size, mtime`` of the files below a folder, without hidden and ignored ones; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = root.removeprefix("file://").rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    parts = F.split(rel, "/")
    shown = ~F.exists(parts, lambda p: p.startswith(".") | F.lower(p).isin(IGNORED))
    name = F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.filter(shown).select(rel.alias("rel_path"), name.alias("name"), ext.alias("ext"), kind_of(ext).alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV file with all cells as text; the first row names the columns."""
    return spark.read.option("header", "true").option("inferSchema", "false").option("sep", sep).csv(path)


def extract_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, html_title(F.col(html)).alias("title"), strip_html(F.col(html)).alias("text"))


def parse_rss(feeds: DataFrame, xml: str) -> DataFrame:
    """One row for each item of RSS feeds: ``title, link, description, isbn``."""
    values = lambda path: F.xpath(F.col(xml), F.lit(path))
    zipped = F.arrays_zip(values("//item/title/text()").alias("title"), values("//item/link/text()").alias("link"), values("//item/description/text()").alias("description"))
    item = feeds.select(F.explode(zipped).alias("i")).select("i.*").toDF("title", "link", "description")
    return item.withColumn("isbn", F.nullif(F.regexp_extract("description", r"ISBN:?\s*([0-9Xx-]{10,17})", 1), F.lit("")))


def parse_marc(records: DataFrame, xml: str) -> DataFrame:
    """Fields of MARCXML records: ``title, authors, publisher, year, subjects, abstract, isbn, doi, files``.

    The DOI is the first of field 024 that says it is one or looks like one; files are the web
    addresses of field 856.
    """
    def sub(tag: str, code: str):
        return F.xpath(F.col(xml), F.lit(f"//*[local-name()='datafield'][@tag='{tag}']/*[local-name()='subfield'][@code='{code}']/text()"))

    first = lambda *cols: F.get(F.concat(*cols), F.lit(0))
    marked = "*[local-name()='subfield'][@code='2'][translate(text(), 'DOI', 'doi')='doi']"
    said_doi = F.xpath(F.col(xml), F.lit(f"//*[local-name()='datafield'][@tag='024'][{marked}]/*[local-name()='subfield'][@code='a']/text()"))
    return records.select(
        F.trim(F.regexp_replace(first(sub("245", "a")), r"[ /:;]+$", "")).alias("title"), F.concat(sub("100", "a"), sub("110", "a"), sub("700", "a"), sub("710", "a")).alias("authors"),
        first(sub("264", "b"), sub("260", "b")).alias("publisher"), F.regexp_extract(F.coalesce(first(sub("264", "c"), sub("260", "c")), F.lit("")), r"(\d{4})", 1).alias("year"),
        F.concat(sub("650", "a"), sub("651", "a"), sub("653", "a")).alias("subjects"), first(sub("520", "a")).alias("abstract"), first(sub("020", "a")).alias("isbn"),
        F.trim(first(F.concat(said_doi, F.filter(sub("024", "a"), lambda x: F.trim(x).startswith("10."))))).alias("doi"), F.filter(sub("856", "u"), lambda u: u.rlike("^https?://")).alias("files"))


def parse_discover(responses: DataFrame, json: str) -> DataFrame:
    """Records of discover responses: ``handle, title, year, doi, highlight`` (full text before abstract before others)."""
    meta = "array<struct<value:string>>"
    schema = f"struct<_embedded:struct<searchResult:struct<_embedded:struct<objects:array<struct<hitHighlights:map<string,array<string>>,_embedded:struct<indexableObject:struct<handle:string,metadata:map<string,{meta}>>>>>>>>>"
    obj = responses.select(F.explode(F.from_json(json, schema)["_embedded"]["searchResult"]["_embedded"]["objects"]).alias("o"))
    item, marks = F.col("o._embedded.indexableObject"), F.col("o.hitHighlights")
    value = lambda k: F.try_element_at(item["metadata"], F.lit(k))["value"][0]
    best = F.coalesce(F.try_element_at(marks, F.lit("fulltext"))[0], F.try_element_at(marks, F.lit("dc.description.abstract"))[0], F.get(F.flatten(F.map_values(marks)), F.lit(0)))
    return obj.select(item["handle"].alias("handle"), value("dc.title").alias("title"), F.regexp_extract(F.coalesce(value("dc.date.issued"), F.lit("")), r"(\d{4})", 1).alias("year"),
                      F.regexp_extract(F.coalesce(value("dc.identifier.doi"), F.lit("")), r"(10\.\S+)", 1).alias("doi"), F.regexp_replace(best, "<[^>]+>", "").alias("highlight"))


def federate(found: dict[str, DataFrame | Exception]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Catalog results tagged with their catalog, and a status for each; a failed catalog is a status, not an error."""
    status, rows = [], None
    for name, result in found.items():
        if isinstance(result, Exception):
            status.append((name, f"failed: {result}"))
            continue
        status.append((name, "ok"))
        tagged = result.withColumn("catalog", F.lit(name))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    return rows, status
