"""Removing repeats of records: web results, catalog records, bursts of pictures, topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scores import hamming
from ..functions.text import isbn13, norm_title, normalize_url, record_title, surname, title_key
from ..session import discard, settle
from .graph import connected_components


#: Letters and digits that a title needs to name a record.
TITLE_KEY_LEAST = 10


def first_by(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    named = rows.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    w = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy(*order)
    return named.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", *(f"_k{i}" for i in range(len(keys))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def novel(candidates: DataFrame, seen: DataFrame, key: str, url: str = "url", title: str = "title") -> DataFrame:
    """Candidates whose URL, and title of more than eight characters, none of ``seen`` has; of equal ones the smallest key."""
    c = candidates.withColumn("_u", normalize_url(F.col(url))).withColumn("_t", title_key(F.col(title)))
    urls = seen.select(normalize_url(F.col(url)).alias("_u")).distinct()
    titles = seen.select(title_key(F.col(title)).alias("_t")).filter(F.length("_t") > 8).distinct()
    return first_by(c.join(urls, "_u", "left_anti").join(titles, "_t", "left_anti"), [F.col("_u")], [F.col(key)]).drop("_u", "_t")


def title_words(title: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(norm_title(title), " "), lambda w: w != "")))


def similar_titles(rows: DataFrame, key: str, title: str, percent: int = 85) -> DataFrame:
    """``a < b``: pairs of different title word sets, named by the smallest key that has them, whose Jaccard similarity is ``percent`` or more.

    Words are ordered rare first by the number of sets they are in; two similar sets share one of
    the first words of that order, so pairs are joined on those, must pass the length and the
    positional filter, and are verified under the first word they share.
    """
    sets = settle(rows.select(F.col(key).alias("id"), title_words(F.col(title)).alias("w")).filter(F.size("w") > 0).groupBy("w").agg(F.min("id").alias("id")))
    spread = sets.select("id", F.explode("w").alias("t"))
    often = spread.groupBy("t").agg(F.count("*").alias("often"))
    ranked = spread.join(often, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "t"))).alias("r")).select("id", F.col("r.t").alias("w"))
    n = F.size("w")
    prefix = settle(ranked.select("id", "w", n.alias("n"), F.posexplode(F.slice("w", F.lit(1), (n - F.ceil(n * F.lit(percent) / F.lit(100)) + 1).cast("int"))).alias("at", "t")))
    a, b = prefix.toDF("a", "wa", "na", "pa", "t"), prefix.toDF("b", "wb", "nb", "pb", "t")
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - F.lit(1e-9))
    room = F.lit(1) + F.least("pa", "pb") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    met = a.join(b, "t").filter((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (room >= need))
    first = F.arrays_overlap(F.slice("wa", F.lit(1), F.col("pa")), F.slice("wb", F.lit(1), F.col("pb")))
    shared = F.size(F.array_intersect("wa", "wb"))
    return met.filter(~first & (100 * shared >= percent * (F.col("na") + F.col("nb") - shared))).select("a", "b")


def catalog_keys(records: DataFrame) -> DataFrame:
    """``id, k`` of what names a record: DOI, ISBNs, handle, and its title with the first author's surname, or with the year where no author is known."""
    title, who = record_title(F.col("title")), surname(F.get("authors", F.lit(0)))
    long = F.length(title) >= TITLE_KEY_LEAST
    isbns = F.transform(F.filter(F.transform(F.coalesce("isbns", F.array().cast("array<string>")), isbn13), lambda i: i.isNotNull()), lambda i: F.concat(F.lit("isbn:"), i))
    one = F.array(
        F.concat(F.lit("doi:"), F.lower(F.trim("doi"))), F.concat(F.lit("hdl:"), F.lower(F.trim("handle"))),
        F.when(long & (who != ""), F.concat(F.lit("t:"), title, F.lit("|"), who)).when(long & ((who == "") | who.isNull()) & F.col("year").isNotNull(), F.concat(F.lit("t:"), title, F.lit("|"), F.col("year").cast("string"))))
    return records.select("id", F.explode(F.array_distinct(F.concat(F.filter(one, lambda k: k.isNotNull()), isbns))).alias("k"))


def fold_catalog(records: DataFrame) -> DataFrame:
    """``id, head``: records joined by any shared key, under the smallest ``id`` of each group."""
    keys = settle(catalog_keys(records))
    first = keys.groupBy("k").agg(F.min("id").alias("head"))
    edges = keys.join(first, "k").filter("id <> head").select(F.col("head").alias("src"), F.col("id").alias("dst"))
    parts = connected_components(edges)
    return records.select("id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("head"))


def merge_catalog(records: DataFrame) -> DataFrame:
    """One row for each group of copies: the best-scored record with the fields it lacks from the next best, and ``also_in`` of the others.

    ``records(id, source, score, doi, handle, isbns, title, authors, year, abstract, subjects)``;
    equal scores rank by ``id``. ISBNs and subjects are those of all, in rank order.
    """
    heads = fold_catalog(records)
    fields = [c for c in records.columns if c not in ("id", "source", "score", "isbns", "subjects")]
    rank = F.struct((-F.col("score")).alias("s"), "id")
    group = records.join(heads, "id").groupBy("head")
    row = F.struct(rank.alias("rank"), "source", "isbns", "subjects")
    listed = lambda c: F.array_distinct(F.flatten(F.transform("rows", lambda r: F.coalesce(r[c], F.array().cast("array<string>")))))
    merged = group.agg(F.array_sort(F.collect_list(row)).alias("rows"), *(F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in fields))
    return merged.select(
        F.col("rows")[0]["rank"]["id"].alias("id"), F.col("rows")[0]["source"].alias("source"), (-F.col("rows")[0]["rank"]["s"]).alias("score"), *fields,
        listed("isbns").alias("isbns"), F.slice(listed("subjects"), 1, 15).alias("subjects"),
        F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: F.struct(r["source"].alias("source"), r["rank"]["id"].alias("id"))).alias("also_in"))


def local_copies(records: DataFrame, files: DataFrame) -> DataFrame:
    """``id, file``: catalog records of which a file of the same title is there; the smallest file stands for all."""
    key = lambda c: record_title(F.translate(F.regexp_replace(F.col(c), r"\.[A-Za-z0-9]{1,5}$", ""), "_-", "  "))
    titles = files.select("file", key("name").alias("t")).filter(F.length("t") >= TITLE_KEY_LEAST).groupBy("t").agg(F.min("file").alias("file"))
    return records.select("id", record_title(F.col("title")).alias("t")).join(titles, "t").select("id", "file")


def _gone_in_order(edges: DataFrame, group: str) -> DataFrame:
    """``group, b``: the nodes that a pass in order drops, where a node goes if one before it that is kept has an edge ``a`` to ``b``.

    In each round the nodes that wait for none are kept, and drop those after them; edges of what
    is decided go, so only open nodes are looked at. Where a round decides little, chains are
    followed: a node that waits for one other is the opposite of that one, and along such nodes
    pointers double, so a chain of any length is decided in a logarithm of steps.
    """
    b_as_a = lambda t: t.select(group, F.col("b").alias("a"))
    live, gone, slow = settle(edges.select(group, "a", "b")), None, False
    left = live.count()
    while left:
        waits = settle(live.groupBy(group, "b").agg(F.count("*").alias("n"), F.min("a").alias("a")))
        over = live.join(b_as_a(waits), [group, "a"], "left_anti").select(group, "b")
        if slow:
            # ``same`` says whether a node is as its end; ends that wait for none are kept
            chain = settle(waits.filter("n = 1").select(group, "b", "a", F.lit(False).alias("same")))
            while True:
                up = chain.select(group, F.col("b").alias("a"), F.col("a").alias("further"), F.col("same").alias("as_further"))
                step = settle(chain.join(up, [group, "a"], "left").select(
                    group, "b", F.coalesce("further", "a").alias("a"), F.when(F.col("further").isNull(), F.col("same")).otherwise(F.col("same") == F.col("as_further")).alias("same"), F.col("further").isNotNull().alias("moved")))
                moved = not step.filter("moved").isEmpty()
                discard(chain)
                chain = step.drop("moved")
                if not moved:
                    break
            over = over.union(chain.filter("not same").join(b_as_a(waits), [group, "a"], "left_anti").select(group, "b"))
        over = settle(over.distinct())
        # edges to what goes, or from it, say nothing any more; what is before those that go was kept
        rest = settle(live.join(over, [group, "b"], "left_anti").join(b_as_a(over), [group, "a"], "left_anti"))
        gone = over if gone is None else gone.union(over)
        discard(live, waits)
        live, before, left = rest, left, rest.count()
        slow = 2 * left > before
    return edges.select(group, "b").limit(0) if gone is None else gone


#: Bits of a band from which bands are joined, and hashes of a block.
BAND_BITS, HASH_BLOCK = 8, 4_096


def _near_by_bands(firsts: DataFrame, group: str, most: int, bits: int) -> DataFrame:
    """``group, x, y``: the places ``at`` of hashes within ``most`` bits, which agree in one of ``most + 1`` bands."""
    bands = most + 1
    edges = [bits * i // bands for i in range(bands + 1)]
    part = lambda h, i: F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    cut = firsts.select(group, "hash", "at", F.posexplode(F.array(*(part(F.col("hash"), i) for i in range(bands)))).alias("band", "part"))
    a, b = cut.toDF(group, "ha", "x", "band", "part"), cut.toDF(group, "hb", "y", "band", "part")
    return a.join(b, [group, "band", "part"]).filter((F.col("x") < F.col("y")) & (hamming(F.col("ha"), F.col("hb")) <= most)).select(group, "x", "y").distinct()


def _near_by_blocks(firsts: DataFrame, group: str, most: int) -> DataFrame:
    """``group, x, y`` as by bands, where bands are too narrow to tell hashes apart: blocks of bounded size are compared, each two of a group once."""
    # groups of several blocks: a row for each ``HASH_BLOCK`` hashes at most
    sizes = firsts.groupBy(group).agg(F.ceil(F.count("*") / HASH_BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = firsts.join(F.broadcast(sizes), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy(group, "blocks", "block").agg(F.collect_list(F.struct("hash", "at")).alias("rows"))
    packed = settle(packed.select(group, "blocks", "block", F.col("rows.hash").alias("h"), F.col("rows.at").alias("at")))
    left = packed.select(group, F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), "block", F.col("h").alias("hx"), F.col("at").alias("x"))
    met = left.join(packed.select(group, F.col("block").alias("other"), F.col("h").alias("hy"), F.col("at").alias("y")).hint("shuffle_merge"), [group, "other"])
    met = met.select(group, (F.col("block") == F.col("other")).alias("own"), "hx", "x", "hy", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hx, hy = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("hx", "hy"))
                x, y, own = batch.column("x")[i].values, batch.column("y")[i].values, batch.column("own")[i].as_py()
                for at in range(0, len(hx), 256):
                    rows, cols = np.nonzero(np.bitwise_count(hx[at : at + 256, None] ^ hy[None, :]) <= most)
                    rows += at
                    if own:  # each two once, and none with itself
                        rows, cols = rows[rows < cols], cols[rows < cols]
                    yield pa.RecordBatch.from_arrays([batch.column(group).take(pa.array(np.full(len(rows), i))), x.take(pa.array(rows)), y.take(pa.array(cols))], [group, "x", "y"])

    place = firsts.schema["at"].dataType
    found = met.mapInArrow(compare, StructType([firsts.schema[group], StructField("x", place), StructField("y", place)]))
    return found.select(group, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def collapse_bursts(rows: DataFrame, group: str, most: int = 6, bits: int = 64) -> DataFrame:
    """``group, id, kept_id``: in order of relevance a picture within ``most`` bits of one already kept folds into the first such.

    ``rows(group, id, hash, relevance)``. Equal hashes of a group fold first. Near hashes are
    found once each two, from the better picture to the worse: by bands where these have
    ``BAND_BITS`` or more, else in blocks. Then those are kept that no better one kept is near
    to. Rows without a hash or a group are kept.
    """
    held = rows.select(group, "id", "hash", "relevance")
    best = F.struct((-F.col("relevance")).alias("r"), F.col("id").alias("i"))
    firsts = settle(held.filter(F.col("hash").isNotNull() & F.col(group).isNotNull()).groupBy(group, "hash").agg(F.min(best).alias("at")))
    near = _near_by_bands(firsts, group, most, bits) if bits // (most + 1) >= BAND_BITS else _near_by_blocks(firsts, group, most)
    near = settle(near.select(group, F.col("x.i").alias("a"), F.col("x").alias("ra"), F.col("y.i").alias("b")))
    gone = _gone_in_order(near, group)
    kept = near.join(gone.select(group, F.col("b").alias("a")), [group, "a"], "left_anti")
    goes = kept.groupBy(group, "b").agg(F.min(F.struct("ra", "a")).alias("x")).select(group, F.col("b").alias("head"), F.col("x.a").alias("into"))
    heads = firsts.select(group, "hash", F.col("at.i").alias("head")).join(goes, [group, "head"], "left").select(group, "hash", F.coalesce("into", "head").alias("into"))
    # merged: the heads are as many as the rows, and copies of one hash may be
    return held.join(heads.hint("shuffle_merge"), [group, "hash"], "left").select(group, "id", F.coalesce("into", "id").alias("kept_id"))


def dedupe_topics(topics: Column, most: int = 6) -> Column:
    """The first ``most`` topics in order without those that hold, or are held by, an earlier one."""
    start = F.slice(topics, 1, 0)
    kept = F.aggregate(topics, start, lambda acc, t: F.when((F.size(acc) >= most) | F.exists(acc, lambda x: F.lower(x).contains(F.lower(t)) | F.lower(t).contains(F.lower(x))), acc).otherwise(F.concat(acc, F.array(t))))
    return F.slice(kept, 1, most)


def hash_column(text: Column) -> Column:
    """A 60-bit hash of content."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
