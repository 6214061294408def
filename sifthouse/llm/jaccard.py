"""N-gram Jaccard join: sets of word shingles joined on rare prefixes, verified once per pair.

Equal sets are folded first, so copies never meet each other. A fixed-size sketch counts how
often shingles occur over all documents and orders them rare first. Two sets of a similarity of
``t`` or more share a shingle among the first ``n - ceil(t n) + 1`` of that order, so only those
are joined. A joined pair must pass the length filter, the positional filter (what the places of
the shared shingle leave to gain) and the suffix filter (counts of both sets in hash
ranges, of which the summed differences bound the symmetric difference); each pair left is verified once.

Shingles of few documents are joined with themselves. The documents of a shingle with many are
dealt into cells of bounded size, in which pairs are filtered, verified and counted in place: no
table ever holds the pairs of a large group. Counting all links of a group of n different near
copies takes n^2 comparisons, and as each two blocks of 512 meet, n^2 / 512 narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import discard, settle
from .pieces import gather
from .shared import Words, buffers, chunks, int64, list_array, phrase_hashes, sequence_hashes, text_column

SKETCH_BITS = 20
#: A shingle with more documents is dealt into cells; a pair that shares many of them is verified under the first.
HOT = 64
#: Hash ranges of the suffix filter.
RANGES = 128
_SLICE = 1 << 14
#: Documents of a block under such a shingle; two blocks make a cell.
BLOCK_DOCUMENTS = 512
#: Verification cells hold about so many shingles.
CELL_SHINGLES = 1_000_000


def _shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, with offsets; a text of fewer words has its sequence as one."""
    h, first = words.hashes(), words.first
    n = np.diff(first)
    grams = phrase_hashes(h, k)
    counts = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), counts)
    start = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    values = grams[start]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole, _ = sequence_hashes(h, first)
        values = np.concatenate([values, whole[short] ^ n[short].astype(np.uint64)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])]
        values, doc = values[new], doc[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents' shingles fall in each of 2^20 hash ranges: a sketch of one size for any input."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets):
                values, _ = _shingles(Words(data, offsets[start : stop + 1], lower=True), k)
                total += np.bincount(_bucket(values), minlength=len(total))
        if total.any():
            parts = total.reshape(-1, _SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts)), pa.int32()), pa.array([p.astype("<i4" if p.max() < 2**31 else "<i8").tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                values = np.frombuffer(c, "<i4" if len(c) == 4 * _SLICE else "<i8")
                total[p] = total[p] + values if p in total else values.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["part", "counts"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    summed = docs.select("text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary")
    for row in summed.toLocalIterator():
        out[row["part"] * _SLICE : (row["part"] + 1) * _SLICE] = np.frombuffer(row["counts"], "<i8")
    return out


def _sums(values: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set that name it."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)]) for v in (values * np.uint64(0x9E3779B97F4A7C15), (values >> np.uint64(7)) * values)]
    return [s[edges[1:]] - s[edges[:-1]] for s in sums]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of the rarest shingles of a set must be joined: n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1


def rarity(sketch: np.ndarray) -> np.ndarray:
    """The sketch's counts as a byte each, rare first: an order of eight steps for each doubling."""
    return np.minimum(8 * np.log2(sketch + 1.0), 255).astype(np.uint8)


def shingle_prefixes(docs: DataFrame, k: int, percent: int, order: Broadcast) -> DataFrame:
    """Per row: ``doc_id, n_shingles``, two sums that name the set, its rarest shingles (``prefix``) by ``order`` (see ``rarity``), and its counts in hash ranges (``profile``)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = order.value
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets):
                values, edges = _shingles(Words(data, offsets[start : stop + 1], lower=True), k)
                n = np.diff(edges)
                doc = np.repeat(np.arange(len(n)), n)
                one, two = _sums(values, edges)
                rare = np.lexsort((values, ranks[_bucket(values)], doc))
                take = np.where(n > 0, prefix_length(n, percent), 0)
                picked = np.repeat(edges[:-1] - (np.cumsum(take) - take), take) + np.arange(take.sum())
                ranges = np.bincount(doc * RANGES + ((values >> np.uint64(20)) % np.uint64(RANGES)).astype(np.int64), minlength=RANGES * len(n)).reshape(-1, RANGES)
                profile = [r.tobytes() for r in np.minimum(ranges, 255).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(n, pa.int64()), pa.array(int64(one)), pa.array(int64(two)),
                     list_array(int64(values[rare][picked]), np.concatenate([[0], np.cumsum(take)]), pa.int64()), pa.array(profile, pa.binary())],
                    ["doc_id", "n_shingles", "one", "two", "prefix", "profile"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, one long, two long, prefix array<long>, profile binary")


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sorts and merges: its sides grow with the corpus, so neither is broadcast, whatever its size here."""
    return left.join(right.hint("merge"), on, how)


def _split_tokens(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The prefix shingles of few sets (``cold``), those of many (``hot``) with the hot ones ``before`` them in their prefix, and the list of the latter."""
    tokens = sets.select("sid", "n_shingles", F.posexplode("prefix").alias("at", "g"))
    many = settle(tokens.groupBy("g").agg(F.count("*").alias("c")).filter(F.col("c") > HOT).select("g"))
    own = _joined(tokens, many, "g").groupBy("sid", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("at", "g"))).alias("own"))
    hot = own.select("sid", "n_shingles", "own", F.posexplode("own").alias("place", "one")).select(
        "sid", "n_shingles", "one.at", "one.g", F.slice("own.g", F.lit(1), F.col("place")).alias("before"))
    return _joined(tokens, many, "g", "left_anti"), settle(hot), many


def candidate_pairs(sets: DataFrame, cold: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a < b`` of sets under shingles of few that pass all filters, with the joined shingle ``g`` they are verified under.

    Pairs that share a shingle of many sets too are left to that shingle's cells.
    """
    a = cold.select("g", F.col("sid").alias("a"), F.col("n_shingles").alias("na"), F.col("at").alias("pa"))
    b = cold.select("g", F.col("sid").alias("b"), F.col("n_shingles").alias("nb"), F.col("at").alias("pb"))
    # the least overlap of a similar pair: ceil(t (na + nb) / (1 + t))
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - F.lit(1e-9))
    gain = F.lit(1) + F.least("pa", "pb") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (gain >= need)
    pairs = _joined(a, b, "g").filter(near).groupBy("a", "b").agg(F.min(F.struct("g", "na", "nb")).alias("x")).select("a", "b", "x.*")
    heat = hot.groupBy("sid").agg(F.collect_set("g").alias("heat"))
    # of the sets, those in a pair
    met = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    profiles = _joined(_joined(met, sets.select("sid", "profile"), "sid"), heat, "sid", "left")
    pairs = _joined(_joined(pairs, profiles.toDF("a", "fa", "ha"), "a"), profiles.toDF("b", "fb", "hb"), "b")
    pairs = pairs.filter(~F.coalesce(F.arrays_overlap("ha", "hb"), F.lit(False))).select("a", "b", "g", "na", "nb", "fa", "fb")

    def suffix_filter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES) for c in ("fa", "fb"))
            keep = _suffixes_fit(x, y, batch.column("na").to_numpy() + batch.column("nb").to_numpy(), percent)
            yield batch.select(["a", "b", "g", "na", "nb"]).filter(pa.array(keep))

    return pairs.mapInArrow(suffix_filter, "a long, b long, g long, na long, nb long")


def _suffixes_fit(x: np.ndarray, y: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether the counts of two sets in hash ranges leave room for a similar pair; ``both`` has their summed sizes."""
    apart = (np.abs(x.astype(np.int16) - y) * ((x < 255) & (y < 255))).sum(axis=1)
    return apart <= both - 2 * -(-percent * both // (100 + percent))


def _cell_pairs(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a cell that pass all filters and share no hot shingle before the cell's own."""
    n, at, block = (rows.column(c).to_numpy().astype(np.int64) for c in ("n_shingles", "at", "block"))
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    gain = 1 + np.minimum(at[:, None], at[None, :]) + np.minimum((n - at)[:, None], (n - at)[None, :]) - 1
    ok = (100 * low >= percent * high) & (gain >= -(-percent * (low + high) // (100 + percent)))
    i, j = np.nonzero(np.triu(ok, 1) if lo == hi else ok & (block == lo)[:, None] & (block == hi)[None, :])
    if not len(i):
        return i, j
    before = rows.column("before").combine_chunks()
    value, kind = np.unique(before.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    owner = np.repeat(np.arange(len(n)), before.value_lengths().to_numpy(zero_copy_only=False))
    profile = np.frombuffer(b"".join(rows.column("profile").to_pylist()), np.uint8).reshape(-1, RANGES)
    apart = np.ones(len(i), bool)
    for start in range(0, len(value), 512):
        some = (kind >= start) & (kind < start + 512)
        held = np.zeros((len(n), 512), bool)
        held[owner[some], kind[some] - start] = True
        bits = np.packbits(held, axis=1)
        for k in range(0, len(i), 1 << 15):
            apart[k : k + (1 << 15)] &= ~(bits[i[k : k + (1 << 15)]] & bits[j[k : k + (1 << 15)]]).any(axis=1)
    i, j = i[apart], j[apart]
    fit = [_suffixes_fit(profile[i[k : k + (1 << 14)]], profile[j[k : k + (1 << 14)]], n[i[k : k + (1 << 14)]] + n[j[k : k + (1 << 14)]], percent) for k in range(0, len(i), 1 << 14)]
    keep = np.concatenate([*fit, np.zeros(0, bool)])
    return i[keep], j[keep]


_CELL = "cell long, g long, lo int, hi int, block int, sid long, n_shingles long, at int, before array<long>, profile binary"


def hot_cells(sets: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Rows of the cells of shingles of many sets, without the sets that no other of their cell can be similar to.

    A shingle's sets are dealt into blocks of bounded size, and each two blocks make a cell.
    """
    splits = hot.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_DOCUMENTS)), F.ceil(F.sum("n_shingles") / F.lit(CELL_SHINGLES))).cast("int").alias("s"))
    block = F.pmod(F.xxhash64("sid"), F.col("s")).cast("int")
    rows = _joined(_joined(hot, splits, "g"), sets.select("sid", "profile"), "sid").withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    rows = rows.select(F.xxhash64("g", "lo", "hi").alias("cell"), "g", "lo", "hi", "block", "sid", "n_shingles", "at", "before", "profile")

    def run(table: pa.Table) -> pa.Table:
        return table.take(pa.array(np.unique(np.concatenate(_cell_pairs(table, percent)))))

    return rows.groupBy("g", "lo", "hi").applyInArrow(run, _CELL)


def cell_links(cells: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links within cells: ``src, dst`` that join each cell's linked sets, and rows of ``src, n`` with the links of each.

    Links are counted where they are verified, so a cell of many near copies gives rows in
    proportion to its sets.
    """
    held = _placed_sets(docs, sets, cells.select("cell", "g", "sid"), k)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        src, dst, count = [], [], []
        if left.num_rows and right.num_rows:
            ids = left.column("sid").to_numpy()
            raw = dict(zip(right.column("sid").to_pylist(), right.column("shingles").to_pylist(), strict=True))
            sets = [np.frombuffer(raw[d], np.uint64) for d in ids.tolist()]
            size = np.array([len(s) for s in sets])
            first = np.cumsum(size) - size
            value, kind = np.unique(np.concatenate(sets), return_inverse=True)
            i, j = _cell_pairs(left, percent)
            linked, part = np.zeros(len(ids), np.int64), np.arange(len(ids))
            edges = np.searchsorted(i, np.arange(len(ids) + 1))
            mark = np.zeros(len(value), bool)
            for x in np.flatnonzero(np.diff(edges)).tolist():
                ys = j[edges[x] : edges[x + 1]]
                mine = kind[first[x] : first[x] + size[x]]
                mark[mine] = True
                hits = mark[kind[gather(first[ys], size[ys])]]
                shared = np.add.reduceat(hits, np.cumsum(size[ys]) - size[ys], dtype=np.int64)
                mark[mine] = False
                ys = ys[100 * shared >= percent * (size[x] + size[ys] - shared)]
                linked[x] += len(ys)
                linked[ys] += 1
                parts, at = np.unique(part[ys], return_index=True)
                for p, y in zip(parts.tolist(), ys[at].tolist(), strict=True):
                    if p != part[x]:
                        src.append(ids[x])
                        dst.append(ids[y])
                        count.append(None)
                        part[part == p] = part[x]
            some = np.flatnonzero(linked)
            src += ids[some].tolist()
            dst += [None] * len(some)
            count += linked[some].tolist()
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "n": pa.array(count, pa.int64())})

    by = ["g", "cell"]
    return cells.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(run, "src long, dst long, n long")


def _placed_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``cell, g, sid, shingles``: the whole set of each of ``wanted(cell, g, sid)``, from the text of a document that has it."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(text_column(batch))
            for start, stop in chunks(offsets):
                values, edges = _shingles(Words(data, offsets[start : stop + 1], lower=True), k)
                mine = int64(_sums(values, edges)[0])
                for i in range(stop - start):
                    if mine[i] != batch.column("one")[start + i].as_py():
                        continue  # another text of a repeated id
                    raw = values[edges[i] : edges[i + 1]].tobytes()
                    places = batch.column("places")[start + i].values
                    yield pa.RecordBatch.from_arrays(
                        [places.field("cell"), places.field("g"), pa.array([batch.column("sid")[start + i].as_py()] * len(places), pa.int64()), pa.array([raw] * len(places), pa.binary())],
                        ["cell", "g", "sid", "shingles"])

    placed = wanted.groupBy("sid").agg(F.collect_list(F.struct("cell", "g")).alias("places"))
    placed = _joined(placed, sets.select("sid", "doc_id", "one"), "sid")
    return _joined(docs.select("doc_id", "text"), placed, "doc_id").select("sid", "text", "one", "places").mapInArrow(run, "cell long, g long, sid long, shingles binary")


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sets are as similar as asked: ``src, dst``.

    Pairs are gathered under their shingle; a shingle with many sets is split into cells by
    hashes of both sides, so each cell holds a bounded number of shingles. A cell gets each of
    its sets once, made from the text as it is dealt out.
    """
    members = pairs.select("g", F.col("a").alias("d"), F.col("na").alias("n")).union(pairs.select("g", F.col("b").alias("d"), F.col("nb").alias("n"))).distinct()
    splits = members.groupBy("g").agg(F.ceil(F.sum("n") / F.lit(CELL_SHINGLES)).cast("int").alias("s"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("s"))
    placed = _joined(pairs, splits, "g").select("a", "b", F.xxhash64("g", part("a"), part("b")).alias("cell"), F.col("g"))
    wanted = placed.select("cell", "g", F.col("a").alias("sid")).union(placed.select("cell", "g", F.col("b").alias("sid"))).distinct()
    held = _placed_sets(docs, sets, wanted, k).select("cell", "g", F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "shingles")
    asked = placed.select("cell", "g", "a", "b", F.lit(None).cast("binary").alias("shingles"))
    parts = pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = held.union(asked).repartition(int(parts), "cell").sortWithinPartitions("cell", "g", F.col("b").asc_nulls_first(), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kept = None, {}
        for batch in batches:
            src, dst = [], []
            for cell, g, a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("cell", "g", "a", "b", "shingles")), strict=True):
                if (cell, g) != here:
                    here, kept = (cell, g), {}
                if b is None:
                    kept[a] = np.frombuffer(raw, np.uint64)
                    continue
                x, y = kept[a], kept[b]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                shared = int((large[at] == small).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    src.append(a)
                    dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, n_links``.

    Words are runs between blanks with A-Z lowered; a set holds the distinct ``k``-word shingles
    (a shorter text: its whole sequence). Two sets link at 100 * intersection >= ``percent``
    * union. Rows without words (null, empty and blank texts) have an empty set and stand alone.
    ``component_id`` is the smallest ``doc_id`` whose text is reached by links from the row's own;
    ``n_links`` counts the linked sets other than its own: copies are not expanded into pairs.
    Rows that repeat a ``doc_id`` are one document: its texts share a component, but each row has
    the links of its own text. A row without ``doc_id`` stands alone with a null component and no links.
    """
    docs = docs.select("doc_id", "text")
    order = docs.sparkSession.sparkContext.broadcast(rarity(shingle_sketch(docs, k)))
    marked = settle(shingle_prefixes(docs, k, percent, order))
    order.destroy()
    keys = ["n_shingles", "one", "two"]
    # equal sets are folded, under the smallest id that has them; once written, the number of a row stays its own
    sets = marked.filter("n_shingles > 0 and doc_id is not null").groupBy(*keys).agg(
        F.min("doc_id").alias("doc_id"), F.first("prefix").alias("prefix"), F.first("profile").alias("profile"))
    sets = settle(sets.withColumn("sid", F.monotonically_increasing_id()))
    cold, hot, many = _split_tokens(sets)
    pairs = settle(candidate_pairs(sets, cold, hot, percent))
    cells = settle(hot_cells(sets, hot, percent))
    links = settle(verify(pairs, docs, sets, k, percent).withColumn("n", F.lit(None).cast("long")).unionByName(
        cell_links(cells, docs, sets, k, percent).withColumn("hot", F.lit(True)), allowMissingColumns=True))
    discard(many, hot, pairs, cells)
    counted = links.filter("hot is null").withColumn("n", F.lit(1))
    degree = links.filter("n is not null").select("src", "n").union(counted.select("src", "n")).union(counted.select(F.col("dst").alias("src"), "n"))
    degree = degree.groupBy(F.col("src").alias("sid")).agg(F.sum("n").alias("n_links"))
    rows = settle(_joined(marked.select("doc_id", *keys), sets.select(*keys, "sid"), keys, "left").select("doc_id", "n_shingles", "sid"))
    discard(marked)
    held = rows.filter("doc_id is not null and sid is not null")
    repeated = held.groupBy("doc_id").agg(F.min("sid").alias("src"), F.max("sid").alias("most")).filter("src < most").select("doc_id", "src")
    repeated = _joined(held, repeated, "doc_id").filter("src <> sid").select("src", F.col("sid").alias("dst"))
    parts = connected_components(links.filter("dst is not null").select("src", "dst").union(repeated)).withColumnRenamed("node", "sid")
    parts = settle(_joined(sets.select("sid", "doc_id"), parts, "sid"))
    least = parts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    parts = _joined(_joined(parts, least, "component").select("sid", "component_id"), degree, "sid", "left")
    # settled, so that the join below has two shuffles of its own and the rows of a set in very many documents can be split
    alone = settle(_joined(sets.select("sid", "doc_id"), parts, "sid", "left").select("sid", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links"))
    known = F.col("doc_id").isNotNull()
    return _joined(rows, alone, "sid", "left").select(
        "doc_id", "n_shingles", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))


def keep_one(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` of which one document of each component, that of the smallest ``doc_id``, stays; columns are kept.

    Rows without ``doc_id`` stay, and so do all rows that repeat an id that stays.
    """
    gone = near_duplicates(docs, k, percent).filter("component_id <> doc_id").select("doc_id").distinct()
    return _joined(docs, gone, "doc_id", "left_anti").select(docs.columns)
