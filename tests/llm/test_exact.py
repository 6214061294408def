"""Operators with one right answer, beside plain versions of them."""

import pytest
from pyspark.sql import functions as F

from sifthouse.llm import bpe, decontaminate, jaccard, queries, repeats, token_files
from sifthouse.llm.pieces import open_tokenizer

from . import brute
from .conftest import ODD, SF


def _set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def _texts(odd):
    return [(d, t) for d, t, _ in ODD]


NEAR = ("doc_id", "n_shingles", "component_id")
KEPT = ("doc_id", "n_words", "n_removed", "kept_sha256")
HITS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
FILES = ("doc_id", "start", "n_tokens", "ids_crc32")
TRIPS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_near_duplicates(spark, rows, odd):
    assert _set(queries.op2_ngram_jaccard_join(spark, SF), *NEAR) == brute.near_components(rows)
    assert _set(jaccard.near_duplicates(odd), *NEAR) == brute.near_components(_texts(odd))


def test_near_duplicates_at_every_threshold_edge(spark):
    """Sets of n and n + d shingles that share n: the similarity stands just above and below the limit."""
    texts = [(i * 100 + d, " ".join(f"u{i}w{j}" for j in range(n + d))) for i, n in enumerate((5, 11, 20, 29, 92, 101)) for d in range(14)]
    got = _set(jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")), *NEAR)
    assert got == brute.near_components(texts)


def test_hot_shingles_and_copies(spark):
    """Many documents under one shingle, and large groups of copies and near copies."""
    common = " ".join(f"c{j}" for j in range(60))
    texts = [(i, f"{common} tail{i % 7}") for i in range(300)] + [(1000 + i, f"the same start {i} " + " ".join(f"r{i}q{j}" for j in range(10))) for i in range(200)]
    got = _set(jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")), *NEAR)
    assert got == brute.near_components(texts)


def test_keep_one_keeps_columns(odd):
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {c for _, _, c in brute.near_components(_texts(odd))}


def test_removed_windows(spark, rows, odd):
    assert _set(queries.op4_substring_dedup(spark, SF), *KEPT) == brute.removed_windows(rows)
    assert _set(repeats.remove_repeats(odd), *KEPT) == brute.removed_windows(_texts(odd))


def test_removed_windows_of_shifting_repeats(spark):
    """Periodic texts, passages of exactly and just under a window, and passages cut from two owners."""
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    texts = [(1, a), (2, b), (3, a[20:69]), (4, a[20:70]), (5, a[150:] + b[:50]), (6, a[140:] + b[:60] + a[:49]), (7, ["p", "q"] * 80), (8, ["q", "p"] * 60), (9, ["z", *a[10:60], "z", *a[61:111]]), (10, a[:120] + ["mid"] + a[121:])]
    texts = [(i, " ".join(w)) for i, w in texts]
    assert _set(repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")), *KEPT) == brute.removed_windows(texts)


def test_contamination(spark, rows, odd):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _set(queries.op5_decontamination(spark, SF), *HITS) == brute.contamination(rows, items)
    odd_items = [(1, "word3x3 word4x4"), (2, None), (3, "..."), (4, "SAME same"), (5, " ".join(ODD[0][1].split()[5:40])), (10, "one"), (9, "one")]
    table = spark.createDataFrame(odd_items, "item_id long, text string")
    want = brute.contamination(_texts(odd), odd_items)
    assert _set(decontaminate.contamination_report(odd, table), *HITS) == want
    sharded = decontaminate.find_contamination(odd.select("doc_id", "text"), table, shard_bytes=64)
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"])
    assert _set(sharded, "doc_id", "n_words", n_hit, F.size("item_ids")) == {w[:4] for w in want}


def test_token_files(spark, rows, odd, tmp_path):
    tokenizer = open_tokenizer(queries.WORD_VOCABULARY)
    assert _set(queries.op3_token_files(spark, SF), *FILES) == brute.token_files(rows, tokenizer)
    token_files.write_tokens(odd, f"{tmp_path}/tokens", queries.WORD_VOCABULARY, queries.WORD_END)
    assert _set(token_files.token_digests(spark, f"{tmp_path}/tokens"), *FILES) == brute.token_files(_texts(odd), tokenizer)


def test_round_trip(spark, rows, odd):
    tokenizer = open_tokenizer(queries.BYTE_VOCABULARY)
    assert _set(queries.op9_bpe_round_trip(spark, SF), *TRIPS) == brute.round_trips(rows, tokenizer)
    assert _set(bpe.round_trip(odd, queries.BYTE_VOCABULARY), *TRIPS) == brute.round_trips(_texts(odd), tokenizer)


def test_lexicon_finds_its_words_only(tmp_path):
    words = {w.encode(): bytes(4 * (1 + i % 3)) for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "é", "日本"])}
    lexicon = bpe.Lexicon.build(words)
    (tmp_path / "lexicon").write_bytes(lexicon.to_bytes())
    again = bpe.Lexicon.open(f"{tmp_path}/lexicon")
    assert again([w.decode() for w in words]) == list(words.values())
    assert again(["", "ta", "tapsx", "x", "sto"]) == [None] * 5
    assert len(again.final) < sum(map(len, words))  # suffixes are shared


@pytest.mark.parametrize("run", [
    jaccard.near_duplicates, repeats.remove_repeats, lambda d: bpe.round_trip(d, queries.BYTE_VOCABULARY),
    lambda d: decontaminate.contamination_report(d, d.select(d["doc_id"].alias("item_id"), "text"))])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"k{i}" for i in range(80))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, text), (2, "other words")], "doc_id long, text string")
    near = jaccard.near_duplicates(rows).collect()
    assert len(near) == 6 and {r["component_id"] for r in near} == {1, None}
    removed = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.remove_repeats(rows).collect())
    assert removed == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 80)]
    assert bpe.round_trip(rows, queries.BYTE_VOCABULARY).count() == 6


def _thue_morse(n):
    """A word of ``n`` letters and its complement: polynomial hashes modulo 2^64 can't tell them apart."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_of_one_structure_stay_apart(spark):
    """Words of 1,024 and 4,096 bytes that differ in every letter, as single words and in windows."""
    texts, number = [], 0
    for n in (1024, 4096):
        one, two = _thue_morse(n)
        for word in (one, two):
            number += 1
            texts.append((number, word))
            texts.append((100 + number, " ".join([word, *(f"w{number}x{i}" for i in range(3))])))
            texts.append((200 + number, " ".join([*(f"v{i}" for i in range(25)), word, *(f"u{i}" for i in range(35))])))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    assert _set(jaccard.near_duplicates(table), *NEAR) == brute.near_components(texts)
    assert _set(repeats.remove_repeats(table), *KEPT) == brute.removed_windows(texts)
    assert _set(bpe.round_trip(table, queries.BYTE_VOCABULARY), *TRIPS) == brute.round_trips(texts, open_tokenizer(queries.BYTE_VOCABULARY))


def test_token_files_of_long_words(spark, tmp_path):
    texts = [(i, w) for i, w in enumerate([*_thue_morse(1024), *_thue_morse(4096)])]
    token_files.write_tokens(spark.createDataFrame(texts, "doc_id long, text string"), f"{tmp_path}/tokens", queries.WORD_VOCABULARY, queries.WORD_END)
    assert _set(token_files.token_digests(spark, f"{tmp_path}/tokens"), *FILES) == brute.token_files(texts, open_tokenizer(queries.WORD_VOCABULARY))


def test_near_copies_of_repeated_ids(spark):
    """An id with two texts joins the copies of both."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = spark.createDataFrame([(5, a), (5, b), (9, b), (10, b), (11, a), (12, b + " more"), (13, "other")], "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.near_duplicates(rows).select("doc_id", "n_shingles", "component_id", "n_links").collect())
    assert got == [(5, 58, 5, 0), (5, 58, 5, 1), (9, 58, 5, 1), (10, 58, 5, 1), (11, 58, 5, 0), (12, 59, 5, 1), (13, 1, 13, 0)]
    assert sorted(r["doc_id"] for r in jaccard.keep_one(rows).collect()) == [5, 5, 13]


def test_links_are_counted_once_each(spark):
    """Few and many documents under one shingle: the links of every document, copies left out."""
    common = [f"c{j}" for j in range(80)]
    texts = [(i, " ".join([*common[: 60 + i % 4], f"own{i}", *common[60 + i % 4 :]])) for i in range(150)]
    texts += [(1000 + i, " ".join([f"d{j}" for j in range(90)] + [f"t{i}"])) for i in range(5)]
    sets = {}
    for d, t in texts:
        w = t.split()
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {(a, sum(100 * len(x & y) >= 90 * len(x | y) for b, y in sets.items() if b != a)) for a, x in sets.items()}
    assert _set(jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "n_links") == want
