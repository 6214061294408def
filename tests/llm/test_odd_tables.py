"""Every operator on odd tables: repeated rows, null ids and texts, very long texts and words, clashing columns, no rows; and models beside plain versions."""

import hashlib
import math

import numpy as np
import pytest

from sifthouse.llm import bpe, decontaminate, jaccard, language_id, licenses, pii, queries, repeats, token_files, toxicity
from sifthouse.llm.pieces import open_tokenizer

from . import brute

LONG = " ".join(f"w{i % 5003}x{i % 4999}" for i in range(250_000))
WORD = "".join("abcdefgh"[(i * i) % 8] for i in range(300_000))
TEXTS = [(1, "Mrs Ann Lee wrote: the quick brown fox and the lazy dog, again and again"), (1, "Mrs Ann Lee wrote: the quick brown fox and the lazy dog, again and again"),
         (None, "Mrs Ann Lee wrote: the quick brown fox and the lazy dog, again and again"), (None, None), (2, ""), (3, " \t\n"), (4, LONG), (5, WORD), (6, None), (7, "one"), (7, "two words")]
CLASHES = ["lang", "score", "predicted", "ids", "n_words", "spans", "item_ids", "licenses", "kinds", "n_entities", "row", "sid", "part", "redrawn", "lang_pred", "one", "two", "prefix", "block", "at"]


@pytest.fixture(scope="module")
def messy(spark):
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["own"] * len(CLASHES)) for r in TEXTS], schema).repartition(3)


@pytest.fixture(scope="module")
def net():
    words = lambda *w: np.array([[hash(x) % 1000, 7] for x in w], np.int32)
    return toxicity.fit([(words("bad", "x", str(i)), 1, "en") for i in range(30)] + [(words("good", "y", str(i)), 0, "en") for i in range(60)])


def _tokens(spark, tmp_path):
    def run(d):
        path = f"file://{tmp_path}/{hashlib.md5(str(d.columns).encode()).hexdigest()}"
        token_files.write_tokens(d, path, queries.WORD_VOCABULARY, queries.WORD_END)
        return token_files.token_digests(spark, path)
    return run


@pytest.fixture(params=["toxicity", "near", "tokens", "repeats", "contamination", "language", "pii", "bpe", "licenses"])
def operator(request, spark, net, tmp_path):
    items = spark.createDataFrame([(1, "quick brown fox"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    model = language_id.train(spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the fox and the dog", "en"), ("le renard et le chien", "fr")])], "doc_id long, text string, lang string"))
    return {
        "toxicity": lambda d: toxicity.score(d, net), "near": jaccard.near_duplicates, "tokens": _tokens(spark, tmp_path), "repeats": repeats.remove_repeats,
        "contamination": lambda d: decontaminate.contamination_report(d, items), "language": lambda d: language_id.identify(d, model), "pii": lambda d: pii.replace_pii(d, b"key"),
        "bpe": lambda d: bpe.round_trip(d, queries.BYTE_VOCABULARY), "licenses": licenses.scan_licenses}[request.param]


def test_odd_rows_give_a_row_each(operator, messy):
    got = operator(messy).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in TEXTS)
    if "sid" in got[0].asDict():  # an operator that keeps other columns: those it doesn't give out hold what they held
        assert all(r[c] == "own" for r in got for c in ("row", "sid", "redrawn", "one", "two", "part", "prefix", "block", "at"))


def test_no_rows(operator, messy):
    assert operator(messy.limit(0)).count() == 0


def test_long_texts_have_plain_results(spark, messy):
    rows = [(d, t) for d, t in TEXTS if d in (4, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    near = {(r["doc_id"], r["n_shingles"]) for r in jaccard.near_duplicates(table).collect()}
    words = LONG.split()
    assert near == {(4, len(set(zip(words, words[1:], words[2:])))), (5, 1)}
    assert {(r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(table).collect()} == {(4, 0), (5, 0)}
    tokenizer = open_tokenizer(queries.BYTE_VOCABULARY)
    got = {tuple(r) for r in bpe.round_trip(table, queries.BYTE_VOCABULARY).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == brute.round_trips(rows, tokenizer)
    items = spark.createDataFrame([(1, " ".join(words[1000:1013])), (2, " ".join(words[-5:]))], "item_id long, text string")
    got = decontaminate.contamination_report(table.filter("doc_id = 4"), items).first()
    assert (got["n_words"], got["n_items"]) == (len(words), 2) and got["n_hit"] == 13 * sum(words[i] == words[1000] and words[i : i + 13] == words[1000:1013] for i in range(len(words))) + 5


@pytest.fixture
def small_parts(spark):
    """Small shuffled parts stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_one_document_is_found_in_its_stripe(spark, tmp_path, small_parts):
    """A look-up reads the stripes that may hold an id, and the files carry Bloom filters."""
    docs = spark.createDataFrame([(i * 3, f"text {i} of many words") for i in range(5_000)], "doc_id long, text string").repartition(4)
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, path, queries.WORD_VOCABULARY, queries.WORD_END, stride=1_000)
    found = token_files.find_document(spark, path, 1_500)
    tokenizer = open_tokenizer(queries.WORD_VOCABULARY)
    assert [r["ids"] for r in found.collect()] == [tokenizer.encode("text 500 of many words", add_special_tokens=False).ids + [2]]
    assert token_files.find_document(spark, path, 1_501).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1500)]" in plan
    from pyarrow import orc
    parts = sorted((tmp_path / "tokens").glob("*.orc"))
    ranges = [orc.ORCFile(p).read(columns=["doc_id"]).column("doc_id").to_pylist() for p in parts]
    assert len(parts) > 1 and all(r == sorted(r) for r in ranges)
    spans = sorted((r[0], r[-1]) for r in ranges if r)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # parts can be read beside each other, and pruned by their ids


def test_null_ids_are_dealt_over_parts(spark, tmp_path, small_parts):
    docs = spark.createDataFrame([(None, f"n {i}") for i in range(3_000)] + [(i, f"t {i}") for i in range(1_000)], "doc_id long, text string").repartition(4)
    token_files.write_tokens(docs, f"{tmp_path}/tokens", queries.WORD_VOCABULARY, queries.WORD_END)
    held = token_files.read_tokens(spark, f"{tmp_path}/tokens").filter("doc_id is null").groupBy("block").count().collect()
    assert len(held) > 1 and sum(r["count"] for r in held) == 3_000
    starts = token_files.token_digests(spark, f"{tmp_path}/tokens").orderBy("start").collect()
    assert [r["start"] for r in starts] == [0, *np.cumsum([r["n_tokens"] for r in starts])[:-1].tolist()]


def test_code_lengths_beside_a_plain_model():
    """Counts of contexts in dictionaries, and escapes to shorter ones, byte by byte."""
    rng = np.random.default_rng(8)
    corpora = [bytes(rng.choice(list(b"abc de"), 400).tolist()), bytes(rng.choice(list(b"abxy z"), 300).tolist())]
    trees = [language_id.Tree(language_id.grams(np.frombuffer(c, np.uint8), np.array([0, len(c)]))) for c in corpora]
    model = language_id.Model(["a", "b"], trees)
    texts = [b"abc ab", b"", b"zzyx", b"qq abc dexyz"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = model.code_lengths(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))

    def counts(corpus):
        out: dict[bytes, dict[int, int]] = {}
        padded = b" " * language_id.ORDER + corpus
        for i in range(language_id.ORDER, len(padded)):
            for n in range(language_id.ORDER + 1):
                out.setdefault(padded[i - n : i], {}).setdefault(padded[i], 0)
                out[padded[i - n : i]][padded[i]] += 1
        return out

    for k, corpus in enumerate(corpora):
        known = counts(corpus)
        for t, text in enumerate(texts):
            bits, padded = 0.0, b" " * language_id.ORDER + text
            for i in range(language_id.ORDER, len(padded)):
                for n in range(language_id.ORDER, -1, -1):
                    here = known.get(padded[i - n : i])
                    if here is None:
                        continue
                    whole = sum(here.values()) + len(here)
                    if padded[i] in here:
                        bits -= math.log2(here[padded[i]] / whole)
                        break
                    bits -= math.log2(len(here) / whole)
                else:
                    bits += 8
            assert got[t, k] == pytest.approx(bits, rel=1e-5)


def test_toxicity_outputs_beside_plain_loops(net):
    """Filters slid over words one by one, their greatest responses, and the logistic output."""
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 1000, (n, 2)).astype(np.int32) for n in (0, 1, 2, 3, 17)]
    flat, first = toxicity._flat(texts)
    got = net.logits(flat, first)
    for text, z in zip(texts, got):
        vectors = [sum(net.embedding[b] for b in word) for word in text]
        answers = []
        for width, filters, bias in zip(toxicity.WIDTHS, net.filters, net.bias):
            for f in range(filters.shape[2]):
                best = 0.0
                for i in range(len(vectors)):
                    response = bias[f] + sum(float(vectors[i + j] @ filters[j, :, f]) for j in range(width) if i + j < len(vectors))
                    best = max(best, response)
                answers.append(best)
        assert float(z) == pytest.approx(float(np.dot(answers, net.out) + net.out_bias), abs=1e-4)


def test_licenses_beside_whole_alignments(spark):
    """Each template against the whole text: what covers enough within its span is found by way of regions too."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = np.random.default_rng(5)
    noise = [f"n{i}" for i in range(400)]
    for name, template in list(licenses.TEMPLATES.items())[:12]:
        words = licenses.words_of(template)
        for change in (0.0, 0.1):
            text = [w if rng.random() >= change else b"zzz" for w in words]
            whole = [*(x.encode() for x in noise[:100]), *text, *(x.encode() for x in noise[100:])]
            pairs = licenses.align(whole, words)
            if len(pairs) >= 0.8 * len(words):
                found = scanner.scan(whole)
                assert any(abs(m[2] - pairs[0][0]) < 0.25 * len(words) + 3 for m in found), (name, change)


def test_surrogates_beside_a_plain_pass(spark):
    """The same entities drawn one by one on one machine, with coincidences redrawn in order of value."""
    texts = [f"Mrs Name{chr(97 + i % 26)}{chr(97 + i // 26)}a Kol{chr(97 + i % 7)}, mail u{i % 9}@h{i % 4}.org" for i in range(60)]
    key = b"plain"
    draw = pii.Surrogates(key)
    found = {(k, v) for t in texts for _, _, k, v in pii.entities(t)}
    attempt = {e: 0 for e in found}
    family = lambda e: e[0].split("-")[0]
    while True:
        made: dict[tuple[str, str], list] = {}
        for e in found:
            made.setdefault((family(e), draw(*e, attempt[e])), []).append(e)
        real = {(family(e), e[1]) for e in found}
        again = [e for (f, s), es in made.items() for e in es if (f, s) in real or e != min(es, key=lambda e: (e[1], e[0]))]
        if not again:
            break
        for e in again:
            attempt[e] += 1
    want = []
    for t in texts:
        out, at = "", 0
        for a, b, k, v in pii.entities(t):
            out, at = out + t[at:a] + pii.spelled(t[a:b], draw(k, v, attempt[k, v]), k), b
        want.append(out + t[at:])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r["text"] for r in pii.replace_pii(docs, key).orderBy("doc_id").collect()] == want

