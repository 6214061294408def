"""The pipeline's stages beside plain versions, and the shape of its result."""

import corpus_pipeline
from sifthouse.llm import pii, toxicity
from sifthouse.llm.pieces import open_tokenizer
from sifthouse.llm.queries import BYTE_VOCABULARY, _fold

from . import brute
from .conftest import SF


def test_stages_follow_each_other(spark, docs):
    here = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "bpe"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = toxicity.train(docs, labels.filter(_fold("doc_id", 3) != 1))
    clean = {r["doc_id"] for r in toxicity.score(docs, net).filter("predicted = 0").collect()}
    here = stages["toxicity"](spark, docs, SF)
    assert here.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in here.collect()}
    assert rows.keys() == clean and len(rows) > 0.6 * docs.count()

    here = stages["ngram_jaccard_join"](spark, here, SF)
    left = {r["doc_id"] for r in here.collect()}
    assert here.columns == docs.columns and left == {c for _, _, c in brute.near_components(rows.items(), 5, 80)}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    here = stages["benchmark_decontamination"](spark, here, SF)
    bad = {r[0] for r in brute.contamination([(d, rows[d]) for d in left], items) if r[-1]}
    assert here.columns == docs.columns and {r["doc_id"] for r in here.collect()} == left - bad

    here = stages["pii"](spark, here, SF)
    assert here.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in here.collect()]
    for doc_id, text in texts:
        assert [k for _, _, k, _ in pii.entities(text)] == [k for _, _, k, _ in pii.entities(rows[doc_id])]

    here = stages["bpe"](spark, here, SF)
    got = {tuple(r) for r in here.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == brute.round_trips(texts, open_tokenizer(BYTE_VOCABULARY))


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    """A copy with an added passage, one with scattered changes, and one just under the limit, beside the plain version."""
    own = [[f"d{i}w{j}" for j in range(200)] for i in range(3)]
    longer = own[0] + [f"added{j}" for j in range(34)]
    changed = [f"new{j}" if j in (40, 80, 120, 160) else w for j, w in enumerate(own[1])]
    under = own[2] + [f"more{j}" for j in range(60)]
    texts = [(i, " ".join(w)) for i, w in enumerate([*own, longer, changed, under])]
    kept = corpus_pipeline.remove_near_copies(spark, spark.createDataFrame(texts, "doc_id long, text string"), SF)
    left = {r["doc_id"] for r in kept.collect()}
    assert left == {c for _, _, c in brute.near_components(texts, 5, 80)} == {0, 1, 2, 5}
    assert {c for _, _, c in brute.near_components(texts)} == {0, 1, 2, 3, 4, 5}


def test_later_stages_beside_plain_versions(spark, docs, rows):
    """Near copies at five words and 0.8, and the stages after them, from all documents."""
    stages, texts = dict(corpus_pipeline.STAGES), dict(rows)
    here = stages["ngram_jaccard_join"](spark, docs, SF)
    left = {r["doc_id"] for r in here.collect()}
    assert left == {c for _, _, c in brute.near_components(rows, 5, 80)} != {c for _, _, c in brute.near_components(rows)}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    here = stages["benchmark_decontamination"](spark, here, SF)
    bad = {r[0] for r in brute.contamination([(d, texts[d]) for d in left], items) if r[-1]}
    assert {r["doc_id"] for r in here.collect()} == left - bad
    here = stages["pii"](spark, here, SF)
    clean = [(r["doc_id"], r["text"]) for r in here.collect()]
    assert {d for d, _ in clean} == left - bad
    got = {tuple(r) for r in stages["bpe"](spark, here, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == brute.round_trips(clean, open_tokenizer(BYTE_VOCABULARY))


ODD_TEXT = "Mrs Ann Lee wrote of the quick brown fox and the lazy dog, again and again and once more"


def test_stages_take_odd_tables(spark):
    """Null, empty and long texts, repeated rows, null ids, columns of any names, and no rows: what stays keeps its columns and values."""
    rows = [(1, ODD_TEXT), (1, ODD_TEXT), (None, ODD_TEXT), (None, None), (2, ""), (3, None), (4, " ".join(f"u{i}" for i in range(60_000))), (5, ODD_TEXT), (6, "x" * 200_000)]
    columns = ["lang", "source", "score", "predicted", "spans", "n_words", "kinds", "pii_row", "sid", "component_id"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in columns)
    docs = spark.createDataFrame([(d, t, len(t or ""), *(["own"] * len(columns))) for d, t in rows], schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        kept = got.collect()
        assert all(r[c] == "own" for r in kept for c in columns)
        ids = sorted(str(r["doc_id"]) for r in kept)
        if name == "ngram_jaccard_join":
            assert ids == sorted(["1", "1", "None", "None", "2", "3", "4", "6"])  # 5 repeats 1's text
        elif name == "pii":
            assert ids == sorted(str(d) for d, _ in rows) and not any("Ann" in (r["text"] or "") for r in kept)
            assert len({r["text"] for r in kept if r["text"] and r["text"].startswith("Mrs")}) == 1
        else:
            assert ids == sorted(str(d) for d, _ in rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert stages["bpe"](spark, docs, SF).count() == len(rows)
    assert stages["bpe"](spark, docs.limit(0), SF).count() == 0


def test_the_whole_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() < 200
