import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


#: Nulls, empty and blank texts, odd bytes, a long text, copies, and passages that move between documents.
WORDS = [f"word{i % 97}x{i % 89}" for i in range(4_000)]
ODD = [
    (1, " ".join(WORDS[:300]), "en"), (2, None, "en"), (3, "", None), (4, " \t\n\x0b\x0c\r ", "fr"), (5, "one", "de"), (6, "ONE", "de"),
    (7, "one two", "de"), (8, " ".join(WORDS[:300]).upper(), "en"), (9, "fresh start " + " ".join(WORDS[100:160]) + " fresh end", None),
    (10, " ".join(WORDS), "en"), (11, " ".join(["same"] * 500), "en"), (12, " ".join(["same"] * 400), "en"), (13, "naïve café \u0085 日本語 \U0001f600 é́ <|endoftext|>", "fr"),
    (14, " ".join(WORDS[:299]), "en"), (15, " ".join(WORDS[1000:1049]), "en"), (16, " ".join(WORDS[1000:1050]), "en"), (17, "a\x00b  c�", "es"),
    (2**40, " ".join(WORDS[:300]), "en"), (-5, "x " + " ".join(WORDS[200:260]), "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd kind, with further columns of names that operators give out."""
    schema = "doc_id long, text string, lang string, n_words int, score string, predicted string, ids string, spans string, item_ids string, one string, seeds string, licenses string, part int, kinds string"
    return spark.createDataFrame([(*r, *[None] * 11) for r in ODD], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
