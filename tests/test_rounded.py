"""The ranking of ``folder_bm25`` beside its SQL, where scores are equal once they are rounded."""

import duckdb
import pytest

from sifthouse.queries import ORACLE_SQL, QUERIES

from .oracle import compare

DOCS = "doc_id long, text string, lang string, source string"
STRONG = [(i, "lich lich und x", "de", "s") for i in range(1, 30)]
#: Without "lich", so that its weight is above the least one.
OTHERS = [(1000 + i, "und x y z", "de", "s") for i in range(61)]


@pytest.fixture
def beside_sql(spark, tmp_path):
    def run(rows) -> str:
        spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        last = con.execute(ORACLE_SQL["folder_bm25"]).fetchall()[-1][0]
        return compare(QUERIES["folder_bm25"](spark, str(tmp_path)), con, ORACLE_SQL["folder_bm25"]) or f"last: {last}"

    return run


def test_the_last_place_is_the_smaller_id_of_equal_rounded_scores(beside_sql):
    # more of the frequent word: a greater score before it is rounded, an equal one after
    tied = [(100, "lich und x y", "de", "s"), (101, "lich und und x", "de", "s")]
    assert beside_sql(STRONG + OTHERS + tied) == "last: 100"
    assert beside_sql(STRONG + OTHERS + [(None, "lich und und x", "de", "s"), *tied]) == "last: 100"


def test_rows_without_a_text_or_a_language(beside_sql):
    odd = [(200, None, "de", "s"), (201, "", "de", "s"), (202, "lich lich und x", None, "de"), (203, "lich lich und x", "de/x", "s"), (100, "lich und x y", "de", None), (None, "lich und x y", "de", "s")]
    assert beside_sql(STRONG + OTHERS + odd) == "last: 100"
