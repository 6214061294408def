"""Shares of a query's words, as the SQL of ``rerank_overlap`` counts them."""

from sifthouse.operators import retrieval, topics


def test_rows_of_one_id_count_together_and_rows_without_one_count(spark):
    queries = spark.createDataFrame([(1, "Red red fox"), (2, "blue"), (None, "owl"), (3, ""), (4, None)], "item_id int, text string")
    docs = spark.createDataFrame([(7, "a red FOX, red"), (8, "fox"), (8, "red, blue"), (None, "the owl"), (9, "dog"), (10, None)], "doc_id int, text string")
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in retrieval.word_shares(queries, "item_id", "text", docs, "doc_id", "text", 0.5).collect()}
    assert got == {(1, 7): 1.0, (1, 8): 1.0, (2, 8): 1.0, (None, None): 1.0}


def test_texts_are_read_once_and_no_words_go_with_a_pair(spark):
    queries = spark.createDataFrame([(1, "red fox")], "item_id int, text string")
    docs = spark.createDataFrame([(7, "red fox"), (8, "fox")], "doc_id int, text string")
    plan = retrieval.word_shares(queries, "item_id", "text", docs, "doc_id", "text", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_topics_shuffle_no_words_and_read_a_text_once(spark):
    """Words are counted in the row of their file, in the order in which they first come."""
    files = spark.createDataFrame([(1, "x.txt", "", [], "barns barns meadow Meadow once rivers Rivers rivers", []), (2, "y.txt", "", [], None, [])], "id int, name string, folder string, headings array<string>, text string, people array<string>")
    got = topics.derive_topics(files, "id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan and plan.count("hashpartitioning") == 1
    assert {r["id"]: r["topics"] for r in got.collect()}[1] == ["Rivers", "Barns", "Meadow"]
