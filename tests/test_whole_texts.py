"""Topics of whole texts: nothing behind the first thousands of characters is left out, and long rows of anything end."""

import random

from pyspark.sql import functions as F

from sifthouse.functions.text import clean_phrase
from sifthouse.operators import topics

#: The patterns as plain ones, which step back where they need not.
PLAIN_NAME = r"(?U)\b[A-Z][a-z]{2,}(?:\s+(?:(?:of|the|and|de|for)\s+)?[A-Z][a-z]{2,})+\b"
PLAIN_EVENT = r"(?U)\b(?:[A-Z][\w'-]+\s+){0,3}(?i:" + "|".join(topics.EVENT_WORDS) + r")(?:\s+(?:19|20)\d\d)?\b"
PLAIN_WORD = r"(?U)[^\W\d_][\w'-]*"
SCHEMA = "id int, name string, folder string, headings array<string>, text string, people array<string>, captions array<string>"


def _all(text, pattern, group=0):
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _topics(spark, rows):
    files = spark.createDataFrame([(i, "x.txt", "", [], text, [], captions) for i, (text, captions) in enumerate(rows)], SCHEMA)
    return {r["id"]: (r["topics"], r["events"]) for r in topics.derive_topics(files, "id").collect()}


def test_what_stands_late_in_a_text_counts(spark):
    front = "so it is " * 4_000
    assert len(front) > 30_000
    got = _topics(spark, [(front + "meadow meadow and Old Mill by the Goa Trip 2019", None), ("one", [front, "Spring Music Festival 2020"]), (front + "barns " * 2 + front + "rivers " * 3, None)])
    assert got[0] == (["Goa Trip 2019", "Old Mill", "Meadow"], ["Goa Trip 2019"])
    assert got[1] == (["Spring Music Festival 2020"], ["Spring Music Festival 2020"])
    assert got[2] == (["Rivers", "Barns"], [])


def test_long_rows_of_anything_end(spark):
    long = 300_000
    got = _topics(spark, [
        ("Abc " * long, None), ("A-" * long + " Goa Trip", None), ("Goa" + " " * long + "Trip", None), ("Goa" + "-" * long + "x Trip", None), ("A-" * long + "x Wedding-Day", None),
        ("Goa Trip, " * long, None), ("".join(f"Goa{i} Trip, " for i in range(20_000)), None)])
    assert got[0][0] == ["Abc " * 14 + "Abc"] and got[2] == got[5] == (["Goa Trip"], ["Goa Trip"])
    assert got[1][1] == [("A-" * long)[:60]] and got[3][1] == ["Goa" + "-" * 57] and got[4][1] == [("A-" * long)[:60]]
    assert got[6] == (["Goa0 Trip", "Goa1 Trip", "Goa2 Trip"], ["Goa0 Trip", "Goa1 Trip", "Goa2 Trip"])


def test_patterns_find_what_plain_ones_find(spark):
    rng = random.Random(4)
    parts = ["Wedding", "exam", "Examination", "EID", "annual day", "trip", "A", "Bc", "Abc", "Def", " Abc", " Def", " Ghi", " of Jkl", "Mno ", "d", "of", "the", "é", "éAbc", "1", "2019", "19990", "_", "-", "-", "'", " ", " ", " ", "\n ", " ", ".", "́", "ſession", "Ç"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 24))) for _ in range(30_000)]
    t = F.col("t")
    plain_words = F.filter(_all(t, PLAIN_WORD), lambda w: F.length(w) >= 4)
    same = spark.createDataFrame([(x,) for x in texts], "t string").select(
        (_all(t, topics.NAME) == _all(t, PLAIN_NAME)).alias("names"), (F.filter(_all(t, topics.EVENT, 1), lambda p: p != "") == _all(t, PLAIN_EVENT)).alias("events"), (_all(t, topics.WORD) == plain_words).alias("words"),
        F.size(_all(t, PLAIN_NAME)).alias("n"), F.size(_all(t, PLAIN_EVENT)).alias("e"), t)
    assert same.filter("not (names and events and words)").take(3) == []
    assert same.filter("n > 0").count() > 1_000 and same.filter("e > 1").count() > 1_000


def test_marks_around_a_phrase_go_as_before(spark):
    rng = random.Random(5)
    marks = r"[ \t\r\n\-_:;,.|#*]"
    texts = ["".join(rng.choices("ab -_:\t\r\n.* \u0085", k=rng.randrange(12))) for _ in range(20_000)]
    before = F.rtrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), f"^{marks}+|{marks}+$", ""), r"\s+", " "), r"(?i)^(?:the|a|an)\s+", ""))
    assert spark.createDataFrame([(x,) for x in texts], "t string").filter(clean_phrase(F.col("t")) != before).count() == 0
