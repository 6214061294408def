"""Operators that SQL can't express, beside plain versions of them, and parsing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sifthouse.functions import scores
from sifthouse.operators import chunking, context, folders, folding, fusion, names, people, ranks, relations, research, retrieval, topics
from sifthouse.plans import query_plan
from sifthouse.queries import library, search, tables
from sifthouse.sources import readers
from sifthouse.streaming import files

SF = "/root/testdata/sf0.001"


def test_queries_are_parsed_with_their_filters():
    plan = query_plan.parse_query('photos of "old town" type:pdf,.Doc kind:photo,foo in:"My Lib" folder:"A b/c/" after:2021-02 before:2024 x:1 the')
    assert plan.text == "photos of old town x:1 the" and plan.phrases == ("old town",)
    assert plan.filters == query_plan.Filters(("image",), ("pdf", "doc"), ("My Lib",), "A b/c", "2021-02-01", "2024-01-01")
    assert plan.terms == ("photos", "old", "town") and plan.boosts == {"clip_text": 1.6, "compose": 1.3}
    assert query_plan.parse_query("the of").terms == ("the", "of")
    assert query_plan.parse_query("year:2023 a dog barking").filters == query_plan.Filters(after="2023-01-01", before="2024-01-01")
    assert query_plan.parse_query("mykind:photo ext:").filters == query_plan.Filters()
    assert [query_plan.date_bound(x, True) for x in ("2023-12", "2024", "2024-02-29", "2023-02-29", "x")] == ["2024-01-01", "2025-01-01", "2024-02-29", None, None]
    w = query_plan.weights(query_plan.parse_query("a podcast report"), people=True)
    assert w["transcript"] == pytest.approx(0.8 * 1.6) and w["bm25"] == 1.2 and w["face"] == 2.2 and w["name"] == 0.7
    assert query_plan.weights(query_plan.parse_query(""), pictures=True)["name"] == 0.0


def test_search_applies_filters_and_shows_why(spark):
    chunks = spark.createDataFrame([(1, 10, "solar power plants"), (2, 20, "solar panels on a roof"), (3, 30, "wind power"), (4, 40, "solar power plants")], "source_id long, chunk_id long, text string")
    sources = spark.createDataFrame([(i, "missing" if i == 4 else "indexed", "pdf", "document", "l", "f", f"f/{'solar' if i == 3 else 'x'}{i}.pdf", None, 1.6e9) for i in range(1, 5)],
                                    "source_id long, status string, ext string, kind string, library_id string, folder string, rel_path string, taken_at timestamp, mtime double")
    got = {r["file"]: r for r in query_plan.search(chunks, sources, query_plan.parse_query("solar power"), relative=1.0).collect()}
    assert set(got) == {1, 2, 3} and got[3]["matched_by"] == "bm25,name" and got[3]["evidence"] == "name" and got[1]["evidence"] == "keywords"
    assert query_plan.search(chunks, sources, query_plan.parse_query("solar kind:video")).count() == 0
    assert {r["file"] for r in query_plan.search(chunks, sources, query_plan.parse_query("folder:f")).collect()} == {1, 2, 3}


def test_phrases_count_as_words(spark):
    docs = spark.createDataFrame([(1, "new york city"), (2, "york new city"), (3, "city"), (4, "other")], "k long, text string")
    got = {r["k"]: r["full"] for r in retrieval.bm25(docs, ["city", "new york"], "k", {"text": 1.0}, 100).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert [r["k"] for r in retrieval.bm25(docs, ["new york", "city"], "k", {"text": 1.0}, 4).collect()] == [1]


def test_faces_leap_and_nulls_stay(spark):
    rows = spark.createDataFrame([(0.2,), (0.419999,), (0.42,), (0.75,), (None,)], "x double")
    got = [r[0] for r in rows.select(F.round(scores.calibrated(F.lit("face"), F.col("x")), 4)).collect()]
    assert got == [0.0, 0.45, 0.7, 0.98, None]
    assert rows.select(scores.threshold(F.lit("x"), 0.3), scores.calibrated(F.lit("dupe"), F.lit(40))).first()[:] == (0.3, 0.0)


def test_bursts_collapse_as_one_by_one(spark):
    rows = [tuple(r) for r in search.table(spark, SF, "documents").select("source", "doc_id", folding.hash_column(F.col("text")), F.col("n_chars") % 100).collect()]
    rng = random.Random(5)
    near = [("g", 1000 + i, rng.getrandbits(60) & ~0b111111 | rng.getrandbits(6), i % 7) for i in range(40)]
    near += [("g", 2000 + i, near[i % 40][2] ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)), i % 5) for i in range(160)]
    near.append(("g", 3000, None, 1))
    df = spark.createDataFrame(rows + near, "source string, id long, hash long, relevance long")
    for most in (4, 14):
        want = set()
        for group in {r[0] for r in rows + near}:
            kept = []
            for _, i, h, _ in sorted((r for r in rows + near if r[0] == group), key=lambda r: (-r[3], r[1])):
                into = next((k for k, other in kept if h is not None and other is not None and (h ^ other).bit_count() <= most), None)
                if into is None:
                    kept.append((i, h))
                want.add((group, i, into if into is not None else i))
        assert {tuple(r) for r in folding.collapse_bursts(df, "source", most, 60).collect()} == want


def test_ids_of_people_are_voted_by_size(spark):
    groups = [(i, f"g{g}") for g, ids in enumerate([range(0, 9), range(9, 16), range(16, 20), range(20, 22)]) for i in ids]
    faces = [(i, "a" if i < 4 else "b" if i < 9 else "a" if i < 14 else "gone" if i < 16 else "b" if i < 20 else "z", i == 20) for i in range(22)]
    got = {r["person"]: r["person_id"] for r in people.assign_ids(
        spark.createDataFrame(groups, "id long, person string"), spark.createDataFrame(faces, "id long, person_id string, locked boolean"), spark.createDataFrame([("a",), ("b",), ("z",)], "person_id string")).collect()}
    assert got["g0"] == "b" and got["g1"] == "a" and got["g3"] == "z" and got["g2"].startswith("p-")


def test_people_are_grouped_by_mutual_nearness(spark):
    got = {r["id"]: r["person"] for r in tables.people_cluster(spark, SF).collect()}
    rows = search.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    import numpy as np
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    near = [{int(j) for j in np.lexsort((ids, -s[i]))[:12] if s[i, j] >= 0.3} for i in range(len(ids))]
    part = list(range(len(ids)))
    for i in range(len(ids)):
        for j in near[i]:
            if i in near[j] and part[i] != part[j]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    want = {int(ids[i]): int(min(ids[j] for j in range(len(ids)) if part[j] == part[i])) for i in range(len(ids)) if part.count(part[i]) > 1}
    assert got == want


def test_locked_people_are_never_joined(spark):
    v = [[1.0, 0.0], [0.99, 0.14], [0.95, 0.31], [0.9, 0.436], [0.0, 1.0], [0.05, 0.9987]]
    vectors = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")
    locked = spark.createDataFrame([(0, "ann"), (3, "bea"), (4, "ann")], "id long, person_id string")
    got = {r["id"]: r["person"] for r in people.cluster(vectors, locked, floor=0.5).collect()}
    assert got[0] != got[3] and got[0] == got[4] == got[5] == got[1]


def test_locked_groups_of_the_table(spark):
    """The registered query beside joining the exact edges one by one."""
    from .test_graph import _joined_in_order

    held = search.table(spark, SF, "embeddings").select("vec_id", "embedding")
    marks = {r["id"]: r["person_id"] for r in tables.locks(spark, SF).collect()}
    edges = [tuple(r) for r in people.mutual_neighbours(held, floor=0.3).collect() if marks.get(r[0], "") is not None and marks.get(r[1], "") is not None]
    anchors = {i: p for i, p in marks.items() if p is not None}
    groups = {}
    for i, g in _joined_in_order(edges, anchors):
        groups.setdefault(g, []).append(i)
    want = {(i, g) for g, ids in groups.items() for i in ids if len(ids) > 1 or any(x in anchors for x in ids)}
    assert {(r["id"], r["person"]) for r in tables.people_cluster_locked(spark, SF).collect()} == want and len(groups) > 1


def test_locks_hold_over_chains(spark):
    """A face locked far off keeps its whole chain; one locked to nobody stands outside and carries no chain."""
    at = lambda a: [math.cos(math.radians(a)), math.sin(math.radians(a))]
    vectors = spark.createDataFrame([(i, at(20 * i)) for i in range(4)] + [(9, at(180))], "id long, v array<double>")
    group = lambda *locks: {r["id"]: r["person"] for r in people.cluster(vectors, spark.createDataFrame(list(locks), "id long, person_id string"), k=2, floor=0.9).collect()}
    assert group((0, "A")) == {0: 0, 1: 0, 2: 0, 3: 0}
    assert group((0, "A"), (9, "A")) == {0: 0, 1: 0, 2: 0, 3: 0, 9: 0}
    assert group((9, "B")) == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}  # an anchored group stays however small
    assert group((1, None)) == {2: 2, 3: 2}
    split = group((0, "A"), (3, "B"))
    assert split[0] != split[3] and set(split) == {0, 1, 2, 3}


def test_row_numbers_and_running_sums(spark):
    rows = [(k % 3, i, (i * 37) % 11) for i, k in enumerate(random.Random(1).choices(range(3), k=500))]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(7)
    want, sums = set(), set()
    for g in range(3):
        mine = sorted(r for r in rows if r[0] == g)
        total = 0
        for n, r in enumerate(mine):
            total += r[2]
            want.add((*r, n + 1, len(mine)))
            sums.add((*r, total))
    assert {tuple(r) for r in ranks.numbered(df, ["g"], [F.col("i")]).collect()} == want
    assert {tuple(r) for r in ranks.running_sum(df, ["g"], [F.col("i")], "v").collect()} == sums
    assert ranks.numbered(df.limit(0), ["g"], [F.col("i")]).count() == 0


TEXT = "\n\n".join(" ".join(f"word{i}x{j}." if j % 9 == 8 else f"word{i}x{j}" for j in range(60)) for i in range(30))


def test_chunks_are_packed_with_their_overlap():
    chunks = chunking.cut_text(TEXT, 1600, 240)
    assert all(12 <= len(c) <= 1600 for c in chunks)
    assert [w for w in dict.fromkeys(" ".join(chunks).split())] == TEXT.split()  # nothing is lost, in order
    for a, b in zip(chunks, chunks[1:]):
        tail = b.split("\n")[0]
        assert a.endswith(tail) and len(tail) <= 240  # the last words of the chunk before
    assert chunking.cut_text("x" * 4000, 1600) == ["x" * 1600, "x" * 1600, "x" * 240 + "\n" + "x" * 800]
    assert chunking.cut_text("") == chunking.cut_text("short") == [] and chunking.cut_text("a line\r\n\r\nand more") == ["a line\n\nand more"]
    assert chunking.fitting_parts("aa bb. cc dd", 7) == ["aa bb.", "cc dd"]
    legacy = chunking.legacy_chunks(TEXT)
    assert all(10 < len(c) <= 800 for c in legacy) and legacy[1][:20] in legacy[0]


def test_windows_over_speech():
    segments = [(i * 12.0, i * 12.0 + 10, f" part {i} ") for i in range(8)] + [(96.0, 97.0, " "), (98.0, 99.0, None)]
    got = chunking.spoken_windows(segments, 40, 10, 1600)
    assert got[0] == (0.0, 34.0, "part 0 part 1 part 2") and got[1] == (24.0, 58.0, "part 2 part 3 part 4") and got[-1][1] == 94.0
    assert chunking.spoken_windows([(0, 100, "long"), (101, 102, "b")], 40, 10, 1600) == [(0, 100, "long"), (101, 102, "b")]
    assert [w[2] for w in chunking.spoken_windows([(0, 1, "a" * 9), (1, 2, "b" * 9)], 40, 10, 12)] == ["a" * 9, "b" * 9]


def test_windows_of_most_hits():
    text = " ".join(f"a{i}" for i in range(100)) + " needle here and needle there " + " ".join(f"b{i}" for i in range(100))
    shown = chunking.snippet(text, {"needle"}, 100)
    assert shown.startswith("…") and shown.endswith("…") and shown.count("needle") == 2 and len(shown) <= 102
    assert chunking.snippet("a  short\ntext", {"x"}) == "a short text" and chunking.focus_window("abc " * 300, {"x"}, 8) == "abc abc "


def test_rows_of_tables_under_their_header():
    assert chunking.packed_rows(["a | b", "", "c | d", "e | f"], "h | i", 18) == ["h | i\na | b\nc | d", "h | i\ne | f"]


def test_frames_and_faces(spark):
    frames = [(1, t, h) for t, h in ((0.0, 0), (5.0, 1), (14.0, 3), (16.0, 0), (40.0, 0), (41.0, 255))] + [(2, 0.0, 7)]
    got = sorted(tuple(r) for r in chunking.keep_changed_frames(spark.createDataFrame(frames, "k long, ts double, hash long"), "k").collect())
    assert got == [(1, 0.0, 0), (1, 16.0, 0), (1, 40.0, 0), (1, 41.0, 255), (2, 0.0, 7)]
    faces = [(1, 0.0, 1, [1.0, 0.0]), (1, 2.0, 2, [0.0, 1.0]), (1, 8.0, 3, [0.9, 0.4]), (1, 9.0, 4, [0.1, 0.99]), (1, 30.0, 5, [1.0, 0.0])]
    got = [tuple(r)[2:] for r in chunking.face_tracks(spark.createDataFrame(faces, "k long, ts double, face long, v array<double>"), "k").orderBy("face").collect()]
    assert got == [(1, 1, True), (2, 2, True), (3, 1, False), (4, 2, False), (5, 5, True)]


def test_sources_are_chosen_within_their_budget(spark):
    rows = [(r["id"], r["kind"], r["score"], r["chosen"], r["tokens"]) for r in library._web_sources(spark, SF).collect()]
    for most, budget in ((8, 4_000), (3, 700), (8, 1_000)):
        order = sorted((r for r in rows if not r[3]), key=lambda r: (-r[2], r[0]))
        taken, used, kinds = [], 200, set()
        for r in sorted((r for r in rows if r[3]), key=lambda r: (-r[2], r[0])):
            if len(taken) < most and (used + r[4] + 30 <= budget or not taken):
                taken.append((r[0], "chosen"))
                kinds.add(r[1])
                used += r[4] + 30
        for why in ("kind", "score"):
            for r in order:
                if len(taken) < most and r[0] not in {t[0] for t in taken} and used + r[4] + 30 <= budget and (why == "score" or r[1] not in kinds and r[2] >= 50):
                    taken.append((r[0], why))
                    kinds.add(r[1])
                    used += r[4] + 30
        got = research.select_for_budget(library._web_sources(spark, SF), most, budget).orderBy("place").collect()
        assert [(r["id"], r["why"]) for r in got] == taken


def test_snapshots_with_nulls_and_lost_folders(spark):
    schema = "path string, size long, mtime double, fingerprint string"
    old = spark.createDataFrame([("a", None, 1.0, "x"), ("b", 2, None, "y"), ("off/c", 3, 1.0, "z"), ("d", 4, 1.0, "w")], schema)
    new = spark.createDataFrame([("a", None, 1.0, "x"), ("b", 2, 5.0, "y"), ("e", 4, 9.0, "w")], schema)
    got = {r["path"]: r["change"] for r in relations.snapshot_diff(old, new, "path", ["off"]).collect()}
    assert got == {"a": "unchanged", "b": "changed", "off/c": "missing", "e": "renamed"}
    assert {r["change"] for r in relations.snapshot_diff(old, new.limit(0), "path").collect()} == {"missing"}


def test_reports_are_split_from_articles(spark):
    rows = [("t", i, f"news {i}", "") for i in range(4)] + [("u", 9, "A policy", ""), ("u", 10, "news", "")]
    got = research.split_reports(spark.createDataFrame(rows, "topic string, id long, title string, description string"), [F.desc("id")])
    assert sorted((r["id"], r["kind"]) for r in got.collect()) == [(0, "article"), (1, "article"), (2, "article"), (2, "report"), (3, "article"), (3, "report"), (9, "report"), (10, "article")]


def test_folded_files_score_by_their_lists(spark):
    ranks_ = spark.createDataFrame([("bm25", 1, 3.0, 0), ("bm25", 2, 2.0, 1), ("face", 2, 0.5, 0), ("folder", 1, 1.0, 0)], "retriever string, file long, score double, rank int")
    fused = fusion.rrf(ranks_)
    got = {r["file"]: r for r in fusion.scored_files(ranks_, fused, has_faces=True).collect()}
    face = 0.7 + 0.08 / 0.33 * 0.28
    assert got[2]["evidence"] == "face" and got[2]["relevance"] == pytest.approx(face + 0.15 * face * (1 - face))
    assert got[1]["evidence"] == "folder" and got[1]["relevance"] == pytest.approx(max(0.65 + 0.35 * 0.85 * 0.35, 0.85))


def test_folders_are_named_by_words_and_paths(spark):
    paths = ["Photos/2021/Goa Trip"] * 4 + ["Photos/2022/Goa Wedding"] * 3 + ["Photos/2022/Rahul_Wedding2023/raw"] * 2 + ["Work/Goa"] * 2 + ["Work/other"] * 9
    rows = spark.createDataFrame([(i, p, "indexed", f"{p}/{i}.jpg") for i, p in enumerate(paths)], "source_id long, folder string, status string, rel_path string")
    names = lambda text: [(r["path"], r["files"]) for r in folders.match_folders(rows, text).collect()]
    assert names("beach in goa") == [("Photos/2021/Goa Trip", 4), ("Photos/2022/Goa Wedding", 3), ("Work/Goa", 2)]
    assert names("goa wedding") == [("Photos/2022/Goa Wedding", 3)]
    assert names("wedding of rahul 2023") == [("Photos/2022/Rahul_Wedding2023", 2)]
    assert names("photos") == [] and names("the of") == [] and names("nothing here") == []
    assert names("see work/goa please") == [("Work/Goa", 2)] and names("2022 / goa wedding") == [("Photos/2022/Goa Wedding", 3)]
    assert folders.content_text("beach in goa Rahul2023", {"goa", "rahul", "2023"}) == "beach in"
    scopes = folders.match_folders(rows, "wedding")
    assert {r["source_id"] for r in folders.scope_members(rows, scopes).collect()} == {4, 5, 6, 7, 8}


def test_a_named_folder_lifts_its_files(spark):
    paths = ["Trips/Goa"] * 3 + ["Work"] * 5
    sources = spark.createDataFrame([(i, "indexed", "txt", "document", "l", p, f"{p}/{i}.txt", None, 1.0) for i, p in enumerate(paths)],
                                    "source_id long, status string, ext string, kind string, library_id string, folder string, rel_path string, taken_at timestamp, mtime double")
    chunks = spark.createDataFrame([(i, i, "sunset at the beach" if i in (1, 6) else "plain words") for i in range(8)], "source_id long, chunk_id long, text string")
    got = {r["file"]: r for r in query_plan.search(chunks, sources, query_plan.parse_query("sunset in goa"), relative=1.0).collect()}
    assert set(got) == {0, 1, 2, 6} and max(got, key=lambda f: got[f]["relevance"]) == 1
    assert got[0]["matched_by"] == "folder,name" and got[1]["matched_by"] == "bm25,folder,folder_bm25,name" and got[6]["matched_by"] == "bm25"


def test_files_follow_their_events_and_go_on_after_a_stop(spark, tmp_path):
    schema = "ts timestamp, event string, path string, dest string, is_dir boolean, size long, mtime double"
    rows = lambda *r: spark.sql("select * from values " + ", ".join(
        f"(timestamp'2024-01-01 00:00:{t:02d}', '{e}', '{p}', cast({repr(d) if d else 'null'} as string), {dirs}, {size}L, {size}.0D)" for t, e, p, d, dirs, size in r) + " as t(ts, event, path, dest, is_dir, size, mtime)")
    source, folder = f"{tmp_path}/events", f"{tmp_path}/run"
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    table = lambda: {tuple(r)[:2] for r in files.follow(stream(), folder).collect()}
    rows((1, "created", "a/one.txt", None, "false", 1), (2, "created", "a/two.txt", None, "false", 2), (3, "modified", "a/one.txt", None, "false", 3), (4, "created", "b/x.exe", None, "false", 4), (5, "created", ".git/y.txt", None, "false", 5)).write.parquet(source)
    assert table() == {("a/one.txt", 3), ("a/two.txt", 2)}
    rows((6, "moved", "a", "c/d", "true", 0), (7, "moved", "z/up.part", "c/new.pdf", "false", 0)).write.mode("append").parquet(source)
    assert table() == {("c/d/one.txt", 3), ("c/d/two.txt", 2), ("c/new.pdf", None)}
    rows((8, "deleted", "c/d/one.txt", None, "false", 0), (9, "modified", "c/d/one.txt", None, "false", 9), (10, "moved", "c/d/two.txt", "c/d/two.bak", "false", 0), (11, "deleted", "c/new.pdf", None, "false", 0)).write.mode("append").parquet(source)
    assert table() == {("c/d/one.txt", 9)}
    assert table() == {("c/d/one.txt", 9)}  # nothing new: nothing runs again


def test_queued_rows_are_finished_by_their_holder_only(spark):
    queue = spark.createDataFrame([(1, 5, 10, "queued", 0, None), (2, 9, 30, "queued", 2, None), (3, 9, 20, "queued", 0, None), (4, 9, 1, "queued", 3, None)], "id long, priority int, size long, status string, attempts int, worker string")
    held = files.claim(queue, "w", 2)
    assert {r["id"] for r in held.filter("worker = 'w'").collect()} == {2, 3}
    results = spark.createDataFrame([(2, "w", False), (3, "other", True), (1, "w", True)], "id long, worker string, ok boolean")
    assert {(r["id"], r["status"]) for r in files.finish(held, results).collect()} == {(1, "queued"), (2, "failed"), (3, "processing"), (4, "queued")}


def test_topics_of_a_file(spark):
    rows = [
        (1, "report_final.pdf", "Events/Rahul Wedding 2021", ["Page 3", "Budget Overview", "report final"], "Union Public Service met. Union Public Service spoke of water, water and water.", ["Ann Lee"], None, False),
        (2, "IMG_0042.jpg", "DCIM/100MSDCF", [], "", [], None, False),
        (3, "Garden plans.txt", "", [], "", [], None, None),
        (4, "x.txt", None, None, "the annual goa trip of 2019 and Goa Trip 2019", None, None, False),
        (5, "IMG_7.jpg", "Pictures/2021/Goa Trip/110EOSR6", ["Heading"], "words words words", ["Bo Ray"], ["at the Goa Music Festival 2020", "Red Fort Road, Red Fort Road", None], True),
        (6, "b.txt", "a", [], "one Big House, two Old Mill, three Wide Road, four Long Lane. Old Mill.", [], ["Sitting Sitting Stage Stage: Grand Old Hotel"], False),
        (7, None, None, None, None, None, None, None)]
    schema = "id long, name string, folder string, headings array<string>, text string, people array<string>, captions array<string>, is_image boolean"
    files_ = spark.createDataFrame(rows, schema)
    got = {r["id"]: (r["topics"], r["events"]) for r in topics.derive_topics(files_, "id").collect()}
    assert got[1] == (["Ann Lee", "Budget Overview", "Rahul Wedding 2021", "Union Public Service", "Water"], ["Rahul Wedding 2021"])
    assert got[2] == got[7] == ([], [])
    assert got[3] == (["Garden plans"], [])
    assert got[4][1] == ["Goa Trip 2019"]
    # a picture: its folders, people and printed names; its words and headings say nothing
    assert got[5] == (["Goa Trip", "Goa Music Festival 2020", "Bo Ray", "Red Fort Road"], ["Goa Trip", "Goa Music Festival 2020"])
    # of many names only repeated ones; the words of captions are not counted
    assert got[6][0] == ["Old Mill"]
    plain = topics.derive_topics(files_.drop("captions", "is_image"), "id")
    assert plain.filter("id = 1").first()["topics"] == got[1][0]


def test_long_segments_are_split_at_punctuation():
    words = [(float(i), i + 0.9, f" w{i}" + ("." if i in (4, 9, 20) else "")) for i in range(30)]
    pieces = context.spoken_pieces(words)
    assert [p[:2] for p in pieces] == [(0.0, 9.9), (10.0, 20.9), (21.0, 29.9)] and pieces[0][2].endswith("w9.")
    assert context.spoken_pieces(words[:5]) == [(0.0, 4.9, "w0 w1 w2 w3 w4.")]
    assert context.spoken_pieces([(float(i), i + 1.0, " x") for i in range(20)])[0][:2] == (0.0, 14.0)
    assert context.spoken_pieces([]) == []


def test_summaries_in_runs_that_fit(spark):
    assert context.budget_groups(["a", "b", "c", "d"], [5, 6, 20, 1], 12) == [["a", "b"], ["c"], ["d"]]
    got = library.table(spark, SF, "conversations").select(F.col("conv_id").alias("job"), F.col("turn").alias("place"), "text")
    runs = context.summary_groups(got, 120).orderBy("job", "part").collect()
    by = {}
    for r in runs:
        by.setdefault(r["job"], []).extend(r["texts"])
    want = {}
    for r in got.orderBy("job", "place").collect():
        want.setdefault(r["job"], []).append(r["text"])
    assert by == want


def test_fingerprints_sample_large_files(spark):
    import hashlib

    small, large = b"abc", bytes(range(256)) * 4096 * 4
    files_ = spark.createDataFrame([(1, bytearray(small)), (2, bytearray(large)), (3, None)], "id long, content binary")
    got = {r["id"]: r["fingerprint"] for r in context.fingerprints(files_, "id", "content").collect()}
    m, half = 1 << 20, len(large) // 2
    assert got[1] == hashlib.blake2b(b"3abc", digest_size=16).hexdigest() and got[3] is None
    assert got[2] == hashlib.blake2b(str(len(large)).encode() + large[:m] + large[half - m // 2 : half + m // 2] + large[-m:], digest_size=16).hexdigest()


def test_readers_of_files_and_feeds(spark, tmp_path):
    (tmp_path / "docs" / ".git").mkdir(parents=True)
    (tmp_path / "docs" / "node_modules").mkdir()
    for name, text in (("docs/a.md", "# A"), ("docs/b.CSV", "x,y\n1,\n"), ("docs/.git/c.txt", "no"), ("docs/node_modules/d.txt", "no"), ("docs/e.bin", "no")):
        (tmp_path / name).write_text(text)
    got = {(r["rel_path"], r["ext"], r["kind"], r["size"]) for r in readers.scan_folder(spark, f"file://{tmp_path}/docs").collect()}
    assert got == {("a.md", "md", "document", 3), ("b.CSV", "csv", "document", 7), ("e.bin", "bin", "unsupported", 2)}
    assert [r["text"] for r in readers.read_text(spark, f"{tmp_path}/docs/a.md").collect()] == ["# A"]
    assert [tuple(r) for r in readers.read_table(spark, f"{tmp_path}/docs/b.CSV").collect()] == [("1", None)]
    feed = "<rss><channel><item><title>A</title><link>l</link><description>ISBN: 3-16-148410-X, old</description></item><item><title>B</title><link>m</link><description>none</description></item></channel></rss>"
    items = readers.parse_rss(spark.createDataFrame([(feed,)], "xml string"), "xml").collect()
    assert [(r["title"], r["link"], r["isbn"]) for r in items] == [("A", "l", "3-16-148410-X"), ("B", "m", None)]
    marc = ("<record xmlns='http://x'><datafield tag='245'><subfield code='a'>A book /</subfield></datafield><datafield tag='100'><subfield code='a'>Lee, Ann</subfield></datafield>"
            "<datafield tag='260'><subfield code='b'>Press</subfield><subfield code='c'>c1999.</subfield></datafield><datafield tag='650'><subfield code='a'>Birds</subfield></datafield></record>")
    r = readers.parse_marc(spark.createDataFrame([(marc,)], "xml string"), "xml").first()
    assert (r["title"], r["authors"], r["publisher"], r["year"], r["subjects"], r["isbn"]) == ("A book", ["Lee, Ann"], "Press", "1999", ["Birds"], None)
    found = '{"_embedded":{"searchResult":{"_embedded":{"objects":[{"hitHighlights":{"dc.title":["<em>T</em>"],"fulltext":["a <em>b</em>"]},"_embedded":{"indexableObject":{"handle":"1/2","metadata":{"dc.title":[{"value":"T"}],"dc.date.issued":[{"value":"2020-05"}],"dc.identifier.doi":[{"value":"https://doi.org/10.1/x"}]}}}}]}}}}'
    r = readers.parse_discover(spark.createDataFrame([(found,)], "j string"), "j").first()
    assert tuple(r) == ("1/2", "T", "2020", "10.1/x", "a b")
    rows, status = readers.federate({"one": spark.createDataFrame([(1,)], "id long"), "two": TimeoutError("late")})
    assert [tuple(r) for r in rows.collect()] == [(1, "one")] and status == [("one", "ok"), ("two", "failed: late")]


def test_intervals_that_meet(spark):
    """Half of the rows in one key, one interval over everything, equal bounds, points, nulls and intervals the wrong way round."""
    rng = random.Random(8)
    def some(n, first):
        rows = [(0 if i % 2 else rng.randrange(5), first + i, float(rng.randrange(4_000)), 0.0) for i in range(n)]
        rows = [(k, i, s, s + rng.choice([0, 1, 5, 40])) for k, i, s, _ in rows]
        return rows + [(0, first + n, -1.0, 9_999.0), (3, first + n + 1, 50.0, 40.0), (None, first + n + 2, 0.0, 10.0), (0, first + n + 3, None, 10.0)]
    left, right = some(1_500, 0), some(1_300, 10_000)
    want = {(a[1], b[1]) for a in left for b in right if a[0] is not None and a[0] == b[0] and None not in (a[2], b[2]) and a[2] <= a[3] and b[2] <= b[3] and a[3] >= b[2] and a[2] <= b[3]}
    got = relations.interval_overlap(spark.createDataFrame(left, "k int, a long, ls double, le double"), spark.createDataFrame(right, "k int, b long, rs double, re double"), "k")
    assert got.columns == ["k", "a", "ls", "le", "b", "rs", "re"]
    pairs = [(r["a"], r["b"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_names_by_their_trigrams(spark, tmp_path):
    """Substrings and beginnings by the index equal those by all names; odd names and terms too."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["Red", "steel", "ring", "größe", "日本語", "a", "%x_", "InG"]) for _ in range(rng.randint(1, 4)))) for i in range(400)] + [(500, ""), (501, None), (502, "ab"), (None, "steel")]
    table = spark.createDataFrame(rows, "id long, name string").repartition(4)
    names.build(table, f"{tmp_path}/names", "id", "name")
    index, known = names.NameIndex(spark, f"{tmp_path}/names"), table.filter("id is not null and name is not null")
    for terms in (["ste", "red", "ing", "of"], ["größe", "本語"], ["steel ring"], ["zzz", "teel"], ["x"], ["日本語", "日本語"]):
        used = [t for t in terms if len(t) >= 3]
        want = [tuple(r) for r in retrieval.name_search(known, terms, "id", "name", 40).collect()] if used else []
        assert [tuple(r) for r in index.search(terms, 40).collect()] == want
    low = {i: n.lower() for i, n in rows if i is not None and n is not None}
    for term in ("ing", "%x_", "e", "steel r", "none of it", "größ"):
        assert {r["key"] for r in index.containing(term).collect()} == {i for i, n in low.items() if term in n}
        assert {r["key"] for r in index.starting(term).collect()} == {i for i, n in low.items() if n.startswith(term)}
    plan = index.starting("Ste")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,ste)" in plan


def test_long_chains_of_pictures_fold_in_few_rounds(spark, monkeypatch):
    """A walk of pictures, each near to the next alone: rounds grow with the logarithm of its length, not with it."""
    rng, walk, h = random.Random(6), [], 0
    n = 400
    for i in range(n):  # four more bits from step to step, one by one through the word and back
        for b in range(5):
            h ^= 1 << ((5 * i + b) % 60)
        walk.append(h)
    near = lambda x, y: (x ^ y).bit_count() <= 6
    rows = [("g", i, x, float(n - i)) for i, x in enumerate(walk)] + [("r", i, rng.choice(walk[:60]) ^ (1 << rng.randrange(60)), rng.random()) for i in range(150)]
    calls = []
    monkeypatch.setattr(folding, "settle", lambda df, f=folding.settle: calls.append(1) or f(df))
    got = {(r["g"], r["id"]): r["kept_id"] for r in folding.collapse_bursts(spark.createDataFrame(rows, "g string, id long, hash long, relevance double"), "g").collect()}
    want, kept = {}, {}
    for g, i, x, _ in sorted(rows, key=lambda r: (-r[3], r[1])):
        into = next((k for k, y in kept.get(g, ()) if near(x, y)), None)
        want[g, i] = i if into is None else into
        if into is None:
            kept.setdefault(g, []).append((i, x))
    assert got == want and len(calls) < 60


def test_bursts_of_narrow_bands_meet_in_blocks_and_rows_without_a_group_stay(spark, monkeypatch):
    """Hashes whose bands are narrow are compared in blocks; a null group, with which rounds never ended, keeps its rows."""
    monkeypatch.setattr(folding, "HASH_BLOCK", 50, raising=False)
    calls, settle = [], folding.settle

    def counted(df):
        calls.append(1)
        assert len(calls) < 80
        return settle(df)

    monkeypatch.setattr(folding, "settle", counted)
    rng = random.Random(8)
    rows = [(f"g{i % 2}", i, rng.getrandbits(12) << 48 | rng.getrandbits(12), i % 9) for i in range(300)] + [(None, 1000 + i, 5, i) for i in range(3)]
    got = {r["id"]: r["kept_id"] for r in folding.collapse_bursts(spark.createDataFrame(rows, "g string, id long, hash long, relevance long"), "g", 8, 60).collect()}
    want, kept = {i: i for g, i, _, _ in rows if g is None}, {}
    for g, i, h, _ in sorted((r for r in rows if r[0]), key=lambda r: (-r[3], r[1])):
        want[i] = next((k for k, x in kept.get(g, ()) if (h ^ x).bit_count() <= 8), i)
        if want[i] == i:
            kept.setdefault(g, []).append((i, h))
    assert got == want and len(set(want.values())) < 200


def test_neighbours_of_blocks_that_pass_are_the_best_of_all_and_copies_stay_few(spark, monkeypatch):
    """A task keeps ``k`` rows a vector however many blocks pass and however many copies tie; equal scores go by the smaller id."""
    import numpy as np
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "WAYS", 2, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    x[100:250] = x[100]
    x[300:310] *= 1e20
    ids = rng.permutation(1000)[:400]
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")
    for floor in (None, 0.5):
        blocks = retrieval.packed_blocks(vectors)
        rows = retrieval.block_best(blocks, blocks, 5, floor).collect()
        assert len(rows) <= 400 * 5 * 2
        got = {}
        for r in sorted(rows, key=lambda r: (-r["score"], r["dst"])):
            got.setdefault(r["src"], []).append((r["dst"], r["score"]))
        for i, a in zip(ids, x):
            scores_ = sorted((-math.fsum(a * b), int(j)) for j, b in zip(ids, x) if j != i)[:5]
            assert got.get(i, [])[:5] == [(j, -s) for s, j in scores_ if floor is None or -s >= floor]


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    """Chunks of a large batch of texts don't gather in its task: none that it gives holds many more than ``GIVEN`` characters."""
    monkeypatch.setattr(chunking, "GIVEN", 20_000)
    seen = []
    texts = [(i, None if i == 7 else f"word{i} and more. " * (i % 90)) for i in range(900)]
    docs = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.extend(run(iter(self.toArrow().to_batches()))))
    for call, cut in ((chunking.chunk_text, chunking.cut_text), (chunking.cut_legacy, chunking.legacy_chunks)):
        seen.clear()
        call(docs, "id", "text")
        assert len(seen) > 10 and max(sum(map(len, b.column("chunk").to_pylist())) for b in seen) < 24_000
        got = [tuple(r.values()) for b in seen for r in b.to_pylist()]
        assert got == [(i, o, c) for i, t in texts for o, c in enumerate(cut(t or ""))]


def test_windows_of_many_sources_in_a_stream_of_rows(spark):
    """Rows of all sources pass one after the other and give each source's own windows."""
    rng = random.Random(3)
    rows = [(k, t, round(t + rng.random() * 9, 2), rng.choice(["", None, " said", "words " * rng.randint(1, 40)])) for k in range(6) for t in sorted(round(rng.random() * 400, 2) for _ in range(60))]
    got = {}
    for r in chunking.transcript_windows(spark.createDataFrame(rows, "k long, ts_start double, ts_end double, text string").repartition(5), "k", 40.0, 10.0, 600).collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    for k in range(6):
        mine = sorted((r[1:] for r in rows if r[0] == k), key=lambda r: r[:2])
        said = [(a, b, t.strip()) for a, b, t in mine if t and t.strip()]
        want, first = [], 0
        while first < len(said):  # one window after the other over the whole list
            stop = first + 1
            while stop < len(said) and said[stop][1] - said[first][0] <= 40.0 and len(" ".join(t for _, _, t in said[first : stop + 1])) <= 600:
                stop += 1
            end = said[stop - 1][1]
            want.append((said[first][0], end, " ".join(t for _, _, t in said[first:stop])))
            if stop == len(said):
                break
            late = [i for i in range(first + 1, stop) if said[i][0] < end - 10.0]
            first = max(late, default=first) + 1
        assert sorted(got.get(k, [])) == sorted((round(a, 2), round(b, 2), t) for a, b, t in want)
