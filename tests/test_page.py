"""A whole search beside a plain model of it: lists, fusion, gates, verdicts, scores, folding and the page."""

import math
import random

import pytest

from sifthouse.operators import postings
from sifthouse.plans import page
from sifthouse.plans.query_plan import parse_query, weights

WORDS = [f"w{i}" for i in range(30)]
SOURCES = "source_id long, status string, ext string, kind string, library_id string, folder string, rel_path string, name string, taken_at timestamp, mtime double"


def _unit(rng, n=6):
    v = [rng.gauss(0, 1) for _ in range(n)]
    size = math.sqrt(sum(x * x for x in v))
    return [round(x / size, 6) for x in v]


@pytest.fixture(scope="module")
def world():
    rng = random.Random(12)
    sources, chunks, vectors, pictures, faces, sounds = [], [], [], [], [], []
    for i in range(48):
        kind = ("document", "image", "video", "audio")[i % 4]
        folder = "Trips/Goa" if i % 9 == 0 else f"Other/{('alpha', 'beta', 'gamma', 'delta', 'omega')[i % 5]}"
        name = f"{rng.choice(WORDS)}_{i}.x"
        sources.append((i, "missing" if i == 40 else "indexed", "x", kind, "l", folder, f"{folder}/{name}", name, None, float(i)))
        if kind != "image":
            for j in range(4):
                c = 10 * i + j
                chunks.append((i, c, "transcript" if kind in ("video", "audio") and j % 2 else "text", " ".join(rng.choices(WORDS, k=rng.randint(4, 30))), rng.choice([None, "", "w3 head"])))
                vectors.append((c, _unit(rng)))
        if kind in ("image", "video"):
            for j in range(2):
                h = rng.choice([0, 1, 3, 1 << 40, rng.getrandbits(60)])
                pictures.append((i, 10 * i + j, _unit(rng), h, rng.choice([None, "", " ".join(rng.choices(WORDS, k=4))])))
            faces.append((i, 10 * i, _unit(rng)))
        if kind in ("video", "audio"):
            sounds.append((i, 10 * i, _unit(rng)))
    return dict(sources=sources, chunks=chunks, vectors=vectors, pictures=pictures, faces=faces, sounds=sounds)


@pytest.fixture(scope="module")
def tables(spark, world):
    make = lambda name, schema: spark.createDataFrame(world[name], schema)
    return page.Tables(
        make("sources", SOURCES), make("chunks", "source_id long, chunk_id long, kind string, text string, heading string"), make("vectors", "chunk_id long, v array<double>"),
        make("pictures", "source_id long, picture_id long, v array<double>, hash long, caption string"), make("faces", "source_id long, face_id long, v array<double>"), make("sounds", "source_id long, segment_id long, v array<double>"))


def _bm25(rows, terms):
    """``rows``: id and its two texts."""
    held = {i: ((t or "").split(), (h or "").split()) for i, t, h in rows}
    n, average = len(held), sum(len(t) + len(h) for t, h in held.values()) / max(len(held), 1) or 1.0
    tf = {i: [t.count(x) + 0.4 * h.count(x) for x in terms] for i, (t, h) in held.items()}
    often = [sum(f[j] > 0 for f in tf.values()) for j in range(len(terms))]
    score = lambda i: sum(max(math.log((n - often[j] + 0.5) / (often[j] + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(held[i][0]) + len(held[i][1])) / average)) for j, f in enumerate(tf[i]))
    full = [i for i in held if all(tf[i])]
    return {i: score(i) for i in (full if len(full) >= 50 else [i for i in held if any(tf[i])])}


def _ramp(points, x):
    if x <= points[0][0]:
        return points[0][1]
    for (a, b), (c, d) in zip(points, points[1:]):
        if x < c:
            return b + (d - b) * (x - a) / (c - a)
    return points[-1][1]


TEXT_TO_TEXT, TEXT_TO_PICTURE, PICTURE_TO_PICTURE = [(0.3, 0), (0.4, 0.2), (0.7, 0.95)], [(0.22, 0), (0.3, 0.15), (0.6, 0.92)], [(0.5, 0), (0.65, 0.25), (0.92, 0.98)]


def _meaning(name, s):
    return {
        "dense": lambda: _ramp(TEXT_TO_TEXT, s), "extra": lambda: _ramp(TEXT_TO_TEXT, s), "folder_dense": lambda: _ramp(TEXT_TO_TEXT, s), "clip_text": lambda: _ramp(TEXT_TO_PICTURE, s),
        "folder_clip": lambda: _ramp(TEXT_TO_PICTURE, s), "clip_image": lambda: _ramp(PICTURE_TO_PICTURE, s), "compose": lambda: 0.95 * _ramp(PICTURE_TO_PICTURE, s),
        "face": lambda: _ramp([(0.25, 0), (0.42, 0.45)], s) if s < 0.42 else _ramp([(0.42, 0.7), (0.75, 0.98)], s), "dupe": lambda: max(0.0, 1 - (64 - s) / 32), "name": lambda: 0.35 + 0.5 * s,
        "sound": lambda: _ramp([(0.08, 0), (0.15, 0.2), (0.35, 0.92)], s), "sound_audio": lambda: _ramp([(0.45, 0), (0.6, 0.3), (0.92, 0.98)], s)}[name]()


def _share(query, passage):
    # a list of scored words, as the stand-in judge takes them
    asked, said = [w for w in dict.fromkeys(query.lower().split()) if w != "in"], set(page.re.findall(r"[^\W_]+", passage.lower()))
    return sum(w in said for w in asked) / len(asked)


def _model(w, text, sig, limit, folder=None, content="", judge_pictures=False):
    """The page, step by step over plain lists: ``file`` to what is shown of it."""
    plan = parse_query(text)
    live = {s[0]: s for s in w["sources"] if s[1] != "missing"}
    lists = {}

    def put(name, scores, owner, kind):
        ranked = sorted(((s, e) for e, s in scores.items() if owner(e) in live), key=lambda x: (-x[0], x[1]))
        lists[name] = [(owner(e), e, s, kind) for s, e in ranked]

    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cut = lambda scores, most: dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:most])
    chunk_of = {c[1]: c for c in w["chunks"] if c[0] in live}
    vec = {c: v for c, v in w["vectors"] if c in chunk_of}
    own_chunk, own_ten = (lambda e: chunk_of[e][0]), (lambda e: e // 10)
    inside = {i for i, s in live.items() if folder and s[5] == folder}
    if plan.terms:
        put("bm25", cut(_bm25([(c[1], c[3], c[4]) for c in chunk_of.values()], plan.terms), 200), own_chunk, "chunk")
        used = [t for t in plan.terms if len(t) >= 3]
        named = {i: sum(t in s[6].lower() for t in used) / len(used) for i, s in live.items()} if used else {}
        put("name", cut({i: x for i, x in named.items() if x}, 50), lambda e: e, "source")
    near = lambda rows, qs: {e: max(dot(v, q) for q in qs) for e, v in rows.items()}
    pics = {p[1]: p for p in w["pictures"] if p[0] in live}
    seen = {e: p[2] for e, p in pics.items()}
    if sig.text:
        put("dense", near(vec, [sig.text]), own_chunk, "chunk")
    if sig.extra:
        put("extra", cut(near(vec, sig.extra), 100), own_chunk, "chunk")
    if sig.seen:
        put("clip_text", near(seen, [sig.seen]), own_ten, "visual")
    if sig.image:
        put("clip_image", near(seen, [sig.image]), own_ten, "visual")
    if sig.image and sig.seen:
        m = [a + 0.6 * b for a, b in zip(sig.image, sig.seen)]
        put("compose", near(seen, [[x / math.sqrt(dot(m, m)) for x in m]]), own_ten, "visual")
    if sig.hash is not None:
        put("dupe", {e: 64 - (p[3] ^ sig.hash).bit_count() for e, p in pics.items() if (p[3] ^ sig.hash).bit_count() <= 10}, own_ten, "visual")
    if sig.faces:
        put("face", near({f[1]: f[2] for f in w["faces"]}, sig.faces), own_ten, "face")
    if sig.heard:
        put("sound", near({f[1]: f[2] for f in w["sounds"]}, [sig.heard]), own_ten, "audio")
    if sig.sound:
        put("sound_audio", near({f[1]: f[2] for f in w["sounds"]}, [sig.sound]), own_ten, "audio")
    if folder:
        put("folder", {i: 1.0 for i in inside}, lambda e: e, "source")
        rest = parse_query(content)
        if rest.terms:
            put("folder_bm25", _bm25([(c[1], c[3], c[4]) for c in chunk_of.values() if c[0] in inside], rest.terms), own_chunk, "chunk")
            if sig.text:
                put("folder_dense", near({e: v for e, v in vec.items() if own_chunk(e) in inside}, [sig.text]), own_chunk, "chunk")
            if sig.seen:
                put("folder_clip", near({e: v for e, v in seen.items() if own_ten(e) in inside}, [sig.seen]), own_ten, "visual")
    both = {}
    for name in ("dense", "bm25"):
        for f, e, s, k in lists.get(name, ()):
            if chunk_of[e][2] == "transcript":
                both[e] = max(s, both.get(e, -9))
    put("transcript", both, own_chunk, "chunk")
    best, fused, count = {}, {}, weights(plan, pictures=sig.image is not None)
    for name, hits in lists.items():
        files = {}
        for f, e, s, k in hits:
            files[f] = max(s, files.get(f, -9))
        levels = sorted(set(files.values()), reverse=True)
        for place, (f, s) in enumerate(sorted(files.items(), key=lambda x: (-x[1], x[0]))):
            best.setdefault(f, {})[name] = s
            fused[f] = fused.get(f, 0) + count[name] / (61 + (levels.index(s) if name == "folder" else place))
    if sig.faces and (plan.text or sig.extra):
        fused = {f: x for f, x in fused.items() if best[f].get("face", 0) >= 0.42}
    ranked = sorted(fused, key=lambda f: (-fused[f], f))

    def pool(n):
        if not folder:
            return ranked[:n]
        out = [f for f in ranked if f not in inside][: n // 3]
        return sorted(out + [f for f in ranked if f in inside][: n - len(out)], key=lambda f: (-fused[f], f))

    verdict = {}
    for place, f in enumerate(pool(30) if plan.terms else ()):
        query = content if content and f in inside else plan.text
        mine = {n: [(e, s) for g, e, s, k in lists.get(n, ()) if g == f] for n in (*page.TEXT_LISTS, *page.PICTURE_LISTS)}
        picked, budget = [], 3 if place < 10 else 1
        for depth in range(budget):
            for n in page.TEXT_LISTS:
                if depth < len(mine[n]) and mine[n][depth][0] not in picked:
                    picked.append(mine[n][depth][0])
        title = live[f][6]
        told = "Title: " + title + "\n" if set(page.re.sub(r"[^\w]+", " ", title.lower()).split()) & set(query.lower().split()) else ""
        passages = [told + (chunk_of[e][4] + "\n" if chunk_of[e][4] else "") + chunk_of[e][3] for e in picked[:budget]]
        if not passages:
            told_by = [pics[mine[n][0][0]][4] for n in page.PICTURE_LISTS if mine[n] and (pics[mine[n][0][0]][4] or "").strip()]
            passages = [told + told_by[0]] if told_by else ["Title: " + title] if "name" in best[f] else []
        for p in passages:
            verdict[f] = max(_share(query, p), verdict.get(f, 0))
    for f in pool(12) if judge_pictures and plan.text else ():
        if f in inside and not content:
            continue
        shown = [(s, -e) for n in ("clip_text", "compose", *(("folder_clip",) if f in inside else ())) for g, e, s, k in lists.get(n, ()) if g == f]
        if shown:
            verdict[f] = max(_share(content if f in inside else plan.text, pics[-max(shown)[1]][4] or ""), verdict.get(f, 0))
    top, out = max(fused.values(), default=1), {}
    visual = ("clip_text", "clip_image", "compose", "face", "dupe", "name", "sound", "sound_audio", "folder_clip")
    for f in ranked:
        means = {n: _meaning(n, s) for n, s in best[f].items() if n in (*visual, "dense", "extra", "folder_dense") and not (n == "name" and f in inside)}
        norm, pictured = fused[f] / top if top else 0, max((v for n, v in means.items() if n in visual), default=0)
        if f in verdict:
            r = verdict[f]
            score = max(0.7 * r + 0.3 * max(pictured, norm * 0.8 * min(1, 4 * r)), pictured)
        elif means:
            one, two = (sorted(means.values(), reverse=True) + [0])[:2]
            score = min(0.99, one + 0.1 * two * (1 - one))
        else:
            score = 0.25 + 0.4 * norm
        if sig.faces and "face" in means and (plan.text or sig.extra):
            score = min(0.99, score + 0.15 * means["face"] * (1 - score))
        if f in inside:
            at = 0.45 + 0.4
            score = min(0.99, max(score + 0.35 * at * (1 - score), at * (0.4 if content else 1)))
        if score >= 0.15:
            out[f] = score
    order = sorted(out, key=lambda f: (-out[f], f))
    first = {}
    for p in w["pictures"]:
        first.setdefault(p[0], p[3])
    kept, copies = [], {}
    for f in order:
        like = [g for g in kept if live[f][3] == live[g][3] == "image" and (first[f] ^ first[g]).bit_count() <= 6]
        if like:
            copies[like[0]] = copies.get(like[0], 0) + 1
        else:
            kept.append(f)
    shown = {}
    for kind in ("document", "image", "video", "audio"):
        for place, f in enumerate([f for f in kept if live[f][3] == kind][:limit]):
            shown[f] = (kind, place + 1, round(out[f], 4), ",".join(sorted(best[f])), copies.get(f, 0))
    return shown


def _got(df):
    return {r["file"]: (r["kind"], r["place"], r["relevance"], r["matched_by"], r["copies"]) for r in df.collect()}


def _signals():
    rng = random.Random(4)
    one = lambda: _unit(rng)
    return one


@pytest.mark.parametrize("case", ["words", "everything", "folder", "faces", "picture"])
def test_search_beside_a_plain_model(spark, tables, world, case):
    one = _signals()
    near = [round(x, 6) for x in world["faces"][5][2]]
    text, sig, more = {
        "words": ("w1 w2 w7", page.Signals(), {}),
        "everything": ("w4 w9", page.Signals(one(), (one(), one()), one(), one(), 1, (), one(), one()), {"judge_pictures": True}),
        "folder": ("w5 in goa", page.Signals(one(), (), one()), {"folder": "Trips/Goa", "content": "w5 in", "judge_pictures": True}),
        "faces": ("w3", page.Signals(one(), faces=(near, one())), {}),
        "picture": ("", page.Signals(image=one(), hash=3), {}),
    }[case]
    judge = page.word_share if more.get("judge_pictures") else None
    got = _got(page.search(tables, text, sig, limit=5, judge_pictures=judge))
    want = _model(world, text, sig, 5, **more)
    assert {f: (*v[:2], pytest.approx(v[2], abs=2e-4), *v[3:]) for f, v in want.items()} == got
    assert want


def test_filters_alone_and_an_index(spark, tables, world, tmp_path):
    listed = _got(page.search(tables, "kind:video", limit=50))
    assert set(listed) == {s[0] for s in world["sources"] if s[3] == "video" and s[1] != "missing"}
    columns = {"text": 1.0, "heading": 0.4}
    postings.append(tables.chunks, f"{tmp_path}/index", "chunk_id", columns)
    from dataclasses import replace
    indexed = replace(tables, index=postings.Index(spark, f"{tmp_path}/index", columns))
    assert set(_got(page.search(indexed, "w1 w2 w7", limit=5))) and page.search(tables, "zzzz kind:audio").count() == 0
