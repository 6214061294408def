"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib

import numpy as np


def blank_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def lower(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def near_components(rows, k=3, percent=90):
    sets = {}
    for doc_id, text in rows:
        w = [lower(x) for x in blank_words(text)]
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    by_size = sorted(ids, key=lambda d: len(sets[d]))
    for i, a in enumerate(by_size):
        for b in by_size[i + 1 :]:
            x, y = sets[a], sets[b]
            if len(x) * 100 < percent * len(y):
                break
            inter = len(x & y)
            if 100 * inter >= percent * (len(x) + len(y) - inter):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {(d, len(sets[d]), find(d)) for d in sets}


def removed_windows(rows, window=50):
    first = {}
    for doc_id, text in sorted(rows):
        w = blank_words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(b" ".join(w[i : i + window]), doc_id)
    out = set()
    for doc_id, text in rows:
        w = blank_words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.add((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items, window=13):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower((t or "").encode()))
    grams = {}
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = set()
    for doc_id, text in rows:
        w = cut(text)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                owners = grams.get(tuple(w[i : i + n]))
                if owners:
                    found |= owners
                    hit[i : i + n] = [True] * n
        n_hit = sum(hit)
        listed = ",".join(sorted(map(str, found)))
        out.add((doc_id, len(w), n_hit, len(found), hashlib.sha256(listed.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= len(w)))
    return out


def token_files(rows, tokenizer, end=2):
    out, start = set(), 0
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.add((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def round_trips(rows, tokenizer):
    out = set()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.add((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def periodic_runs(words):
    """``(start, length, period)`` of all runs of at least six words and four smallest periods."""
    out = []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    code = np.array([number[w] for w in words], np.int64)
    for q in range(1, len(words) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (code[q:] == code[:-q]).astype(int), [0]])))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = end - start + q
            if length >= max(6, 4 * q):
                seg = code[start : start + length]
                if not any((seg[p:] == seg[:-p]).all() for p in range(1, q)):
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeating(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def run_digests(rows):
    out = set()
    for doc_id, text in rows:
        words = repeating(doc_id, blank_words(text))
        runs = periodic_runs(words)
        gone = set()
        for s, m, q in runs:
            gone.update(range(s + q, s + m))
        best = None
        for s, m, q in runs:
            if best is None or m * best[2] > best[1] * q:
                best = (s, m, q)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.add((doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return out


def lloyd(rows, k=8, rounds=10, dim=64, scale=1024, salt="3"):
    """Plain integer Lloyd over ``(vec_id, vector)``."""
    fine = [(i, [int(math.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([v for _, v in fine], np.int64).reshape(-1, dim)
    mark = sorted(range(len(fine)), key=lambda j: (hashlib.sha256(f"{salt}:{fine[j][0]}".encode()).hexdigest(), fine[j][1]))
    c = x[mark[:k]].copy()
    apart = lambda: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = apart().argmin(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = [int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)]
    d = apart()
    own, least = d.argmin(axis=1), d.min(axis=1)
    marks = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    return sorted((fine[i][0], int(own[i]), int(least[i]), int(least[own == own[i]].sum()), int(least.sum()), marks[own[i]]) for i in range(len(fine)))
