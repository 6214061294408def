"""Connected components beside union-find."""

import random

import pytest

from sifthouse.operators.graph import anchored_components, connected_components


def _plain(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(parent)}


def _run(spark, edges):
    return {tuple(r) for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}


def test_random_graph_with_loops_and_repeats(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(7, 7), (500, 500), (1, 2), (2, 1)]
    assert _run(spark, edges) == _plain(edges)


def test_long_path_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)]
    assert _run(spark, edges) == _plain(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _joined_in_order(edges, anchors):
    """One by one, the best edge first; groups of different anchors are never joined, those of one anchor at last."""
    parent, anchor = {x: x for e in edges for x in e[:2]} | {x: x for x in anchors}, dict(anchors)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        if a != b and not (anchor.get(a) and anchor.get(b) and anchor[a] != anchor[b]):
            parent[b] = a
            anchor[a] = anchor.get(a) or anchor.get(b)

    for a, b, _ in sorted(edges, key=lambda e: (-e[2], min(e[:2]), max(e[:2]))):
        join(a, b)
    for who in set(anchors.values()):
        first, *others = [x for x in anchors if anchors[x] == who]
        for x in others:
            join(first, x)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return {(x, min(g)) for g in groups.values() for x in g}


def _anchored(spark, edges, anchors):
    got = anchored_components(spark.createDataFrame(edges, "src long, dst long, score double"), spark.createDataFrame(list(anchors.items()), "node long, anchor string"))
    return {tuple(r) for r in got.collect()}


@pytest.mark.parametrize("seed, nodes, edges_, anchored, people", [(2, 200, 260, 40, 3), (3, 300, 320, 5, 5)])
def test_groups_of_one_anchor(spark, seed, nodes, edges_, anchored, people):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes), rng.choice([0.5, 0.6, rng.random()])) for _ in range(edges_)]
    anchors = {x: f"p{rng.randrange(people)}" for x in rng.sample(range(nodes + 5), anchored)}
    assert _anchored(spark, edges, anchors) == _joined_in_order(edges, anchors)


def test_a_long_chain_between_two_anchors(spark):
    """Falling scores make one pick follow another along the whole chain: pointers double instead of walking it."""
    n = 400
    edges = [(i, i + 1, 1 - i / n) for i in range(n)]
    assert _anchored(spark, edges, {0: "a", n: "b"}) == {(i, 0) for i in range(n)} | {(n, n)}


def test_no_edges_and_no_anchors(spark):
    assert _anchored(spark, [], {}) == set()
    assert _anchored(spark, [], {4: "a", 9: "a", 5: "b"}) == {(4, 4), (9, 4), (5, 5)}
    assert _anchored(spark, [(1, 2, 0.5), (3, 3, 0.9)], {}) == {(1, 1), (2, 1), (3, 3)}
