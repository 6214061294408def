"""Graph operators: connected components by alternating stars, and components that hold one anchor at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import discard, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest of its neighbours and itself to its larger neighbours."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("low"))
    return (
        both.filter("dst > src").join(low, "src")
        .select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node connects itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(low.select("src", F.col("low").alias("dst"))).filter("src <> dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(src, dst)``; a component is named by its smallest node.

    Large-star and small-star rounds need a number of rounds that grows with the logarithm of
    the graph; minima are combined before shuffling, so a node with very many edges costs no
    single task. Each round is written to the shared folder. Self loops only name their node.
    """
    loops = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    current = settle(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("n")
    before = current.agg(*mark).first()
    for _ in range(max_rounds):
        if not before["n"]:
            break
        last, current = current, settle(_small_star(_large_star(current)))
        discard(last)
        after = current.agg(*mark).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return loops.join(current.select(F.col("src").alias("node"), F.col("dst").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _followed(parents: DataFrame, max_rounds: int) -> DataFrame:
    """``x, p, fixed`` with every pointer led to its end; each round doubles the length that pointers span."""
    current = settle(parents)
    for _ in range(max_rounds):
        up = current.select(F.col("x").alias("p"), F.col("p").alias("q"), F.col("fixed").alias("qf"))
        joined = current.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"), F.coalesce("qf", "fixed").alias("fixed"), (F.col("q") != F.col("p")).alias("moved"))
        after = settle(joined)
        moved = not after.filter("moved").isEmpty()
        discard(current)
        current = after
        if not moved:
            return current.select("x", "p", "fixed")
    raise RuntimeError(f"pointers did not settle in {max_rounds} rounds")


def anchored_components(edges: DataFrame, anchors: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` as if ``edges(src, dst, score)`` joined groups one by one, the highest score first, but never two groups of different anchors.

    Equal scores go by the smaller node, then the other. ``anchors(node, anchor)`` gives nodes
    an anchor; nodes of one anchor are in one group, also without edges. A component is named by
    its smallest node. Self loops join nothing, and of edges that repeat the best counts.

    Taking edges in order and refusing those between two anchors gives the groups of the
    minimum spanning forest of the graph in which all anchors hang on one further root. So they
    can be found in rounds: every group without an anchor picks its best edge to any other
    group, and the picks are followed to their ends, which are an anchor's group or two groups
    that picked each other. Groups without anchor that have an edge at least halve in a round;
    edges within a group, and between anchors, go. Each round is written to the shared folder.
    """
    # a node with several anchors has the least
    held = anchors.filter("node is not null and anchor is not null").groupBy("node").agg(F.min("anchor").alias("anchor"))
    heads = settle(held.join(held.groupBy("anchor").agg(F.min("node").alias("head")), "anchor").select("node", "head"))
    ends = [heads.select(F.col("node").alias(c), F.col("head").alias(f"{c}_head")) for c in ("src", "dst")]
    named = edges.select("src", "dst", "score").join(ends[0], "src", "left").join(ends[1], "dst", "left")
    order = F.struct((-F.col("score")).alias("s"), F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    first = named.select(
        F.coalesce("src_head", "src").alias("a"), F.coalesce("dst_head", "dst").alias("b"), F.col("src_head").isNotNull().alias("fa"), F.col("dst_head").isNotNull().alias("fb"), order.alias("o"))

    def rest(e: DataFrame) -> DataFrame:
        """Edges that can still join, the best between each two groups."""
        turned = F.col("a") > F.col("b")
        one = e.filter("a <> b and not (fa and fb)").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("fb")).otherwise(F.col("fa")).alias("fa"), F.when(turned, F.col("fa")).otherwise(F.col("fb")).alias("fb"), "o")
        return one.groupBy("a", "b", "fa", "fb").agg(F.min("o").alias("o"))

    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct().join(heads, "node", "full")
    labels = settle(nodes.select("node", F.coalesce("head", "node").alias("group")))
    open_ = settle(rest(first))
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        both = open_.filter("not fa").select(F.col("a").alias("x"), F.col("b").alias("p"), F.col("fb").alias("fixed"), "o").union(
            open_.filter("not fb").select(F.col("b").alias("x"), F.col("a").alias("p"), F.col("fa").alias("fixed"), "o"))
        picks = settle(both.groupBy("x").agg(F.min_by(F.struct("p", "fixed"), "o").alias("best")).select("x", "best.p", "best.fixed"))
        # of two groups that picked each other the smaller is the end
        back = picks.select(F.col("x").alias("p"), F.col("p").alias("x"), F.lit(True).alias("mutual"))
        ended = picks.join(back, ["x", "p"], "left")
        parents = ended.select("x", F.when(F.col("mutual") & (F.col("x") < F.col("p")), F.col("x")).otherwise(F.col("p")).alias("p"), "fixed")
        led = _followed(parents, max_rounds)
        to = [led.select(F.col("x").alias(c), F.col("p").alias(f"{c}_to"), F.col("fixed").alias(f"f{c}_to")) for c in ("a", "b")]
        moved = open_.join(to[0], "a", "left").join(to[1], "b", "left").select(
            F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"), (F.col("fa") | F.coalesce("fa_to", F.lit(False))).alias("fa"), (F.col("fb") | F.coalesce("fb_to", F.lit(False))).alias("fb"), "o")
        after = settle(rest(moved))
        relabelled = settle(labels.join(led.select(F.col("x").alias("group"), "p"), "group", "left").select("node", F.coalesce("p", "group").alias("group")))
        discard(open_, labels, picks)
        open_, labels = after, relabelled
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    names = labels.groupBy("group").agg(F.min("node").alias("component"))
    return labels.join(names, "group").select("node", "component")
