"""Closures, trails and shortest paths against plain searches; the edit join against all pairs."""

import collections
import random

import pytest

from quillgraph.operators import paths as P
from quillgraph.operators.editjoin import deletions, near_strings


def _frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def _nodes(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def _hops(edges, start):
    near, todo = collections.defaultdict(list), collections.deque([start])
    for a, b in edges:
        near[a].append(b)
    out = {start: 0}
    while todo:
        a = todo.popleft()
        for b in near[a]:
            if b not in out:
                out[b] = out[a] + 1
                todo.append(b)
    return out


def test_closure_with_cycles_and_bounds(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)] + [(3, 3), (3, 3)]
    want = {(s, n, h) for s in range(5) for n, h in _hops(edges, s).items()}
    got = P.closure(_frame(spark, [*edges, (None, 1), (1, None)]), _nodes(spark, [0, 1, 2, 3, 4, 4, None])).collect()
    assert {(r.start, r.node, r.hops) for r in got} == want and len(got) == len(want)
    hops = {(s, n): h for s, n, h in want}
    assert all(r.before is None if r.hops == 0 else (r.before, r.node) in set(edges) and hops[r.start, r.before] == r.hops - 1 for r in got)
    some = P.closure(_frame(spark, edges), _nodes(spark, range(5)), most=3, least=2).collect()
    assert {(r.start, r.node, r.hops) for r in some} == {x for x in want if 2 <= x[2] <= 3}


def test_a_chain_of_fifty_levels(spark):
    chain = [(i, i + 1) for i in range(50)]
    got = {r.node: r.hops for r in P.closure(_frame(spark, chain), _nodes(spark, [0])).collect()}
    assert got == {i: i for i in range(51)}
    assert P.shortest(_frame(spark, [*chain, (10, 40)]), 0, 50) == [*range(11), *range(40, 51)]
    assert P.shortest(_frame(spark, chain), 5, 2) == [] and P.shortest(_frame(spark, chain), 4, 4) == [4]


@pytest.mark.parametrize("most, size", [(None, P.SET_NODES), (2, P.SET_NODES), (0, P.SET_NODES), (None, 12)])
def test_closures_of_every_node(spark, most, size):
    rng = random.Random(5)
    down = [(i, rng.randrange(i)) for i in range(1, 60) for _ in range(rng.randrange(3))]
    edges = [*down, *down[:3], (7, 7), (61, 61), (70, 71), (71, 72), (72, 70), (73, 70), (71, 5)]  # a cycle, what leads to it, loops
    got = P.closures(_frame(spark, [*edges, (None, 80), (81, None)]), most, size).collect()
    ends = {n for edge in edges for n in edge} | {80, 81}
    want = {(s, n, h) for s in ends for n, h in _hops(edges, s).items() if most is None or h <= most}
    assert {(r.start, r.node, r.hops) for r in got} == want and len(got) == len(want)


def test_closures_without_edges_and_of_cycles_alone(spark):
    assert P.closures(_frame(spark, [(None, None)])).collect() == []
    got = P.closures(spark.createDataFrame([("x", "y"), ("y", "x")], "a string, b string")).collect()
    assert sorted(map(tuple, got)) == [("x", "x", 0), ("x", "y", 1), ("y", "x", 1), ("y", "y", 0)]


def _shuffled(spark):
    """Bytes that this application has shuffled."""
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_ancestors_are_shuffled_once_for_each_edge(spark):
    from quillgraph.plans.catalog import ancestors

    links = spark.range(2, 4000).selectExpr("id as child", "explode(array(id div 2, id div 3)) as parent").filter("parent >= 1").distinct()
    began = _shuffled(spark)
    pairs = ancestors(links).count()
    assert pairs == sum(len({n // (2**i * 3**j) for i in range(12) for j in range(8)} - {0}) for n in range(1, 4000))
    assert (_shuffled(spark) - began) / pairs < 9  # 12 with all pairs in every round


def _trails(edges, start, least, most, directed):
    steps = collections.defaultdict(set)
    for a, b in edges:
        key = (a, b) if directed else (min(a, b), max(a, b))
        steps[a].add((b, key))
        if not directed:
            steps[b].add((a, key))
    out, todo = [], [((start,), frozenset())]
    while todo:
        nodes, gone = todo.pop()
        if least <= len(gone) <= (most if most is not None else 99):
            out.append(nodes)
        if most is None or len(gone) < most:
            todo += [((*nodes, b), gone | {key}) for b, key in steps[nodes[-1]] if key not in gone]
    return out


@pytest.mark.parametrize("least, most, directed", [(0, 2, False), (2, 5, False), (1, 4, True), (0, None, False)])
def test_trails_repeat_no_edge(spark, least, most, directed):
    rng = random.Random(7)
    edges = [(rng.randrange(9), rng.randrange(9)) for _ in range(9 if most is None else 14)] + [(2, 2)]
    got = P.trails(_frame(spark, edges), _nodes(spark, [0, 2]), least, most, directed).collect()
    want = [t for s in (0, 2) for t in _trails(edges, s, least, most, directed)]
    assert sorted(tuple(r.nodes) for r in got) == sorted(want)
    assert all((r.start, r.node, r.hops) == (r.nodes[0], r.nodes[-1], len(r.nodes) - 1) for r in got)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_deletions(spark):
    got = spark.createDataFrame([("abca",), ("",), ("é",)], "s string").select("s", *(deletions("s", n).alias(f"d{n}") for n in range(3))).collect()
    by = {r.s: r for r in got}
    assert set(by["abca"].d1) == {"abca", "bca", "aca", "aba", "abc"}
    assert set(by["abca"].d2) == {*by["abca"].d1, "ca", "ba", "bc", "aa", "ac", "ab"}
    assert by[""].d2 == [""] and set(by["é"].d2) == {"é", ""} and by["abca"].d0 == ["abca"]


@pytest.mark.parametrize("most", [1, 2])
def test_near_strings_are_all_near_pairs(spark, most):
    rng = random.Random(most)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))) for _ in range(120)] + ["numbered 001", "numbered 002", "numbered 102", "x" * 200, "x" * 199 + "y"]
    rows = [(w,) for w in words + words[:20]] + [(None,)]
    got = near_strings(spark.createDataFrame(rows, "name string"), "name", most).collect()
    names = sorted(set(words))
    want = {(a, b): _distance(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if abs(len(a) - len(b)) <= most and _distance(a, b) <= most}
    assert {(r.a, r.b): r.distance for r in got} == want and len(got) == len(want)
