import itertools
import random
from collections import defaultdict

import pytest

from oremill.operators import graph
from oremill.sources import sinks


def frame(spark, edges):
    return spark.createDataFrame([tuple(sorted(e)) for e in edges], "src string, dst string")


BARBELL = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("x", "y")]


def shortest(edges):
    """All shortest paths between all pairs, by search."""
    around = defaultdict(set)
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    total = defaultdict(float)
    for s, t in itertools.combinations(sorted(around), 2):
        paths, done = [[s]], []
        seen = {s}
        while paths and not done:
            longer = [[*p, w] for p in paths for w in around[p[-1]] if w not in seen]
            seen |= {p[-1] for p in longer}
            done = [p for p in longer if p[-1] == t]
            paths = longer
        for p in done:
            for e in zip(p, p[1:], strict=False):
                total[tuple(sorted(e))] += 1 / len(done)
    return total


@pytest.mark.parametrize("local", [50_000, 0])
def test_betweenness_by_both_ways(spark, local):
    draw = random.Random(2)
    edges = {tuple(sorted(draw.sample("abcdefghij", 2))) for _ in range(16)} | {("p", "q")}
    got = {(r.src, r.dst): r.value for r in graph.edge_betweenness(frame(spark, edges), local).collect()}
    want = shortest(edges)
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_removal_takes_all_ties(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    left = graph.remove_top_edges(edges, graph.edge_betweenness(edges))
    assert [tuple(r) for r in left.collect()] == [("x", "y")]


def test_components_and_modularity(spark):
    edges = frame(spark, BARBELL)
    vertices = spark.createDataFrame([(v,) for v in "abcdefxyz"], "id string")
    got = {r.id: r.community for r in graph.connected_components(vertices, edges).collect()}
    assert got == {**dict.fromkeys("abcdef", "a"), "x": "x", "y": "x", "z": "z"}
    chain = frame(spark, [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)])
    ids = spark.createDataFrame([(f"{i:03d}",) for i in range(61)], "id string")
    assert {r.community for r in graph.connected_components(ids, chain).collect()} == {"000"}
    parts = spark.createDataFrame([(v, "1" if v in "abc" else "2" if v in "def" else "3") for v in "abcdefxy"], "id string, community string")
    q = graph.modularity(parts, edges).first().value
    inner, k = 7 / 8, (7**2 + 7**2 + 2**2) / (4 * 64)
    assert abs(q - 0.5 * (inner - 0.5 * k)) < 1e-12
    assert abs(graph.modularity(parts, edges, 1, 1).first().value - (inner - k)) < 1e-12


def reference_run(edges):
    """Plain loop over the whole graph: remove the highest edges, score when the number of parts grew."""
    edges = [tuple(sorted(e)) for e in edges]
    degree = defaultdict(int)
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1

    def parts(left):
        label = {v: v for v in degree}
        for _ in degree:
            for a, b in left:
                label[a] = label[b] = min(label[a], label[b])
        return label

    left, label, scored, i = set(edges), parts(edges), [], 0
    count = len(set(label.values()))
    while left:
        i += 1
        values = shortest(left)
        top = max(values.values())
        left -= {e for e, x in values.items() if x >= top * (1 - 1e-9)}
        label = parts(left)
        now = len(set(label.values()))
        if now == len(degree):
            break
        if now > count:
            k = defaultdict(int)
            for v, c in label.items():
                k[c] += degree[v]
            e = len(edges)
            scored.append((i, 0.5 * (sum(label[a] == label[b] for a, b in edges) / e - 0.5 * sum(x * x for x in k.values()) / (4 * e * e)), now, dict(label)))
        count = now
    return scored


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_girvan_newman_matches_a_plain_loop(spark, seed):
    draw = random.Random(seed)
    edges = {tuple(sorted(draw.sample("abcdefgh", 2))) for _ in range(11)} | {tuple(sorted(draw.sample("pqrst", 2))) for _ in range(6)} | {("x", "y")}
    want = reference_run(edges)
    df = frame(spark, edges)
    steps = graph.gn_dendrogram(df).orderBy("iteration").collect()
    assert [(r.iteration, r.communities) for r in steps] == [(i, n) for i, _, n, _ in want]
    assert all(abs(r.value - s) < 2e-6 for r, (_, s, _, _) in zip(steps, want, strict=True))
    best = max(want, key=lambda x: (round(x[1], 12), -x[0]))
    held: dict = defaultdict(dict)
    for r in graph.dendrogram_members(df).collect():
        held[r.iteration][r.id] = r.community
    assert held == {i: label for i, _, _, label in want}
    rows = graph.girvan_newman(df).collect()
    assert {r.iteration for r in rows} == {best[0]} and {r.id: r.community for r in rows} == best[3]


def test_one_edge_has_no_score(spark):
    rows = graph.girvan_newman(frame(spark, [("a", "b")])).collect()
    assert sorted((r.iteration, r.id, r.community, r.value) for r in rows) == [(0, "a", "a", None), (0, "b", "a", None)]
    assert graph.girvan_newman(frame(spark, [("a", "b")]).limit(0)).collect() == []
    assert graph.dendrogram_members(frame(spark, [("a", "b")])).collect() == []


def test_label_propagation_is_synchronous(spark):
    """Both ends of a lone edge take each other's label in every round; after an odd number they are exchanged."""
    got = {r.id: r.label for r in graph.label_propagation(frame(spark, [("a", "b")]), 5).collect()}
    assert got == {"a": "b", "b": "a"}
    got = {r.id: r.label for r in graph.label_propagation(frame(spark, [("a", "b"), ("b", "c"), ("a", "c")]), 1).collect()}
    assert got == {"a": "b", "b": "a", "c": "a"}


def test_co_review_graph(spark):
    rows = [(u, b) for u, bs in {"u1": "abc", "u2": "abc", "u3": "ab", "u4": "xyz"}.items() for b in bs]
    edges, vertices = graph.co_review_graph(spark.createDataFrame([*rows, *rows, (None, "a")], "user_id string, business_id string"), 3)
    assert [tuple(r) for r in edges.collect()] == [("u1", "u2")]
    assert sorted(r.id for r in vertices.collect()) == ["u1", "u2"]
    assert graph.degrees(edges).count() == 2


def test_listing(spark):
    df = spark.createDataFrame([("b", "b"), ("c", "c"), ("d", "c"), ("a", "a")], "id string, community string")
    for name in ("community", "label"):
        lines = sinks.community_lines(graph.community_listing(df.withColumnRenamed("community", name)))
        assert [r.line for r in lines.collect()] == ["'a'", "'b'", "'c', 'd'"]
