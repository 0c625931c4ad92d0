"""Facts about small graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.model import PropertyGraph, first_wins, last_wins
from arbora.operators import aggregates as A
from arbora.operators import centrality as C
from arbora.operators import clones as W
from arbora.operators import community as G
from arbora.operators import components as K
from arbora.operators import filters as P
from arbora.operators import joins as J
from arbora.operators import motifs as M
from arbora.operators import traverse as T
from arbora.plans.phases import Phase, phase_order, run_phases
from arbora.plans.rewrites import interval_join, set_similarity_join
from arbora.storage import Workspace


def graph(spark, pairs, more=(), kind="CALLS", confidence=1.0, label="Function"):
    ids = sorted({x for p in pairs for x in p} | set(more))
    v = spark.createDataFrame([(i, label, i, f"src/{i}.ts") for i in ids], "id string, label string, name string, file_path string")
    e = spark.createDataFrame([(a, b, kind, confidence) for a, b in pairs], "src string, dst string, type string, confidence double")
    return PropertyGraph(v, e)


def both(*pairs):
    return [*pairs, *((b, a) for a, b in pairs)]


def as_dict(df, *cols):
    return {r[0]: (r[1] if len(r) == 2 else tuple(r[1:])) for r in df.select(*cols).collect()}


CHAIN = [("A", "B"), ("B", "C"), ("C", "D")]
TRIANGLE = [("A", "B"), ("B", "C"), ("C", "A")]


def test_pagerank(spark):
    r = as_dict(C.pagerank(graph(spark, CHAIN[:2])), "id", "rank")
    assert max(r, key=r.get) == "C" and abs(sum(r.values()) - 1) < 1e-4
    alone = as_dict(C.pagerank(graph(spark, [], "XYZ")), "id", "rank")
    assert all(abs(x - 1 / 3) < 1e-9 for x in alone.values())
    star = as_dict(C.pagerank(graph(spark, both(("Hub", "A"), ("Hub", "B"), ("Hub", "C")))), "id", "rank")
    assert max(star, key=star.get) == "Hub"
    scaled = as_dict(C.pagerank(graph(spark, both(("A", "B"))), iterations=20, tolerance=None, dangling=False, total="n"), "id", "rank")
    assert abs(sum(scaled.values()) - 2) < 1e-6


def test_empty_graph(spark):
    g = graph(spark, [])
    assert C.pagerank(g).count() == K.connected_components(g).count() == K.strong_components(g).count() == K.cut_structure(g).count() == 0
    assert A.spectral(g).first().n_vertices == 0 and K.flow_hierarchy(g).first()[0] == 0
    assert M.architecture_patterns(M.census(g)).first().name == "Insufficient data"


def test_betweenness(spark):
    b = as_dict(C.betweenness(graph(spark, CHAIN)), "id", "betweenness")
    assert b["B"] > b["A"] == 0 and b["B"] > b["D"]
    assert set(as_dict(C.betweenness(graph(spark, both(*TRIANGLE))), "id", "betweenness").values()) == {0}


def test_shortest_path(spark):
    g = graph(spark, CHAIN, ["X"])
    assert T.shortest_path(g, "D", "A") == ["D", "C", "B", "A"]
    assert T.shortest_path(g, "A", "A") == ["A"]
    assert T.shortest_path(g, "A", "X") is None and T.shortest_path(g, "A", "nowhere") is None


def test_spectral_and_topology(spark):
    s = A.spectral(graph(spark, CHAIN)).first()
    assert (s.n_vertices, s.n_edges, s.density) == (4, 3, 0.25)
    kind = lambda pairs: A.topology(A.spectral(graph(spark, pairs))).first()
    assert kind([("Root", "A"), ("Root", "B"), ("A", "A1"), ("A", "A2"), ("B", "B1")]).topology == "tree-like"
    assert kind([("Hub", x) for x in "ABCDE"]).topology == "star-like"
    assert K.flow_hierarchy(graph(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")])).first()[0] == 1
    assert K.flow_hierarchy(graph(spark, TRIANGLE)).first()[0] < 1


def test_cuts(spark):
    assert K.cut_structure(graph(spark, TRIANGLE)).count() == 0
    two = [*TRIANGLE, ("C", "D"), ("D", "E"), ("E", "C")]
    assert [r.id for r in K.cut_vertices(graph(spark, two)).collect()] == ["C"]
    dumb = [*TRIANGLE, ("C", "X"), ("X", "Y"), ("Y", "Z"), ("Z", "X")]
    assert [(r.a, r.b) for r in K.bridges(graph(spark, dumb)).collect()] == [("C", "X")]
    assert [(r.a, r.b) for r in K.bridges(graph(spark, [("A", "B")])).collect()] == [("A", "B")]


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(4)
    ids = [f"n{i:02}" for i in range(18)]
    pairs = sorted({(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(30)) if a != b})
    g = graph(spark, pairs, ids)

    def parts(edges, nodes):
        seen, n = set(), 0
        for s in nodes:
            if s not in seen:
                n, todo = n + 1, [s]
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += [b for a, b in edges if a == x] + [a for a, b in edges if b == x]
        return n

    whole = parts(pairs, ids)
    want = {(min(p), max(p)) for p in pairs if parts([q for q in pairs if {*q} != {*p}], ids) > whole}
    assert {(r.a, r.b) for r in K.bridges(g).collect()} == want
    cut = {x for x in ids if parts([q for q in pairs if x not in q], [i for i in ids if i != x]) > whole}
    assert {r.id for r in K.cut_vertices(g).collect()} == cut
    reach = {(a, b) for a, b in pairs}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    scc = {a: min([a, *(b for b in ids if (a, b) in reach and (b, a) in reach)]) for a in ids if (a, a) in reach}
    assert as_dict(K.strong_components(g), "id", "component") == scc
    assert as_dict(K.connected_components(g), "id", "component").keys() == set(ids)


@pytest.mark.parametrize("kernel_edges", [200_000, 30, 1])
def test_strong_components_by_walk_and_by_joins(spark, kernel_edges):
    rng = random.Random(8)
    pairs = {(f"{c}{rng.randrange(14):02}", f"{c}{rng.randrange(14):02}") for c in "abcdef" for _ in range(rng.choice([8, 16, 40]))}
    reach = {v: {v} for p in pairs for v in p}
    for _ in reach:
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {}
    for v in reach:
        mates = {w for w in reach[v] if v in reach[w]}
        if len(mates) > 1:
            want[v] = min(mates)
    assert want and as_dict(K.strong_components(graph(spark, sorted(pairs)), kernel_edges=kernel_edges), "id", "component") == want


def test_louvain_raises_rather_than_change_its_method(spark):
    g = graph(spark, both(*CHAIN))
    with pytest.raises(ValueError, match="max_component_edges"):
        G.louvain(g, max_component_edges=2)
    assert G.louvain(g, max_component_edges=2, oversized="propagate").count() == 4


def test_hierarchy_stops_without_gain(spark):
    cliques = [p for c in ("abcd", "efgh", "ijkl", "mnop") for p in both(*[(x, y) for x in c for y in c if x < y])]
    ring = both(("a", "e"), ("f", "i"), ("j", "m"), ("n", "b"))
    levels = G.hierarchy(graph(spark, cliques + ring))
    assert levels.where("level = 0").select("community").distinct().count() == 4
    assert levels.select("level").distinct().count() == 2
    pairs = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "a string, b string, w double")
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "id string, community string")
    assert G.weighted_modularity(pairs, members) == pytest.approx(0.5)
    assert G.weighted_modularity(pairs.limit(0), members) == 0


def test_number_rows(spark):
    from arbora.plans.rewrites import number_rows

    rows = spark.range(5000).selectExpr("concat('k', id * 7919 % 5000) as k", "id % 3 as g")
    got = {r.k: r.n for r in number_rows(rows, ["g", "k"], "n").collect()}
    want = sorted(((i % 3, f"k{i * 7919 % 5000}") for i in range(5000)))
    assert got == {k: n for n, (_, k) in enumerate(want)}
    assert number_rows(rows.limit(0), ["k"], "n").count() == 0


def test_impact_caps(spark):
    g = graph(spark, [("B", "A"), ("C", "A"), ("D", "B"), ("E", "D")])
    seed = spark.createDataFrame([("A",)], "id string")
    assert [r.id for r in T.impact(g, seed, cap=3).orderBy("depth", "id").collect()] == ["B", "C", "D"]
    assert [r.id for r in T.impact_probability(g, "A", cap=2).collect()] == ["B", "C"]


def test_typed_patterns(spark):
    counts = spark.createDataFrame([("Class:CALLS:Method", 3), ("Module:IMPORTS:Module", 4), ("Class:USES:Class", 2), ("Interface:HAS_METHOD:Method", 7)], "key string, n long")
    got = {r["name"]: (r.confidence, r.total) for r in M.typed_patterns(counts).collect()}
    assert got == {"Controller-Fat": (pytest.approx(1 / 3), 6), "Circular-Import": (pytest.approx(2 / 3), 4)}
    assert M.typed_patterns(counts.where("n = 2")).count() == 0


def test_louvain(spark):
    two = graph(spark, [("A", "B"), ("B", "C"), ("X", "Y"), ("Y", "Z")])
    c = as_dict(G.louvain(two), "id", "community")
    assert c["A"] == c["B"] == c["C"] != c["X"] == c["Y"] == c["Z"]
    assert len(set(as_dict(G.louvain(graph(spark, [], "PQ")), "id", "community").values())) == 2
    blocks = [(f"a{i}", f"a{j}") for i in range(5) for j in range(i)] + [(f"b{i}", f"b{j}") for i in range(5) for j in range(i)] + [("a0", "b0")]
    g = graph(spark, blocks)
    members = G.louvain(g)
    assert len(set(as_dict(members, "id", "community").values())) == 2
    alone = g.vertices.select("id", F.col("id").alias("community"))
    assert A.modularity_weighted(g, members).first()[0] > A.modularity_weighted(g, alone).first()[0]
    assert G.hierarchy(g).where("level = 0").count() == 10


def test_clones(spark):
    g = graph(spark, [("FuncA", "H1"), ("FuncA", "H2"), ("FuncB", "H3"), ("FuncB", "H4")])
    pairs = {(r.a, r.b): r.similarity for r in W.clone_pairs(g).collect()}
    assert pairs == {("FuncA", "FuncB"): 1.0}
    assert W.clone_classes(g).count() == 1


def test_smells(spark):
    cycle = as_dict(K.smells(graph(spark, both(("A", "B")))), "kind", "n")
    assert cycle["cycle"] == 1
    hub = graph(spark, [(f"i{k}", "Hub") for k in range(5)] + [("Hub", f"o{k}") for k in range(5)])
    assert as_dict(A.hubs(hub, 2, 2), "id", "kind")["Hub"] == "god-module"
    assert K.mesh(graph(spark, both(*TRIANGLE))).first().density == 1


def test_identity_rules(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, seq int, v string")
    assert as_dict(last_wins(rows, "id", "seq"), "id", "v") == {"a": "y", "b": "z"} and as_dict(first_wins(rows, "id", "seq"), "id", "v") == {"a": "x", "b": "z"}
    g = graph(spark, CHAIN)
    assert g.remove_vertices(spark.createDataFrame([("B",)], "id string")).edges.count() == 1
    assert g.remove_files(spark.createDataFrame([("src/A.ts",)], "file_path string")).vertices.count() == 3
    again = spark.createDataFrame([("A", "B", "CALLS", 0.1), ("A", "C", "CALLS", 0.2)], "src string, dst string, type string, confidence double")
    assert sorted(r.confidence for r in g.add_edges(again).edges.collect()) == [0.2, 1.0, 1.0, 1.0]
    new = spark.createDataFrame([("A", "Class", None, None)], "id string, label string, name string, file_path string")
    assert g.upsert_vertices(new).vertices.where("id = 'A'").first().name is None


def test_filter_language(spark):
    rows = spark.createDataFrame([(1, "5", None), (2, "x", "v"), (3, None, "v")], "id int, n string, s string")
    got = lambda spec: [r.id for r in rows.where(P.compile_filter(spec)).orderBy("id").collect()]
    assert got({}) == [1, 2, 3] and got({"s": None}) == [1] and got({"n": {"gt": 4}}) == [1] and got({"s": "v", "n": "x"}) == [2] and got({"n": {"lte": 5, "gte": 5}}) == [1]
    with pytest.raises(ValueError):
        P.grep(rows, "id", "s", "x" * 201)


def test_impact(spark):
    g = graph(spark, CHAIN)
    seeds = spark.createDataFrame([("D",)], "id string")
    assert as_dict(T.impact(g, seeds), "id", "depth") == {"C": 1, "B": 2, "A": 3}
    p = as_dict(T.impact_probability(g, "D"), "id", "score")
    assert p == {"C": 0.9, "B": 0.81, "A": 0.729}
    diamond = graph(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], confidence=0.5)
    assert as_dict(T.impact_probability(diamond, "D", max_depth=2), "id", "score")["A"] == pytest.approx(1 - (1 - 0.45 * 0.45) ** 2, abs=1e-3)


def test_health_of_an_empty_graph(spark):
    sizes = spark.createDataFrame([], "community string, n bigint")
    h = M.architecture_health(M.census(graph(spark, [])), sizes).first()
    assert (h.score, h.modularity, h.cohesion) == (100, 1, 0)


def test_rewrites(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 50), (3, "g", 5)], "p int, f string, at int")
    spans = spark.createDataFrame([("a", "f", 0, 100), ("b", "f", 4, 6), ("c", "f", 200, 300)], "i string, f string, s int, e int")
    assert as_dict(interval_join(points, spans, ["f"], "at", "s", "e", bin_size=8), "p", "i") == {1: "b", 2: "a"}
    rng = random.Random(9)
    sets = {k: {rng.randrange(12) for _ in range(rng.randrange(1, 9))} for k in range(40)}
    rows = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "k int, i int")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r.a, r.b) for r in set_similarity_join(rows, "k", "i", 0.5).collect()} == want


def test_phases():
    made = []
    ps = [Phase("c", lambda s: made.append("c"), ["b"]), Phase("a", lambda s: made.append("a")), Phase("b", lambda s: made.append("b"), ["a", "missing"])]
    assert [p.name for p in phase_order(ps)] == ["a", "b", "c"]
    run_phases(ps)
    assert made == ["a", "b", "c"]
    with pytest.raises(ValueError):
        phase_order([Phase("a", print, ["b"]), Phase("b", print, ["a"])])
    with pytest.raises(ValueError):
        phase_order([Phase("a", print), Phase("a", print)])
    known = {}
    once = [Phase("x", lambda s: made.append("x"), fingerprint=lambda s: "1")]
    run_phases(once, known=known)
    run_phases(once, known=known)
    assert made.count("x") == 1


def pair_cosines(x, y):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return unit(x) @ unit(y).T


def test_semantic_edges_are_all_found(spark):
    x = np.random.default_rng(3).normal(size=(5300, 12))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>").repartition(8)
    got = {(r.a, r.b): r.similarity for r in J.semantic_edges(v, 0.8).collect()}
    sim = pair_cosines(x, x)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(sim >= 0.8, 1)))}
    assert want and got.keys() == want
    assert all(abs(s - sim[p]) < 1e-12 for p, s in got.items())


@pytest.mark.parametrize("least", [0.5, 0.0])
def test_semantic_edges_of_odd_vectors(spark, least):
    from arbora.functions.scalar import cosine

    odd = [[1.0, 0.0], [1.0, 0.1], [1.0, 0.0, 5.0], [], None, [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [1e200, 1e200], [float("inf"), 1.0], [1e-200, 0.0], [-1.0, 0.0]]
    v = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id long, vector array<double>")
    a, b = v.toDF("a", "va"), v.toDF("b", "vb")
    plain = a.crossJoin(b).where("a < b").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("s")).where(F.col("s") >= least)
    assert {(r.a, r.b, str(r.similarity)) for r in J.semantic_edges(v, least).collect()} == {(r.a, r.b, str(r.s)) for r in plain.collect()}


def test_fuzzy_contracts_are_all_found(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 12)), rng.normal(size=(20_100, 12))
    kinds = "id long, repo int, vector array<double>"
    p = spark.createDataFrame([(i, i % 3, r.tolist()) for i, r in enumerate(x)], kinds)
    c = spark.createDataFrame([(i, i % 4, r.tolist()) for i, r in enumerate(y)], kinds).repartition(8)
    linked = spark.createDataFrame([(0, 1)], "provider_id long, consumer_id long")
    got = {(r.provider_id, r.consumer_id) for r in J.match_fuzzy(p, c, linked, 0.6).collect()}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(pair_cosines(x, y) >= 0.6)) if i % 3 != j % 4 and i != 0 and j != 1}
    assert want and got == want


def test_clones_of_a_large_group(spark):
    g = graph(spark, [(f"f{i:03}", f"h{i:03}{k}") for i in range(600) for k in range(2)] + [("x1", "y1"), ("x2", "y2")])
    whole = 600 * 599 // 2
    assert W.clone_pairs(g).count() == whole + 1
    assert W.similarity_buckets(W.clone_set_pairs(g)).first() == (whole + 1, 0, 0)
    got = {tuple(r) for r in W.clone_clusters(W.clone_set_pairs(g, 0.8), Workspace(spark, "clusters")).collect()}
    assert got == {("f000", 600, "f000", 1.0), ("x1", 2, "x1", 1.0)}


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_clone_sets_equal_plain_pairs(spark, monkeypatch, least):
    sets = {f"v{i:02}": ("A" if i % 3 else "B", sorted(random.Random(i % 17).sample("klmnopq", 1 + i % 5))) for i in range(40)}
    members = spark.createDataFrame([(i, *x) for i, x in sets.items()], "id string, label string, s array<string>")
    monkeypatch.setattr(W, "_members", lambda g: members)
    g = graph(spark, [("a", "b")])
    alike = lambda x, y: int(len(x & y) / len(x | y) * 10000 + 0.5) / 10000
    plain = {(a, b): alike(set(sets[a][1]), set(sets[b][1])) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0]}
    plain = {p: s for p, s in plain.items() if s >= least}
    assert {(r.a, r.b): r.similarity for r in W.clone_pairs(g, least).collect()} == plain
    near = {a: {a} for p in plain for a in p}
    for a, b in plain:
        group = near[a] | near[b]
        for x in group:
            near[x] = group
    want = set()
    for group in {min(x): x for x in near.values()}.values():
        inside = {p: round(s * 10000) for p, s in plain.items() if p[0] in group}
        best = min(group, key=lambda x: (-sum(s for p, s in inside.items() if x in p), x))
        want.add((min(group), len(group), best, int(sum(inside.values()) / len(inside) + 0.5) / 10000))
    assert {tuple(r) for r in W.clone_clusters(W.clone_set_pairs(g, least), Workspace(spark, "clusters")).collect()} == want
