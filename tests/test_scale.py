"""Joins and searches on crowded keys: whole results without pairing a crowd with itself."""

import random
from itertools import combinations

from arbora.functions import text as X
from arbora.model import PropertyGraph
from arbora.operators import centrality as C
from arbora.operators import joins as J
from arbora.operators import motifs as M
from arbora.operators.api import api_impact, route_consumers
from arbora.search import ranking as R


def output_rows(df):
    """The greatest number of rows that any join of the plan gave."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if "Join" in name and metric.isDefined():
            found = max(found, metric.get().value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_cover_functions_crowded(spark):
    n = 3000
    c = spark.range(n).selectExpr("case when id % 2 = 0 then 'build/src/a.ts' else 'a.ts' end as file_path", "'f' as name", "(id * 7919) % 10007 as line", "id % 3 as hits")
    f = spark.range(n).selectExpr("'fn:' || id as id", "'f' as name", "case when id % 3 = 0 then 'src/a.ts' when id % 3 = 1 then 'c/a.ts' else 'd/a.ts' end as file_path", "(id * 104729) % 10007 as start_line")
    at = [(r.start_line, r.id, r.file_path) for r in f.collect()]
    want = {}
    for r in c.collect():
        fits = [(abs(r.line - s), i) for s, i, p in at if r.file_path.endswith(p) or p.endswith(r.file_path)]
        want[r.line] = min(fits)[1]
    got = J.cover_functions(c, f)
    assert {r.line: r.id for r in got.collect()} == want
    assert output_rows(got) < 10 * n


def test_cover_functions_without_lines(spark):
    f = spark.createDataFrame([("a", "f", "x.ts", None), ("b", "f", "x.ts", 90), ("c", "g", "x.ts", None), ("d", "g", "x.ts", None), ("e", "k", "x.ts", 1)], "id string, name string, file_path string, start_line int")
    c = spark.createDataFrame([("x.ts", "f", 1, 1), ("x.ts", "f", None, 1), ("x.ts", "g", 5, 0), ("x.ts", "h", 5, 0), (None, "k", 5, 0), ("x.ts", None, 5, 0)], "file_path string, name string, line int, hits int")
    got = {(r.line, r.id, r.covered) for r in J.cover_functions(c, f).collect()}
    assert got == {(1, "b", True), (None, "a", True), (5, "c", False)}


def edges(spark, *parts):
    """A graph of edges alone, from (count, src, dst, type) in terms of id."""
    rows = [spark.range(n).selectExpr(f"{src} as src", f"{dst} as dst", f"'{kind}' as type", "1.0D as confidence") for n, src, dst, kind in parts]
    e = rows[0]
    for r in rows[1:]:
        e = e.unionByName(r)
    return PropertyGraph(e.selectExpr("src as id", "'Function' as label", "src as name", "'' as file_path").distinct(), e)


CROWD = ((400, "'h' || id", "'route:a'", "HANDLES_ROUTE"), (400, "'n' || (id % 2)", "'route:a'", "FETCHES"), (400, "'n' || (id % 4)", "'h' || (id % 100)", "CALLS"))


def test_route_consumers_parallel_edges(spark):
    got = route_consumers(edges(spark, *CROWD))
    want = {("route:a", f"h{k}", f"n{c}") for k in range(400) for c in range(2)} | {("route:a", f"h{k}", f"n{k % 4}") for k in range(100)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert output_rows(got) <= 2 * len(want)


def test_api_impact_parallel_edges(spark):
    g = edges(spark, *CROWD)
    got = api_impact(g, g.vertices.where("id like 'h%'"))
    assert {r.id: r.n_consumers for r in got.collect()} == {f"h{k}": 2 + (k < 100 and k % 4 > 1) for k in range(400)}
    assert output_rows(got) <= 2000


def repeats(spark, n, kinds, **columns):
    return spark.range(n).selectExpr(f"id % {kinds} as k").selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def test_contracts_named_often(spark):
    grpc = J.match_grpc(repeats(spark, 900, 3, repo="'a' || k", service="'S' || k || 'Service'"), repeats(spark, 900, 3, repo="'b' || (k % 2)", service="'s' || k || 'Client'"))
    assert {tuple(r)[:4] for r in grpc.collect()} == {(f"a{k}", f"S{k}Service", f"b{k % 2}", f"s{k}Client") for k in range(3)} and grpc.count() == 3
    topics = J.match_topics(repeats(spark, 900, 3, repo="'a' || k", topic="'T' || k"), repeats(spark, 900, 3, repo="'b' || (k % 2)", topic="case when k = 0 then 'T0' else 't' || k end"))
    assert sorted(tuple(r) for r in topics.select("producer_repo", "topic", "consumer_repo").collect()) == [(f"a{k}", f"t{k}", f"b{k % 2}") for k in range(3)]
    assert output_rows(grpc) <= 9 and output_rows(topics) <= 9


def test_wildcard_imports_need_no_sort_of_pairs(spark):
    i = spark.createDataFrame([("i1", "a.b"), ("i1", "a.b"), ("i2", "a"), ("i2", "a.b"), ("i3", "a.c"), ("i4", None)], "import_id string, module_path string").selectExpr("*", "array('') as names")
    s = spark.range(2000).selectExpr("'s' || (id % 1000) as id", "'x' as name", "'a/b.py' as file_path").unionByName(spark.createDataFrame([("t", "x", "a/c.py")], "id string, name string, file_path string"))
    got = J.resolve_imports(i, s, wildcard=True)
    want = {(f"i{k}", f"s{n}") for k in (1, 2) for n in range(1000)} | {("i2", "t"), ("i3", "t")}
    rows = [tuple(r)[:2] for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    one = J.resolve_imports(i.where("import_id = 'i1'"), s, wildcard=True)
    assert output_rows(one) <= 1000


def test_stemmed_search_reads_words_once(spark):
    assert [r[0] for r in spark.createDataFrame([(["running", None, "ties"],), (None,), ([],)], "w array<string>").select(X.stem_all("w")).collect()] == [["run", None, "ti"], None, []]
    texts = spark.createDataFrame([("a", "Running runs, ponies"), ("b", "ran running pony pony"), ("c", "pony"), ("d", None), (None, "running ponies")], "id string, text string")
    want = [tuple(r) for r in R.bm25_search(R.postings(texts, stemming=True), "runs ponies", stemming=True).collect()]
    got = [tuple(r) for r in R.bm25_search(R.word_rows(texts, stemming=True), "runs ponies", stemming=True).collect()]
    assert [r[0] for r in got] == ["a", "b"] and got == want


def blocks_graph(spark):
    """Two cliques that share a vertex, a ring behind a bridge, and a chain of its own."""
    clique = lambda *vs: [(a, b) for k, a in enumerate(vs) for b in vs[k + 1 :]]
    pairs = clique("a", "b", "c", "d") + clique("d", "e", "f") + [("f", "r0")] + [(f"r{k}", f"r{(k + 1) % 6}") for k in range(6)] + [("x", "y"), ("y", "z")]
    v = spark.createDataFrame([(i, "Function", i, "f") for i in sorted({x for p in pairs for x in p} | {"alone"})], "id string, label string, name string, file_path string")
    return pairs, PropertyGraph(v, spark.createDataFrame([(a, b, "CALLS", 1.0) for a, b in pairs], "src string, dst string, type string, confidence double"))


def plain_betweenness(pairs, ids):
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in ids}
    far = {}
    for s in ids:
        level, far[s] = {s: 1}, {s: (0, 1)}
        while level:
            after = {}
            for u, n in level.items():
                for v in near[u] - far[s].keys():
                    after[v] = after.get(v, 0) + n
            far[s] |= {v: (far[s][next(iter(level))][0] + 1, n) for v, n in after.items()}
            level = after
    one = lambda s, v, t: far[s][v][1] * far[v][t][1] / far[s][t][1] if t in far[s] and v in far[s] and far[s][v][0] + far[v][t][0] == far[s][t][0] else 0
    return {v: sum(one(s, v, t) for s in ids for t in ids if len({s, v, t}) == 3) / 2 for v in ids}


def test_betweenness_by_blocks(spark, monkeypatch):
    pairs, g = blocks_graph(spark)
    want = plain_betweenness(pairs, [r.id for r in g.vertices.collect()])
    got = {r.id: round(r.betweenness, 9) for r in C.betweenness(g).collect()}
    assert got == {i: round(b, 9) for i, b in want.items()}
    # Blocks beyond a task's work, one source a chunk.
    monkeypatch.setattr(C, "TASK_WORK", 12)
    e = g.undirected().where("a < b").where("a <> 'x' and a <> 'y'").toPandas().assign(component="a")
    rows = C._component_betweenness(e)
    sums = rows.dropna(subset=["id"]).set_index("id")["got"].to_dict()
    for _, block in rows.dropna(subset=["block"]).groupby("block"):
        for chunk in range(int(block["n_chunks"].iloc[0])):
            for i, b in C._chunk_betweenness(block.assign(chunk=chunk)).itertuples(index=False):
                sums[i] = sums.get(i, 0) + b
    assert rows["block"].nunique() == 3 and all(abs(sums.get(i, 0) / 2 - b) < 1e-9 for i, b in want.items() if i not in "xyz")


def test_betweenness_limit_is_a_component(spark):
    pairs, g = blocks_graph(spark)
    assert C.betweenness(g, max_edges=16).count() == 16


def test_census_sends_no_table_through_the_driver(spark):
    g = blocks_graph(spark)[1]
    row = M.census(g).first()
    assert (row.n_vertices, row.triangle, row.clique) == (16, 5, 1)
    small = PropertyGraph(g.vertices, spark.sql("select * from values ('a', 'b', 'CALLS', 1.0D), ('b', 'c', 'CALLS', 1.0D), ('a', 'c', 'CALLS', 1.0D) as e(src, dst, type, confidence)"))
    assert "BroadcastHashJoin" not in M.triangles(small)._jdf.queryExecution().sparkPlan().toString()


def test_census_looks_at_all_neighbours(spark):
    rng, ids = random.Random(18), [f"v{k:02}" for k in range(48)]
    pairs = {(ids[20], i) for i in ids if i != ids[20]} | {(a, b) for a, b in combinations(ids, 2) if rng.random() < (0.7 if b < "v10" else 0.06)}
    near = {i: set() for i in ids}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    shape = {(3, 3): "star", (4, 3): "diamond", (5, 3): "diamond", (6, 3): "clique"}
    want = dict.fromkeys(M.MOTIF4, 0)
    for q in combinations(ids, 4):
        inner = [len(near[i].intersection(q)) for i in q]
        if max(inner) == 3:
            want[shape[sum(inner) // 2, 3]] += 1
    assert len(near[ids[20]]) == 47 and min(want[s] for s in ("star", "diamond", "clique")) > 50
    v = spark.createDataFrame([(i,) for i in ids], "id string").selectExpr("id", "'Function' as label", "id as name", "id as file_path")
    e = spark.createDataFrame(sorted(pairs), "src string, dst string").selectExpr("src", "dst", "'CALLS' as type", "1.0D as confidence")
    row = M.census(PropertyGraph(v, e)).first().asDict()
    assert {s: row[s] for s in M.MOTIF4} == want
