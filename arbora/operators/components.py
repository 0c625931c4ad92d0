"""Components, cores, cycles and cuts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..storage import Workspace


def _mark(df: DataFrame, *cols: str) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols) % 1_000_003)).first())


def star_components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(id, component) for ids of edges (a, b): the smallest id reachable, by alternating large and small stars."""
    now = work.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, turn = _mark(now, "u", "v"), 0
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        turn += 1
        now = work.save(small, f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        after = _mark(now, "u", "v")
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def connected_components(g: PropertyGraph) -> DataFrame:
    """id, component: the smallest id of the weakly connected component."""
    work = Workspace(g.spark, "components")
    e = g.without_dangling().edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = star_components(e, work)
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
    """id, component of the cycles among edges (src, dst), by one depth-first walk without recursion."""
    names, place = pd.factorize(pd.concat([pdf["src"], pdf["dst"]]), sort=True)[::-1]
    n, m = len(names), len(pdf)
    order = np.argsort(place[:m], kind="stable")
    first = np.searchsorted(place[:m][order], np.arange(n + 1)).tolist()
    to = place[m:][order].tolist()
    index, low, at = [-1] * n, [0] * n, first[:n].copy()
    stack, held, component, count = [], bytearray(n), [-1] * n, 0
    for root in range(n):
        if index[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                held[v] = 1
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if index[w] < 0:
                    path.append(w)
                elif held[w]:
                    low[v] = min(low[v], index[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(stack.pop())
                    held[members[-1]] = 0
                if len(members) > 1:
                    smallest = min(members)
                    for w in members:
                        component[w] = smallest
    some = [v for v in range(n) if component[v] >= 0]
    return pd.DataFrame({"id": names[some], "component": names[[component[v] for v in some]]})


def strong_components(g: PropertyGraph, max_rounds: int = 100_000, kernel_edges: int = 200_000) -> DataFrame:
    """id, component of strongly connected components of two vertices or more; the name is the smallest id.

    Weakly connected parts of up to kernel_edges edges are dealt to tasks of
    about that many edges and walked there. Larger parts take a loop of joins with
    the same result: vertices on no cycle are trimmed by degree; then every vertex
    takes the smallest id that reaches it; within a colour, what reaches the
    colour's own vertex backwards is its component and leaves.
    """
    work = Workspace(g.spark, "scc")
    e = work.save(g.without_dangling().edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    weak = star_components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), work, "weak").toDF("src", "weak")
    placed = work.save(e.join(weak, "src", "left").withColumn("weak", F.coalesce("weak", "src")), "placed")
    size = placed.groupBy("weak").agg(F.count(F.lit(1)).alias("n"))
    large = size.where(F.col("n") > kernel_edges).select("weak")
    n_small = size.where(F.col("n") <= kernel_edges).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    deals = max(-(-n_small // kernel_edges), min(64, n_small // 1000), 1)
    small = placed.join(large, "weak", "left_anti").withColumn("deal", F.pmod(F.xxhash64("weak"), F.lit(deals)))
    out = work.save(small.groupBy("deal").applyInPandas(_tarjan, "id string, component string"), "walked")
    rest = placed.join(large, "weak", "left_semi").select("src", "dst")
    if not rest.isEmpty():
        out = out.unionByName(work.save(_strong_by_joins(rest, work, max_rounds), "joined"))
    work.drop_all_but("walked", "joined")
    return out


def _strong_by_joins(edges: DataFrame, work: Workspace, max_rounds: int) -> DataFrame:
    """strong_components of distinct edges (src, dst) by joins alone."""
    e = work.save(edges, "edges-0")
    found, k, n = None, 0, e.count()
    while k < max_rounds:
        while True:  # trim
            k += 1
            kept = work.save(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), f"edges-{k}")
            work.drop(f"edges-{k - 1}")
            e, before, n = kept, n, kept.count()
            if n == before:
                break
        if not n:
            break
        colour = _settle(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("c", F.col("id")), e, work, f"colour-{k}")
        inside = work.save(
            e.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")), f"inside-{k}"
        )
        reach = colour.where("id = c").select("id", "c")
        frontier, t = reach, 0
        while True:
            t += 1
            step = frontier.join(inside.withColumnRenamed("c", "cc"), (F.col("id") == F.col("dst")) & (F.col("c") == F.col("cc"))).select(F.col("src").alias("id"), "c").distinct()
            frontier = work.save(step.join(reach, ["id", "c"], "left_anti"), f"back-{k}-{t}")
            if frontier.isEmpty():
                break
            reach = reach.unionByName(frontier)
        reach = work.save(reach, f"reach-{k}")
        found = reach if found is None else found.unionByName(reach)
        k += 1
        e = work.save(e.join(reach.select(F.col("id").alias("src")), "src", "left_anti").join(reach.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), f"edges-{k}")
        n = e.count()
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
    big = found.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("component")).where("n > 1")
    return found.join(big, "c").select("id", "component")


def _settle(state: DataFrame, e: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Spreads the smallest c along edges until nothing changes."""
    state, t = work.save(state, f"{name}-0"), 0
    before = _mark(state, "id", "c")
    while True:
        t += 1
        got = state.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        state = work.save(state.join(got, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c")), f"{name}-{t}")
        after = _mark(state, "id", "c")
        if after == before:
            return state
        before = after


def peel_order(g: PropertyGraph, max_rounds: int = 10_000) -> DataFrame:
    """id, level: Kahn's peeling by rounds; vertices on or behind a cycle are missing. Level 0 has no edge in."""
    work = Workspace(g.spark, "peel")
    e = work.save(g.without_dangling().edges.select("src", "dst"), "edges")
    left = work.save(g.vertices.select("id"), "left-0")
    done = None
    for level in range(max_rounds):
        blocked = e.join(left.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        free = work.save(left.join(blocked, "id", "left_anti").withColumn("level", F.lit(level)), f"free-{level}")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = work.save(left.join(free, "id", "left_anti"), f"left-{level + 1}")
        work.drop(f"left-{level}")
    if done is not None:
        work.drop_all_but(*(t for t in work.tables if t.startswith("free-")))
    return done if done is not None else left.withColumn("level", F.lit(0)).limit(0)


def topological_order(g: PropertyGraph) -> DataFrame:
    """id, position: dependencies (targets) first; members of cycles are omitted."""
    from pyspark.sql import Window

    back = PropertyGraph(g.vertices, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    peeled = peel_order(back)
    ranked = peeled.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    before = ranked.withColumn("before", F.sum("n").over(Window.orderBy("level")) - F.col("n")).select("level", "before")
    w = Window.partitionBy("level").orderBy("id")
    return peeled.join(F.broadcast(before), "level").select("id", (F.col("before") + F.row_number().over(w)).alias("position"))


def flow_hierarchy(g: PropertyGraph) -> DataFrame:
    """One number: the share of edges whose source peels off; 1 for a DAG, 0 without edges."""
    e = g.without_dangling().edges
    hit = e.join(peel_order(g).select(F.col("id").alias("src"), F.lit(1).alias("h")), "src", "left")
    return hit.agg(F.coalesce(F.avg(F.coalesce("h", F.lit(0))), F.lit(0.0)).alias("flow_hierarchy"))


def k_core(g: PropertyGraph, k: int, max_rounds: int = 100) -> DataFrame:
    """ids of the k-core of the undirected simple graph: vertices with fewer than k neighbours leave, again and again."""
    work = Workspace(g.spark, "core")
    e = work.save(g.without_dangling().undirected(), "pairs-0")
    n = e.count()
    for t in range(1, max_rounds + 1):
        keep = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("a")
        e = work.save(e.join(keep, "a", "left_semi").join(keep.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"), f"pairs-{t}")
        work.drop(f"pairs-{t - 1}")
        now = e.count()
        if now == n:
            break
        n = now
    return e.select(F.col("a").alias("id")).distinct()


def mesh(g: PropertyGraph, least_density: float = 0.5) -> DataFrame:
    """Strong components of three or more with dense inner edges: component, n, n_edges, density, anchors (fewest inner edges out)."""
    scc = strong_components(g)
    e = g.edges.join(scc.toDF("src", "cs"), "src").join(scc.toDF("dst", "cd"), "dst").where("cs = cd")
    out = scc.join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o")), "id", "left").select("id", "component", F.coalesce("o", F.lit(0)).alias("o"))
    per = out.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("n_edges"), F.min("o").alias("least"))
    per = per.where("n >= 3").withColumn("density", F.col("n_edges") / (F.col("n") * (F.col("n") - 1))).where(F.col("density") >= least_density)
    anchors = out.join(per.select("component", "least"), "component").where("o = least").groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("anchors"))
    return per.join(anchors, "component").select("component", "n", "n_edges", "density", "anchors")


def cut_structure(g: PropertyGraph, max_component_edges: int = 2_000_000) -> DataFrame:
    """Bridges and cut vertices: kind, a, b, n_parts, n_cut_off.

    For a bridge (a, b) are its ends in order. For a cut vertex a, n_parts is
    the number of pieces its component falls into, n_cut_off how many vertices
    hang below it seen from the component's smallest id. Low-link numbering is
    sequential, so each component is one task; leaves are cut off first (each
    leaf's edge is a bridge), and components over max_component_edges raise.
    """
    pairs = g.without_dangling().undirected()
    cc = connected_components(g)
    e = pairs.where("a < b").join(cc.withColumnRenamed("id", "a"), "a")
    worst = e.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if worst > max_component_edges:
        raise ValueError(f"a component has {worst} edges; max_component_edges={max_component_edges}")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        adj: dict[str, list[str]] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            adj.setdefault(a, []).append(b)
            adj.setdefault(b, []).append(a)
        for v in adj.values():
            v.sort()
        root = min(adj)
        disc, low, size, parent = {root: 0}, {root: 0}, {root: 1}, {root: None}
        parts: dict[str, int] = {}
        below: dict[str, int] = {}
        bridges, stack, roots = [], [(root, iter(adj[root]))], 0
        while stack:
            v, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                p = parent[v]
                if p is None:
                    continue
                size[p] += size[v]
                low[p] = min(low[p], low[v])
                if low[v] > disc[p]:
                    bridges.append((min(p, v), max(p, v)))
                if p == root:
                    roots += 1
                elif low[v] >= disc[p]:
                    parts[p] = parts.get(p, 1) + 1
                    below[p] = below.get(p, 0) + size[v]
            elif w not in disc:
                parent[w], disc[w], low[w], size[w] = v, len(disc), len(disc), 1
                stack.append((w, iter(adj[w])))
            elif w != parent[v]:
                low[v] = min(low[v], disc[w])
        if roots > 1:
            parts[root], below[root] = roots, size[root] - 1
        rows = [("bridge", a, b, 2, 0) for a, b in bridges] + [("cut_vertex", v, None, parts[v], below[v]) for v in parts]
        return pd.DataFrame(rows, columns=["kind", "a", "b", "n_parts", "n_cut_off"])

    return e.groupBy("component").applyInPandas(kernel, "kind string, a string, b string, n_parts long, n_cut_off long")


def bridges(g: PropertyGraph) -> DataFrame:
    return cut_structure(g).where("kind = 'bridge'").select("a", "b")


def cut_vertices(g: PropertyGraph) -> DataFrame:
    return cut_structure(g).where("kind = 'cut_vertex'").select(F.col("a").alias("id"), "n_parts", "n_cut_off")


def smells(g: PropertyGraph) -> DataFrame:
    """Counts of architecture smells: kind, n."""
    from .aggregates import hubs, martin_metrics

    count = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    cuts = cut_structure(g)
    parts = [
        count("cycle", strong_components(g).select("component").distinct()),
        count("cut_vertex", cuts.where("kind = 'cut_vertex'")),
        count("bridge", cuts.where("kind = 'bridge'")),
        count("hub", hubs(g, only_hubs=True)),
        count("off_main_sequence", martin_metrics(g).where("distance > 0.7")),
        count("mesh", mesh(g)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
