"""Communities: label propagation, Louvain, hierarchies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dirname
from ..model import COUPLING, PropertyGraph
from ..plans.rewrites import number_rows
from ..storage import Workspace
from .components import connected_components, star_components


def label_propagation(g: PropertyGraph, rounds: int = 20) -> DataFrame:
    """id, community: in each round every vertex takes the label most of its neighbours have (smallest label on ties); synchronous."""
    work = Workspace(g.spark, "labels")
    pairs = work.save(g.without_dangling().undirected(), "pairs")
    state = g.vertices.select("id", F.col("id").alias("label"))
    for k in range(rounds):
        votes = state.join(pairs, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("v"))
        state = work.save(state.select("id", F.col("label").alias("was")).join(best, "id", "left").select("id", F.coalesce("v.label", "was").alias("label")), f"state-{k}")
        work.drop(f"state-{k - 1}")
    return state.select("id", F.col("label").alias("community"))


def coupling_weights(g: PropertyGraph, types: tuple[str, ...] = COUPLING) -> DataFrame:
    """(a, b, w), a < b: confidences of all edges between two vertices, summed."""
    e = g.without_dangling().edges.where(F.col("type").isin(*types) & (F.col("src") != F.col("dst")))
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("confidence").alias("w"))


def _louvain(pdf: pd.DataFrame, passes: int) -> pd.DataFrame:
    adj: dict[str, dict[str, float]] = {}
    for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"]):
        adj.setdefault(a, {})[b] = adj.get(a, {}).get(b, 0.0) + w
        adj.setdefault(b, {})[a] = adj.get(b, {}).get(a, 0.0) + w
    order = sorted(adj)
    degree = {v: sum(adj[v].values()) for v in order}
    m = sum(degree.values())
    home = {v: v for v in order}
    total = dict(degree)
    for _ in range(passes):
        moved = False
        for v in order:
            links: dict[str, float] = {}
            for u, w in adj[v].items():
                links[home[u]] = links.get(home[u], 0.0) + w
            own, k = home[v], degree[v]
            total[own] -= k
            gain = lambda c: links.get(c, 0.0) / m - total.get(c, 0.0) * k / (m * m)  # noqa: B023, E731
            best = min(links.keys() | {own}, key=lambda c: (-round(gain(c), 12), c != own, c))
            total[best] = total.get(best, 0.0) + k
            moved |= best != own
            home[v] = best
        if not moved:
            break
    return pd.DataFrame({"id": order, "community": [home[v] for v in order]})


def louvain(g: PropertyGraph, types: tuple[str, ...] = COUPLING, passes: int = 10, max_component_edges: int = 2_000_000, oversized: str = "raise") -> DataFrame:
    """id, community (its smallest member): greedy modularity by component, vertices in order of id; communities are connected.

    The greedy pass is sequential, so a component is one task; a component with
    more than max_component_edges pairs raises. oversized="propagate" asks for
    synchronous label propagation there instead, which is distributed throughout
    and gives other communities. A vertex without coupling is alone.
    """
    work = Workspace(g.spark, "louvain")
    w = work.save(coupling_weights(g, types), "weights")
    cc = star_components(w, work)
    inside = work.save(w.join(cc.toDF("a", "component"), "a", "left").select("a", "b", "w", F.coalesce("component", "a").alias("component")), "inside")
    size = inside.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    too_large = size.where(F.col("n") > max_component_edges).select("component")
    found = None
    if not too_large.isEmpty():
        if oversized != "propagate":
            raise ValueError(f"a component has more than max_component_edges={max_component_edges} pairs; raise the limit or pass oversized='propagate'")
        large = inside.join(too_large, "component", "left_semi")
        ids = large.select(F.col("a").alias("id")).union(large.select("b")).distinct()
        found = label_propagation(PropertyGraph(ids, large.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    small = inside.join(too_large, "component", "left_anti").groupBy("component").applyInPandas(lambda pdf: _louvain(pdf, passes), "id string, community string")
    found = work.save(small if found is None else small.unionByName(found), "found")
    same = w.join(found.toDF("a", "ca"), "a").join(found.toDF("b", "cb"), "b").where("ca = cb").select("a", "b")
    pieces = star_components(same, work, "pieces")
    out = work.save(g.vertices.select("id").join(pieces, "id", "left").select("id", F.coalesce("component", "id").alias("community")), "result")
    work.drop_all_but("result")
    return out


def contract(weights: DataFrame, members: DataFrame) -> DataFrame:
    """Weights between communities: (a, b, w), a < b."""
    e = weights.join(members.toDF("a", "ca"), "a").join(members.toDF("b", "cb"), "b").where("ca <> cb")
    return e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))


def hierarchy(g: PropertyGraph, max_levels: int = 5, gain: float = 1.01) -> DataFrame:
    """level, id, community: Louvain, then Louvain of the contracted graph, level by level.

    Ends with one community, where nothing merges, or after the level whose modularity is not over ``gain`` times the last one's.
    """
    work = Workspace(g.spark, "hierarchy")
    now, out, last = g, None, None
    for level in range(max_levels):
        members = work.save(louvain(now), f"level-{level}")
        out = members.withColumn("level", F.lit(level)) if out is None else out.unionByName(members.withColumn("level", F.lit(level)))
        n, groups = members.count(), members.select("community").distinct().count()
        weights = work.save(coupling_weights(now), f"coupling-{level}")
        q = weighted_modularity(weights, members)
        if groups <= 1 or groups == n or (last is not None and q <= last * gain):
            break
        last = q
        w = contract(weights, members)
        now = PropertyGraph(
            members.select(F.col("community").alias("id")).distinct(), work.save(w, f"weights-{level}").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CALLS").alias("type"), F.col("w").alias("confidence"))
        )
    work.drop_all_but(*(t for t in work.tables if t.startswith("level-")))
    return out.select("level", "id", "community")


def weighted_modularity(weights: DataFrame, members: DataFrame) -> float:
    """Modularity of (id, community) over undirected weights (a, b, w); 0 without weights."""
    e = weights.join(members.toDF("a", "ca"), "a").join(members.toDF("b", "cb"), "b")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "w", (F.col("ca") == F.col("cb")).alias("inside"))
    per = ends.groupBy("c").agg(F.sum("w").alias("tot"), F.sum(F.when(F.col("inside"), F.col("w")).otherwise(0.0)).alias("own"))
    r = per.agg(F.sum("tot").alias("m"), F.sum("own").alias("own"), F.sum(F.col("tot") * F.col("tot")).alias("squares")).first()
    return float(r.own / r.m - r.squares / (r.m * r.m)) if r.m else 0.0


def namespaces(vertices: DataFrame, max_depth: int = 3) -> DataFrame:
    """namespace, parent, depth, n: directories of the first max_depth levels with all vertices below them."""
    d = F.filter(F.split(dirname(F.col("file_path")), "/"), lambda s: s != "")
    at = vertices.where("file_path is not null").select("id", d.alias("d")).where("size(d) > 0")
    spread = at.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("d"), F.lit(max_depth))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("d", F.lit(1), k), "/").alias("namespace")))).alias("s")).select("id", "s.*")
    n = spread.groupBy("namespace", "depth").agg(F.count_distinct("id").alias("n"))
    return n.select("namespace", F.when(F.col("depth") > 1, dirname(F.col("namespace"))).alias("parent"), F.col("depth").cast("bigint").alias("depth"), "n")


def collapse(g: PropertyGraph, members: DataFrame) -> PropertyGraph:
    """Each community becomes a vertex; edges between them are summed by type."""
    v = members.groupBy(F.col("community").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit("HierarchyGroup"))
    e = g.edges.join(members.toDF("src", "cs"), "src").join(members.toDF("dst", "cd"), "dst").where("cs <> cd")
    return PropertyGraph(v, e.groupBy(F.col("cs").alias("src"), F.col("cd").alias("dst"), "type").agg(F.sum("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_edges")))


def label_index(members: DataFrame, seq: str) -> DataFrame:
    """community, index: numbered from 0 in order of first appearance (then by name); no task sees all communities."""
    first = members.groupBy("community").agg(F.min(seq).alias("s"))
    return number_rows(first.select("community", "s"), ["s", "community"], "index").select("community", "index")


__all__ = ["collapse", "connected_components", "contract", "coupling_weights", "hierarchy", "label_index", "label_propagation", "louvain", "namespaces"]
