"""Traversals: hops, searches, impact, paths, processes. Levels are joins; only their number is a driver loop."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import distance_decay, edge_decay, round_half_up
from ..model import PropertyGraph
from ..plans.rewrites import frontier_bfs
from ..storage import Workspace
from .filters import compile_filter, match_vertices

SYMBOL = ("id", "label", "name", "file_path")


@dataclass(frozen=True)
class Hop:
    direction: str = "outgoing"
    type: str | None = None
    least: float = 0.0
    edge_filter: dict[str, Any] | None = None
    vertex_filter: dict[str, Any] | None = None


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (src, dst, type, confidence), turned so that a step goes from src to dst."""
    kept = edges.select("src", "dst", "type", "confidence")
    back = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence")
    return {"outgoing": kept, "downstream": kept, "incoming": back, "upstream": back, "any": kept.unionByName(back)}[direction]


def traverse(g: PropertyGraph, start: dict[str, Any], hops: list[Hop], limit: int | None = 50) -> DataFrame:
    """Vertices of every stage (stage 0: the start) as sets: stage, id, label, name, file_path.

    One static plan, a join per hop. limit counts start vertices too, in order of stage and id; None lifts it.
    """
    now = match_vertices(g.vertices, **start).select("id").distinct()
    stages = [now.withColumn("stage", F.lit(0))]
    for k, hop in enumerate(hops, 1):
        e = oriented(g.edges.where(compile_filter(hop.edge_filter or {})), hop.direction)
        if hop.type:
            e = e.where(F.col("type") == hop.type)
        now = now.join(e.where(F.col("confidence") >= hop.least), F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        if hop.vertex_filter:
            now = now.join(g.vertices.where(compile_filter(hop.vertex_filter)), "id", "left_semi")
        stages.append(now.withColumn("stage", F.lit(k)))
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    out = out.join(g.vertices.select(*SYMBOL), "id").select("stage", *SYMBOL)
    return out.orderBy("stage", "id").limit(limit) if limit else out


def neighbourhood(g: PropertyGraph, ids: DataFrame) -> DataFrame:
    """One hop around ids: id, direction, type (lower case), names and their number."""
    names = g.vertices.select(F.col("id").alias("other"), "name")
    i = ids.select("id").distinct()
    out = i.join(g.edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type"), "id").withColumn("direction", F.lit("outgoing"))
    into = i.join(g.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "type"), "id").withColumn("direction", F.lit("incoming"))
    both = out.unionByName(into).join(names, "other", "left")
    return both.groupBy("id", "direction", F.lower("type").alias("type")).agg(F.sort_array(F.collect_list(F.coalesce("name", "other"))).alias("names"), F.count(F.lit(1)).alias("n"))


def impact(g: PropertyGraph, seeds: DataFrame, direction: str = "upstream", max_depth: int = 5, least: float = 0.3, group: str | None = None, cap: int | None = None) -> DataFrame:
    """Vertices reached from the seeds with the depth of the first visit; STEP_IN_PROCESS is no path; the seeds are left out.

    cap, the reports' limit (500 there), keeps the first so many by depth, then id; without it all come.
    """
    e = oriented(g.edges.where((F.col("confidence") >= least) & (F.col("type") != "STEP_IN_PROCESS")), direction)
    work = Workspace(g.spark, "impact")
    found = frontier_bfs(e, seeds, max_depth, work, group).where("depth > 0")
    if cap is not None:
        found = found.orderBy("depth", "id", *([group] if group else [])).limit(cap)
    return found.join(g.vertices.select(*SYMBOL), "id", "left")


def depth_risk(depth: Column, crosses: Column | None = None) -> Column:
    """Depth 1 will break, 2 is likely, deeper may be; a process across communities raises the last two by a step."""
    level = depth if crosses is None else F.when(crosses & (depth >= 2), F.least(depth, F.lit(3)) - 1).otherwise(depth)
    return F.when(level <= 1, "WILL BREAK").when(level == 2, "LIKELY AFFECTED").otherwise("MAYBE AFFECTED")


def depth_groups(reached: DataFrame) -> DataFrame:
    return reached.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).withColumn("risk", depth_risk(F.col("depth")))


def impact_probability(g: PropertyGraph, seed: str, direction: str = "upstream", max_depth: int = 5, schedule: str = "linear", cap: int | None = None) -> DataFrame:
    """id, score, n_paths, depth, category: confidence that decays along edges, paths fused by noisy-or.

    A vertex is expanded once, on the level of its discovery, with its score at
    the end of that level (level-synchronous, so no queue order matters). Later
    paths into it still count for its own score. cap, the report's limit (100
    there), keeps the first so many by score, then id; without it all come.
    """
    work = Workspace(g.spark, "probability")
    e = work.save(oriented(g.edges, direction).select("src", "dst", (edge_decay(F.col("type")) * F.greatest("confidence", F.lit(0.1))).alias("w")), "edges")
    level = g.spark.createDataFrame([(seed, 1.0)], "id string, score double")
    found = None
    for depth in range(1, max_depth + 1):
        step = level.join(e, F.col("id") == F.col("src")).where(F.col("dst") != seed)
        paths = step.select(F.col("dst").alias("id"), distance_decay(F.col("score") * F.col("w"), F.lit(depth), schedule).alias("p"))
        new = paths.groupBy("id").agg(F.product(1 - F.col("p")).alias("miss"), F.count(F.lit(1)).alias("n"))
        if found is None:
            found = work.save(new.withColumn("depth", F.lit(depth)), f"level-{depth}")
            fresh = found
        else:
            old = found.toDF("id", "miss0", "n0", "depth0")
            merged = old.join(new, "id", "full_outer").select(
                "id", (F.coalesce("miss0", F.lit(1.0)) * F.coalesce("miss", F.lit(1.0))).alias("miss"), (F.coalesce("n0", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("depth0", F.lit(depth)).alias("depth")
            )
            found = work.save(merged, f"level-{depth}")
            work.drop(f"level-{depth - 1}")
            fresh = found.where(F.col("depth") == depth)
        level = fresh.select("id", (1 - F.col("miss")).alias("score"))
        if level.isEmpty():
            break
    work.drop("edges")
    score = round_half_up(1 - F.col("miss"), 3)
    category = F.when(score >= 0.8, "direct").when(score >= 0.4, "transitive").otherwise("low-risk")
    out = found.select("id", score.alias("score"), F.col("n").alias("n_paths"), "depth", category.alias("category"))
    return out if cap is None else out.orderBy(F.desc("score"), "id").limit(cap)


def shortest_paths(g: PropertyGraph, source: str, directed: bool = False, max_depth: int = 50) -> DataFrame:
    """id, distance, parent (the smallest id one step nearer) from one source."""
    work = Workspace(g.spark, "paths")
    e = oriented(g.edges, "outgoing" if directed else "any").select("src", "dst").distinct()
    known = g.vertices.where(F.col("id") == source).select("id")
    seen = frontier_bfs(e, known, max_depth, work)
    near = seen.alias("p").join(e, F.col("p.id") == F.col("src")).join(seen.alias("q"), (F.col("dst") == F.col("q.id")) & (F.col("q.depth") == F.col("p.depth") + 1))
    parent = near.groupBy(F.col("q.id").alias("id")).agg(F.min(F.col("p.id")).alias("parent"))
    return seen.join(parent, "id", "left").select("id", F.col("depth").alias("distance"), "parent")


def shortest_path(g: PropertyGraph, source: str, target: str, directed: bool = False, max_depth: int = 50) -> list[str] | None:
    """The vertices of one shortest path; [s] for s = t; None if there is none."""
    tree = shortest_paths(g, source, directed, max_depth)
    path, at = [target], target
    while at != source:
        row = tree.where(F.col("id") == at).first()
        if row is None:
            return None
        at = row.parent
        path.insert(0, at)
    return path if tree.where(F.col("id") == source).first() else None


def bfs_paths(g: PropertyGraph, start: Column | str, goal: Column | str, max_length: int = 10) -> DataFrame:
    """All shortest directed paths (array of ids) from vertices of one condition to those of another; empty if longer than max_length."""
    work = Workspace(g.spark, "bfs")
    goals = g.vertices.where(goal).select("id")
    e = g.edges.select("src", "dst").distinct()
    level = g.vertices.where(start).select("id", F.array("id").alias("path"))
    for k in range(max_length + 1):
        hit = work.save(level.join(goals, "id", "left_semi").select("path"), f"hit-{k}")
        if k == max_length or not hit.isEmpty():
            return hit
        step = level.join(e, F.col("id") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        level = work.save(step.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")), f"level-{k}")


def landmark_distances(g: PropertyGraph, landmarks: list[str], max_depth: int = 20) -> DataFrame:
    """id, landmark, distance: steps from the vertex to the landmark along the edges."""
    work = Workspace(g.spark, "landmarks")
    seeds = g.spark.createDataFrame([(m, m) for m in landmarks], "landmark string, id string").join(g.vertices.select("id"), "id", "left_semi")
    return frontier_bfs(oriented(g.edges, "incoming"), seeds, max_depth, work, "landmark").withColumnRenamed("depth", "distance")


def trace_processes(g: PropertyGraph, entries: DataFrame, max_depth: int = 50) -> DataFrame:
    """process, step, id, depth: breadth-first steps from each entry over CALLS (USES where there are none); lone entries give none."""
    calls = g.edges.where("type = 'CALLS'")
    if calls.isEmpty():
        calls = g.edges.where("type = 'USES'")
    seeds = entries.select(F.col("id").alias("process"), "id")
    seen = frontier_bfs(calls, seeds, max_depth, Workspace(g.spark, "processes"), "process")
    w = Window.partitionBy("process")
    ordered = seen.withColumn("step", F.row_number().over(w.orderBy("depth", "id"))).withColumn("size", F.count(F.lit(1)).over(w))
    return ordered.where("size > 1").select("process", F.col("step").cast("bigint").alias("step"), "id", "depth")


def classify_processes(steps: DataFrame, members: DataFrame) -> DataFrame:
    """process, n_steps, n_communities, kind: cross_community if its steps lie in several."""
    n = steps.join(members, "id", "left").groupBy("process").agg(F.count(F.lit(1)).alias("n_steps"), F.count_distinct("community").alias("n_communities"))
    return n.withColumn("kind", F.when(F.col("n_communities") > 1, "cross_community").otherwise("intra_community"))


def cross_graph_impact(g: PropertyGraph, repo_of: DataFrame, seeds: DataFrame, links: DataFrame, max_depth: int = 3, least: float = 0.3) -> DataFrame:
    """Impact in the seeds' repo, over links (provider_id, consumer_id) into others, and on in those: repo, n, risk."""
    local = impact(g, seeds, "upstream", max_depth, least).select("id").unionByName(seeds.select("id")).distinct()
    peers = local.join(links, F.col("id") == F.col("provider_id")).select(F.col("consumer_id").alias("id")).distinct()
    there = impact(g, peers, "upstream", max_depth, least).select("id").unionByName(peers)
    n = local.unionByName(there).distinct().join(repo_of, "id").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("risk", F.when(F.col("n") > 10, "critical").when(F.col("n") > 3, "high").otherwise("medium"))


def type_chains(g: PropertyGraph, depth: int = 3) -> DataFrame:
    """(src, dst, level): from members over their types to the types' methods, at most ``depth`` levels, first level wins."""
    typed = g.edges.where(F.col("type").isin("RETURNS_TYPE", "DECLARES_TYPE")).select("src", F.col("dst").alias("t"))
    methods = g.edges.where("type = 'HAS_METHOD'").select(F.col("src").alias("t"), "dst")
    one = typed.join(methods, "t").select("src", "dst").distinct()
    level, out = one, one.withColumn("level", F.lit(1))
    for k in range(2, depth + 1):
        level = level.select("src", F.col("dst").alias("m")).join(one.select(F.col("src").alias("m"), "dst"), "m").select("src", "dst").distinct()
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.where("src <> dst").groupBy("src", "dst").agg(F.min("level").alias("level"))
