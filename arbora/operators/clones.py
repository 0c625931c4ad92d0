"""Structural clones: Weisfeiler-Lehman labels, equal labels grouped, neighbourhoods compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up
from ..model import PropertyGraph
from ..plans.rewrites import set_similarity_join
from ..storage import Workspace
from .aggregates import degrees
from .components import star_components


def wl_labels(g: PropertyGraph, rounds: int = 2) -> DataFrame:
    """id, label: degrees first, then the md5 of the own label and the sorted labels of all targets, ``rounds`` times."""
    state = degrees(g).select("id", F.concat(F.lit("d:"), F.col("n_out"), F.lit(","), F.col("n_in")).alias("label"))
    work = Workspace(g.spark, "wl")
    e = work.save(g.without_dangling().edges.select("src", "dst"), "edges")
    for k in range(rounds):
        near = e.join(state.toDF("dst", "l"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("l")), ",").alias("ls"))
        state = work.save(state.join(near, "id", "left").select("id", F.md5(F.concat("label", F.lit("|"), F.coalesce("ls", F.lit("")))).alias("label")), f"labels-{k}")
        work.drop(f"labels-{k - 1}")
    work.drop("edges")
    return state


def _members(g: PropertyGraph) -> DataFrame:
    """id, label, s: vertices with some target, their labels and the sorted set of their targets' labels."""
    labels = wl_labels(g)
    e = g.without_dangling().edges.select("src", "dst")
    sets = e.join(labels.toDF("dst", "l"), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("l")).alias("s"))
    return labels.join(sets, "id")


def _set_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of distinct sets (first, label, s) of equal label, a < b.

    Labels are part of the items, so the set-similarity join pairs only sets of one label.
    """
    items = sets.select("first", F.explode(F.transform("s", lambda x: F.concat_ws(":", "label", x))).alias("item"))
    near = set_similarity_join(items, "first", "item", least - 0.0001)
    return near.select("a", "b", round_half_up(F.col("jaccard"), 4).alias("similarity")).where(F.col("similarity") >= least)


def clone_set_pairs(g: PropertyGraph, least: float = 0.6) -> DataFrame:
    """(a, b, n_a, n_b, similarity, pairs): clone_pairs by distinct sets, a and b the smallest ids of their vertices.

    n_a and n_b count the vertices of a set, pairs the pairs of vertices; a = b
    stands for the pairs inside a set of two or more. Nothing is left out, and
    the rows don't grow with the number of equal vertices.
    """
    sets = _members(g).groupBy("label", "s").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    sets = Workspace(g.spark, "clone-sets").save(sets, "sets")
    n = sets.select("first", "n")
    across = _set_pairs(sets, least).join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b").select("a", "b", "n_a", "n_b", "similarity", (F.col("n_a") * F.col("n_b")).alias("pairs"))
    inside = n.where("n > 1").select(F.col("first").alias("a"), F.col("first").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(1.0).alias("similarity"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return across.unionByName(inside.where(F.col("similarity") >= least))


def clone_pairs(g: PropertyGraph, least: float = 0.6) -> DataFrame:
    """(a, b, similarity): vertices of equal label whose targets' label sets have Jaccard >= least; both empty never pair.

    All pairs, so the rows grow with the square of a group; clone_set_pairs has them by distinct sets.
    """
    v = Workspace(g.spark, "clone-pairs").save(_members(g).withColumn("first", F.min("id").over(Window.partitionBy("label", "s"))), "members")
    near = _set_pairs(v.where("id = first").distinct(), least)
    same = v.select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(1.0).alias("similarity")).distinct().where(F.col("similarity") >= least)
    either = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).unionByName(same)
    ids = v.select("id", "first")
    both = either.toDF("first_a", "first_b", "similarity").join(ids.toDF("a", "first_a"), "first_a").join(ids.toDF("b", "first_b"), "first_b")
    return both.where("a < b").select("a", "b", "similarity")


def clone_classes(g: PropertyGraph) -> DataFrame:
    """label, n, first_id: groups of two or more vertices with equal labels and some target, whole and uncapped."""
    some = g.without_dangling().edges.select(F.col("src").alias("id")).distinct()
    return wl_labels(g).join(some, "id", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def clone_clusters(pairs: DataFrame, work: Workspace) -> DataFrame:
    """cluster, n, representative (greatest summed similarity, then smallest id), average similarity (4 digits), of clone_set_pairs.

    All vertices of a set have the same sum, so its smallest id stands for them. Sums are of whole ten-thousandths, exact in any order.
    """
    pairs = work.save(pairs.withColumn("units", F.round(F.col("similarity") * 10000).cast("long")), "pairs")
    cc = star_components(pairs.select("a", "b"), work)
    ends = pairs.select(F.col("a").alias("id"), F.col("n_a").alias("n"), F.when(F.col("a") == F.col("b"), F.col("n_b") - 1).otherwise(F.col("n_b")).alias("others"), "units")
    ends = ends.unionByName(pairs.where("a <> b").select(F.col("b").alias("id"), F.col("n_b").alias("n"), F.col("n_a").alias("others"), "units"))
    node = ends.groupBy("id").agg(F.max("n").alias("n"), F.sum(F.col("others") * F.col("units")).alias("s")).join(cc, "id", "left").withColumn("cluster", F.coalesce("component", "id"))
    best = node.groupBy("cluster").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("s")).alias("s"), "id")).alias("r"))
    average = pairs.join(node.select(F.col("id").alias("a"), "cluster"), "a").groupBy("cluster").agg((F.sum(F.col("pairs") * F.col("units")) / F.sum("pairs") / 10000).alias("m"))
    return best.join(average, "cluster").select("cluster", "n", F.col("r.id").alias("representative"), round_half_up(F.col("m"), 4).alias("similarity"))


def similarity_buckets(pairs: DataFrame) -> DataFrame:
    """exact (>= .95), near (>= .8), potential (>= .6), of clone_set_pairs."""
    s = F.col("similarity")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("pairs"))), F.lit(0))
    return pairs.agg(count(s >= 0.95).alias("exact"), count((s >= 0.8) & (s < 0.95)).alias("near"), count((s >= 0.6) & (s < 0.8)).alias("potential"))


def vertex_jaccard(g: PropertyGraph, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard) of undirected neighbour sets for the pairs, or for all edges.

    Common neighbours are counted by two equi-joins on the given pairs; no neighbour set is built.
    """
    near = g.without_dangling().undirected()
    d = near.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    wanted = (pairs if pairs is not None else near.where("a < b")).select("a", "b").distinct()
    shared = wanted.join(near.toDF("a", "x"), "a").join(near.toDF("b", "x"), ["b", "x"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"))
    out = wanted.join(shared, ["a", "b"], "left").join(d.toDF("a", "na"), "a", "left").join(d.toDF("b", "nb"), "b", "left")
    i, na, nb = (F.coalesce(c, F.lit(0)).cast("double") for c in ("i", "na", "nb"))
    return out.select("a", "b", F.coalesce(F.try_divide(i, na + nb - i), F.lit(0.0)).alias("jaccard"))
