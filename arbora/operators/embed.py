"""Embeddings on graphs: propagation from neighbours, random walks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph


def _means(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """Position-wise means of vectors by keys."""
    at = neighbours.select(*keys, F.posexplode("vector").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def propagate(g: PropertyGraph, vectors: DataFrame, hops: int = 1, first: float = 0.5, later: float = 0.25) -> DataFrame:
    """id, vector: neighbours that have vectors blend in by their mean: first on hop one, later after; a vertex without one takes the mean.

    Neighbours are undirected and distinct; SEMANTICALLY_SIMILAR edges don't count.
    """
    near = PropertyGraph(g.vertices, g.edges.where("type <> 'SEMANTICALLY_SIMILAR'")).undirected()
    now = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    for hop in range(hops):
        share = first if hop == 0 else later
        mean = _means(near.join(now.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "vector"), ["id"])
        now = now.join(mean, "id", "full_outer").select(
            "id", F.when(F.col("mean").isNull(), F.col("vector")).when(F.col("vector").isNull(), F.col("mean")).otherwise(F.zip_with("vector", "mean", lambda v, m: v * (1 - share) + m * share)).alias("vector")
        )
    return now


def propagate_by_type(g: PropertyGraph, vectors: DataFrame) -> DataFrame:
    """id, type, mean: the mean vector of neighbours over each edge type; parallel edges count each."""
    e = g.edges.select(F.col("src").alias("id"), F.col("dst").alias("b"), "type").unionByName(g.edges.select(F.col("dst").alias("id"), F.col("src").alias("b"), "type"))
    return _means(e.join(vectors.withColumnRenamed("id", "b"), "b").select("id", "type", "vector"), ["id", "type"])


def random_walks(g: PropertyGraph, walks: int = 10, length: int = 8, seed: int = 42, start: DataFrame | None = None) -> DataFrame:
    """walk, path: uniform walks over undirected neighbours; the choice is a hash of (seed, walk, step), so reruns agree.

    A step joins the walks with each vertex's numbered neighbours on (vertex, number), never with whole neighbour lists.
    """
    from pyspark.sql import Window

    near = g.without_dangling().undirected()
    numbered = near.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1)
    d = near.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    at = (start if start is not None else g.vertices).select("id").join(d.select(F.col("a").alias("id")), "id", "left_semi")
    now = at.select(F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w"), "id").select(F.concat_ws("#", "id", "w").alias("walk"), "id", F.array("id").alias("path"))
    for step in range(1, length):
        drawn = now.join(d, F.col("id") == F.col("a")).select("walk", "id", "path", F.pmod(F.xxhash64(F.lit(seed), "walk", F.lit(step)), F.col("n")).alias("k"))
        now = drawn.join(numbered, (F.col("id") == F.col("a")) & (drawn["k"] == numbered["k"])).select("walk", F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
    return now.select("walk", "path")


def walk_embeddings(g: PropertyGraph, dims: int = 128, window: int = 5, walks: int = 10, length: int = 8, seed: int = 42) -> DataFrame:
    """id, vector by Word2Vec over random walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dims, windowSize=window, minCount=1, inputCol="path", outputCol="v", seed=seed).fit(random_walks(g, walks, length, seed))
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("vector"))
