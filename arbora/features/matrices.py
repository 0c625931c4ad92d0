"""Vertex and edge features, homogeneous and by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import lines_of_code, one_hot
from ..model import EDGE_TYPES, LABELS, PropertyGraph
from ..operators.aggregates import degrees
from ..operators.community import label_index

# Labels, edge types, languages and ordinals of the plain matrices.
MATRIX_LABELS = (
    "Project Package Module Folder File Section Class Function Method Variable Interface Enum Decorator Import Type CodeElement Struct Constructor "
    "Community Process Macro Typedef Union Namespace Trait Impl TypeAlias Const Static Property"
).split()
MATRIX_TYPES = (
    "CONTAINS CALLS EXTENDS METHOD_OVERRIDES METHOD_IMPLEMENTS IMPORTS USES DEFINES DECORATES IMPLEMENTS HAS_METHOD HAS_PROPERTY ACCESSES "
    "MEMBER_OF STEP_IN_PROCESS HANDLES_ROUTE FETCHES HANDLES_TOOL ENTRY_POINT_OF WRAPS QUERIES USES_FRAMEWORK RETURNS_TYPE DECLARES_TYPE CHAINABLE_TO"
).split()
MATRIX_LANGUAGES = "typescript javascript tsx python java go rust csharp php ruby swift c cpp dart kotlin scala html".split()
MATRIX_VISIBILITY = {"public": 0, "protected": 1, "private": 2}
VISIBILITY = {"private": 0, "protected": 1, "internal": 2, "public": 3}


def _or_null(df: DataFrame, name: str, kind: str):
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def vertex_features(g: PropertyGraph, ranks: DataFrame | None = None, between: DataFrame | None = None, members: DataFrame | None = None, labels: list[str] = LABELS) -> DataFrame:
    """id, features: degrees over all edge types, size, flags, ranks, community index (-1: none), then the label one-hot."""
    v = g.vertices.join(degrees(g), "id")
    for extra, name in ((ranks, "rank"), (between, "betweenness")):
        v = v.join(extra.select("id", name), "id", "left") if extra is not None else v.withColumn(name, F.lit(None).cast("double"))
    if members is not None:
        index = label_index(members, "id").withColumnRenamed("index", "ci")
        v = v.join(members.join(index, "community").select("id", "ci"), "id", "left")
    else:
        v = v.withColumn("ci", F.lit(None).cast("int"))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    flag = lambda c: number(_or_null(v, c, "boolean").cast("int"))
    loc = lines_of_code(_or_null(v, "start_line", "double"), _or_null(v, "end_line", "double"))
    dense = [F.col("n_in"), F.col("n_out"), F.col("n_total"), loc, _or_null(v, "parameter_count", "double"), F.col("rank"), F.col("betweenness"), F.coalesce("ci", F.lit(-1))]
    flags = [flag(c) for c in ("is_exported", "is_static", "is_abstract", "is_async")]
    return v.select("id", F.concat(F.array(*(number(c) for c in dense), *flags), F.transform(one_hot(F.col("label"), labels), lambda x: x.cast("double"))).alias("features"))


def edge_features(g: PropertyGraph, members: DataFrame | None = None, types: list[str] = EDGE_TYPES) -> DataFrame:
    """src, dst, type, confidence, crosses (communities differ; two vertices without one don't), features."""
    e = g.edges.select("src", "dst", "type", "confidence")
    if members is not None:
        e = e.join(members.toDF("src", "cs"), "src", "left").join(members.toDF("dst", "cd"), "dst", "left")
        e = e.withColumn("crosses", ~F.col("cs").eqNullSafe(F.col("cd")))
    else:
        e = e.withColumn("crosses", F.lit(False))
    hot = F.transform(one_hot(F.col("type"), types), lambda x: x.cast("double"))
    return e.select("src", "dst", "type", "confidence", "crosses", F.concat(F.array("confidence", F.col("crosses").cast("double")), hot).alias("features"))


def hetero_index(vertices: DataFrame) -> DataFrame:
    """id, label, index: vertices numbered from 0 within their label, in order of id."""
    return vertices.select("id", "label", (F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).alias("index"))


def hetero_edges(g: PropertyGraph) -> DataFrame:
    """src_label, type, dst_label, and the ends' indexes: the edge lists of a heterogeneous graph."""
    i = hetero_index(g.vertices)
    e = g.edges.join(i.toDF("src", "src_label", "src_index"), "src").join(i.toDF("dst", "dst_label", "dst_index"), "dst")
    return e.select("src_label", "type", "dst_label", "src_index", "dst_index", "confidence")


def node_matrix(vertices: DataFrame, edges: DataFrame | None = None, embeddings: DataFrame | None = None, dims: int = 0, labels: list[str] | None = None) -> DataFrame:
    """id, features: label one-hot, degrees (in, out, total; zeros without edges), visibility, language one-hot, two counts, five flags, then the embedding (id, vector; zeros where missing).

    Missing columns and nulls are 0; unknown labels and languages are all zeros.
    """
    labels = labels or MATRIX_LABELS
    v = vertices
    if edges is not None:
        out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_out"))
        into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_in"))
        v = v.join(out, "id", "left").join(into, "id", "left")
    else:
        v = v.withColumn("_out", F.lit(0)).withColumn("_in", F.lit(0))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    hot = lambda c, names: F.transform(one_hot(c, names), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    n_in, n_out = number(F.col("_in")), number(F.col("_out"))
    seen = F.lower(F.coalesce(_or_null(v, "visibility", "string"), F.lit("public")))
    ordinal = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in MATRIX_VISIBILITY.items() for x in kv)), seen), F.lit(0))
    counts = [number(_or_null(v, c, "double")) for c in ("parameter_count", "level")]
    flags = [number(_or_null(v, c, "boolean").cast("int")) for c in ("is_exported", "is_static", "is_readonly", "is_abstract", "is_async")]
    features = F.concat(hot(F.col("label"), labels), F.array(n_in, n_out, n_in + n_out, ordinal.cast("double")), hot(_or_null(v, "language", "string"), MATRIX_LANGUAGES), F.array(*counts, *flags))
    if embeddings is None:
        return v.select("id", features.alias("features"))
    v = v.join(embeddings.select("id", F.col("vector").cast("array<double>").alias("_vector")), "id", "left")
    return v.select("id", F.concat(features, F.coalesce("_vector", F.array_repeat(F.lit(0.0), dims))).alias("features"))


def edge_matrix(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """src, dst, type, features: confidence, step, type one-hot; missing columns and nulls are 0, unknown types all zeros."""
    number = lambda c: F.coalesce(_or_null(edges, c, "double"), F.lit(0.0))
    hot = F.transform(one_hot(F.col("type"), types or MATRIX_TYPES), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return edges.select("src", "dst", "type", F.concat(F.array(number("confidence"), number("step")), hot).alias("features"))
