"""The property graph: vertices and typed, confidence-weighted edges as two DataFrames.

Mutation returns new DataFrames. Identity rules: a vertex added again replaces
the older one (last wins), an edge added again under the same id is ignored
(first wins), removing a vertex removes its edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The vocabularies of labels and edge types.
LABELS = (
    "Project Package Module Folder File Class Function Method Variable Interface Enum Decorator Import Type CodeElement Community Process "
    "PatternInstance Struct Macro Typedef Union Namespace Trait Impl TypeAlias Const Static Property Record Delegate Annotation Constructor "
    "Template Section Route Tool Framework HierarchyGroup"
).split()
EDGE_TYPES = (
    "CONTAINS CALLS EXTENDS METHOD_OVERRIDES METHOD_IMPLEMENTS IMPORTS USES DEFINES DECORATES IMPLEMENTS HAS_METHOD HAS_PROPERTY ACCESSES "
    "MEMBER_OF STEP_IN_PROCESS HANDLES_ROUTE FETCHES HANDLES_TOOL ENTRY_POINT_OF WRAPS QUERIES USES_FRAMEWORK RETURNS_TYPE DECLARES_TYPE "
    "CHAINABLE_TO SEMANTICALLY_SIMILAR IMPLEMENTS_PATTERN SUBGROUP_OF"
).split()
STRUCTURAL = ("File", "Folder", "Import", "Package")
# Edge sets differ by operator on purpose.
DEPENDENCY = ("CALLS", "IMPORTS")
SNAPSHOT = ("CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS")
MOTIF = ("CALLS", "IMPORTS", "EXTENDS")
COUPLING = ("CALLS", "IMPORTS", "USES", "ACCESSES", "EXTENDS", "IMPLEMENTS")

VERTEX_COLUMNS = ("id", "label", "name", "file_path")
EDGE_COLUMNS = ("src", "dst", "type", "confidence")


def last_wins(rows: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """Of each key the row with the greatest seq."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_wins(rows: DataFrame, key: str | list[str], seq: str) -> DataFrame:
    """Of each key the row with the smallest seq."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.asc(seq))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


@dataclass(frozen=True)
class PropertyGraph:
    """vertices: id, label, name, file_path and any properties; edges: src, dst, type, confidence and more."""

    vertices: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    # -- mutation
    def upsert_vertices(self, rows: DataFrame) -> PropertyGraph:
        """Rows replace vertices of the same id entirely."""
        kept = self.vertices.join(rows.select("id"), "id", "left_anti")
        return PropertyGraph(kept.unionByName(rows, allowMissingColumns=True), self.edges)

    def add_edges(self, rows: DataFrame, key: tuple[str, ...] = ("src", "dst", "type")) -> PropertyGraph:
        """Rows whose key exists already are ignored."""
        fresh = rows.join(self.edges.select(*key).distinct(), list(key), "left_anti")
        return PropertyGraph(self.vertices, self.edges.unionByName(fresh, allowMissingColumns=True))

    def remove_vertices(self, ids: DataFrame) -> PropertyGraph:
        """Removes vertices (column id) and their edges."""
        gone = ids.select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return PropertyGraph(self.vertices.join(gone, "id", "left_anti"), edges.select(*self.edges.columns))

    def remove_files(self, paths: DataFrame) -> PropertyGraph:
        """Removes all that lies in the files of column file_path: the unit of incremental update."""
        return self.remove_vertices(self.vertices.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id"))

    def without_dangling(self) -> PropertyGraph:
        """Edges with both ends among the vertices."""
        ids = self.vertices.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(self.vertices, edges.select(*self.edges.columns))

    # -- views
    def of_types(self, *types: str) -> PropertyGraph:
        return PropertyGraph(self.vertices, self.edges.where(F.col("type").isin(*types)))

    def where_vertices(self, condition: Column | str) -> PropertyGraph:
        return PropertyGraph(self.vertices.where(condition), self.edges)

    def undirected(self) -> DataFrame:
        """Distinct pairs (a, b) in both directions, without loops."""
        pairs = self.edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

    # -- persistence
    def save(self, path: str) -> None:
        """Overwrites path; partitions by label and type so that scans by either are pruned."""
        self.vertices.write.mode("overwrite").partitionBy("label").parquet(f"{path}/vertices")
        self.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyGraph:
        return PropertyGraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))
