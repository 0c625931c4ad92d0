"""Graph stores: one interface over Parquet, ORC, JSON and CSV folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_COLUMNS, VERTEX_COLUMNS, PropertyGraph
from ..storage import Workspace

BACKENDS = ("parquet", "orc", "json", "csv")


@dataclass(frozen=True)
class GraphStore:
    """A graph in the folder ``path``; backend is one of BACKENDS."""

    spark: SparkSession
    path: str
    backend: str = "parquet"

    def __post_init__(self):
        if self.backend not in BACKENDS:
            raise ValueError(f"unknown backend {self.backend}; one of {', '.join(BACKENDS)}")

    def save(self, g: PropertyGraph) -> None:
        """Replaces the stored graph; csv keeps columns that are no arrays, maps or structs."""
        for name, df in (("vertices", g.vertices), ("edges", g.edges)):
            flat = df if self.backend != "csv" else df.select(*(c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))))
            flat.write.mode("overwrite").options(**({"header": True} if self.backend == "csv" else {})).format(self.backend).save(f"{self.path}/{name}")

    def load(self) -> PropertyGraph:
        read = self.spark.read.format(self.backend)
        if self.backend in ("json", "csv"):
            kinds = lambda names: ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in names)
            read = read.options(**({"header": True, "enforceSchema": False} if self.backend == "csv" else {}))
            return PropertyGraph(read.schema(kinds(VERTEX_COLUMNS)).load(f"{self.path}/vertices"), read.schema(kinds(EDGE_COLUMNS)).load(f"{self.path}/edges"))
        return PropertyGraph(read.load(f"{self.path}/vertices"), read.load(f"{self.path}/edges"))

    def merge(self, vertices: DataFrame, edges: DataFrame) -> None:
        """Vertices replace those of the same id, edges those of the same ends and type; the rest stays.

        The merged graph is written beside the store first, since its plan reads what it replaces.
        """
        g, key = self.load(), ["src", "dst", "type"]
        kept = g.edges.join(edges.select(*key).distinct(), key, "left_anti").select(*g.edges.columns)
        merged = PropertyGraph(g.upsert_vertices(vertices).vertices, kept.unionByName(edges, allowMissingColumns=True))
        work = Workspace(self.spark, "merge")
        self.save(PropertyGraph(work.save(merged.vertices, "vertices"), work.save(merged.edges, "edges")))
        work.drop_all_but()

    def counts(self) -> DataFrame:
        """table and n of both tables."""
        g = self.load()
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        return n(g.vertices, "vertices").unionByName(n(g.edges, "edges"))
