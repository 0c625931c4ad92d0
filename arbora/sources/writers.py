"""Exports of a graph: CSV, NDJSON, GraphML, arrays for graph learning, diagrams."""

from __future__ import annotations

import os
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import mermaid_id, mermaid_label
from ..model import COUPLING, PropertyGraph
from ..plans.rewrites import number_rows


def write_csv(g: PropertyGraph, path: str) -> None:
    flat = lambda df: df.select(*(c if not t.startswith(("array", "map", "struct")) else F.to_json(c).alias(c) for c, t in df.dtypes))
    flat(g.vertices).write.mode("overwrite").csv(f"{path}/nodes", header=True)
    flat(g.edges).write.mode("overwrite").csv(f"{path}/edges", header=True)


def write_ndjson(g: PropertyGraph, path: str) -> None:
    from .readers import record_stream

    record_stream(g).select(F.col("record").alias("value")).write.mode("overwrite").text(path)


def graphml_rows(g: PropertyGraph) -> DataFrame:
    """One XML element a row, scalar columns only; wrap them in a graphml/graph element."""
    scalar = lambda df: [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    vc, ec = scalar(g.vertices), scalar(g.edges)

    def nodes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"xml": [f'<node id="{escape(str(r["id"]))}">' + "".join(f'<data key="{c}">{escape(str(r[c]))}</data>' for c in vc if c != "id" and r[c] is not None) + "</node>" for r in p.to_dict("records")]})

    def edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"xml": [f'<edge source="{escape(str(r["src"]))}" target="{escape(str(r["dst"]))}">' + "".join(f'<data key="{c}">{escape(str(r[c]))}</data>' for c in ec if c not in ("src", "dst") and r[c] is not None) + "</edge>" for r in p.to_dict("records")]})

    return g.vertices.select(*vc).mapInPandas(nodes, "xml string").unionByName(g.edges.select(*ec).mapInPandas(edges, "xml string"))


def index_vertices(vertices: DataFrame) -> DataFrame:
    """id, index from 0 in order of id; no task sees all rows."""
    return number_rows(vertices.select("id").distinct(), ["id"], "index")


def edge_index(g: PropertyGraph) -> DataFrame:
    """src_index, dst_index, type, confidence without dangling edges."""
    i = index_vertices(g.vertices)
    e = g.edges.join(i.toDF("src", "src_index"), "src").join(i.toDF("dst", "dst_index"), "dst")
    return e.select("src_index", "dst_index", "type", "confidence")


def write_npz(g: PropertyGraph, features: DataFrame, path: str, max_rows: int = 5_000_000) -> None:
    """node_feat, edge_index, edge_type for graph learning on one machine; raises beyond max_rows edges (use write_csv there)."""
    e = edge_index(g)
    if e.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} edges")
    e = e.orderBy("src_index", "dst_index", "type").toPandas()
    f = features.join(index_vertices(g.vertices), "id").orderBy("index").select("features").toPandas()
    types = sorted(e["type"].unique())
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    np.savez(path, node_feat=np.array(f["features"].tolist()), edge_index=e[["src_index", "dst_index"]].to_numpy().T, edge_type=np.searchsorted(types, e["type"]), edge_type_names=np.array(types))


def community_diagram(g: PropertyGraph, members: DataFrame, max_nodes: int = 200) -> DataFrame:
    """(community, id, name) for a diagram: an equal share of max_nodes each, in order of id."""
    n = members.select(F.count_distinct("community").alias("k"))
    w = Window.partitionBy("community").orderBy("id")
    rows = g.vertices.select("id", "name").join(members, "id").withColumn("k", F.row_number().over(w)).crossJoin(F.broadcast(n.withColumnRenamed("k", "groups")))
    return rows.where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.lit(max_nodes) / F.col("groups")))).select("community", "id", "name")


def dependency_diagram(g: PropertyGraph, max_nodes: int = 100, least: float = 0.5) -> DataFrame:
    """Distinct coupling edges (src, dst, type) of confidence >= least, the first 3 * max_nodes."""
    e = g.edges.where(F.col("type").isin(*COUPLING) & (F.col("confidence") >= least)).select("src", "dst", "type").distinct()
    return e.orderBy("src", "dst", "type").limit(3 * max_nodes)


def hierarchy_diagram(g: PropertyGraph, least: float = 0.5, max_nodes: int = 100) -> DataFrame:
    """Inheritance edges that touch a class or interface, and overriding edges."""
    kinds = g.vertices.where(F.col("label").isin("Class", "Interface")).select("id")
    up = g.edges.where(F.col("type").isin("EXTENDS", "IMPLEMENTS") & (F.col("confidence") >= least))
    touch = up.join(kinds.toDF("src"), "src", "left_semi").select("src", "dst", "type").union(up.join(kinds.toDF("dst"), "dst", "left_semi").select("src", "dst", "type"))
    over = g.edges.where(F.col("type").isin("METHOD_OVERRIDES", "METHOD_IMPLEMENTS") & (F.col("confidence") >= least)).select("src", "dst", "type")
    return touch.unionByName(over).distinct().orderBy("src", "dst", "type").limit(max_nodes)


def process_diagram(steps: DataFrame) -> DataFrame:
    """(process, src, dst): consecutive steps; of several rows for a step the greatest id counts."""
    one = steps.groupBy("process", "step").agg(F.max("id").alias("id"))
    w = Window.partitionBy("process").orderBy("step")
    return one.select("process", F.col("id").alias("src"), F.lead("id").over(w).alias("dst")).where("dst is not null")


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """A flowchart line for each (src, dst, type)."""
    label = lambda c: F.concat(mermaid_id(F.col(c)), F.lit('["'), mermaid_label(F.col(c)), F.lit('"]'))
    return edges.select(F.concat(label("src"), F.lit(" -->|"), F.col("type"), F.lit("| "), label("dst")).alias("line"))


def node_link_rows(g: PropertyGraph) -> DataFrame:
    """id, record: one vertex with its properties and outgoing links as JSON, the node-link form that graph libraries read."""
    links = g.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("dst").alias("target"), "type", "confidence"))).alias("links"))
    both = g.vertices.join(links, "id", "left")
    return both.select("id", F.to_json(F.struct(*g.vertices.columns, F.coalesce("links", F.array().cast(links.schema["links"].dataType)).alias("links"))).alias("record"))


def read_node_link(rows: DataFrame, vertex_schema: str = "id string, label string, name string, file_path string") -> PropertyGraph:
    """The graph of node_link_rows again."""
    parsed = rows.select(F.from_json("record", f"{vertex_schema}, links array<struct<target:string,type:string,confidence:double>>").alias("r")).select("r.*")
    edges = parsed.select(F.col("id").alias("src"), F.explode("links").alias("l")).select("src", F.col("l.target").alias("dst"), "l.type", "l.confidence")
    return PropertyGraph(parsed.drop("links"), edges)


def adjacency_lists(g: PropertyGraph) -> DataFrame:
    """id, neighbours: distinct targets in order, for every vertex; edges to non-vertices are left out."""
    out = g.without_dangling().edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))
    return g.vertices.select("id").join(out, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))
