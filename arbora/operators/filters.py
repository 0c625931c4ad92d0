"""Projections, filters and predicates."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import basename
from ..model import STRUCTURAL, PropertyGraph

SYMBOL = ("id", "label", "name", "file_path")


def by_label(vertices: DataFrame, label: str) -> DataFrame:
    return vertices.where(F.col("label") == label).select(*SYMBOL)


def by_property(vertices: DataFrame, key: str, value: Any) -> DataFrame:
    """Strict equality; a missing property never equals."""
    return vertices.where(F.coalesce(F.col(key) == F.lit(value), F.lit(False)))


_COMPARE = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def compile_filter(spec: dict[str, Any]) -> Column:
    """Null means is-null, a scalar equality, an object gt/gte/lt/lte over numbers (others fail); keys are and-ed; {} is true."""
    tests = []
    for key, want in spec.items():
        c = F.col(key)
        if want is None:
            tests.append(c.isNull())
        elif isinstance(want, dict):
            number = c.try_cast("double")
            tests += [F.coalesce(getattr(number, _COMPARE[op])(F.lit(float(v))), F.lit(False)) for op, v in want.items()]
        else:
            tests.append(F.coalesce(c == F.lit(want), F.lit(False)))
    return reduce(and_, tests, F.lit(True))


def match_vertices(vertices: DataFrame, label: str | None = None, name: str | None = None, id: str | None = None) -> DataFrame:
    wanted = {k: v for k, v in (("label", label), ("name", name), ("id", id)) if v is not None}
    return vertices.where(compile_filter(wanted))


def resolve_symbol(vertices: DataFrame, symbol: str, kind: str | None = None, path: str | None = None) -> DataFrame:
    """Candidates by id or name with relevance: id 1.0, kind 0.9, path part 0.7, else 0.5; kind and path also filter."""
    found = vertices.where((F.col("id") == symbol) | (F.col("name") == symbol))
    if kind:
        found = found.where(F.col("label") == kind)
    if path:
        found = found.where(F.contains("file_path", F.lit(path)))
    rank = F.when(F.col("id") == symbol, 1.0)
    rank = rank.when(F.lit(bool(kind)), 0.9).when(F.lit(bool(path)), 0.7).otherwise(0.5)
    many = found.agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return found.select(*SYMBOL, rank.alias("relevance")).crossJoin(F.broadcast(many))


def confident(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("confidence") >= least)


def non_structural(vertices: DataFrame) -> DataFrame:
    return vertices.where(~F.col("label").isin(*STRUCTURAL))


def project(vertices: DataFrame, wanted: list[str]) -> DataFrame:
    """Unknown columns come out null."""
    return vertices.select(*(F.col(c) if c in vertices.columns else F.lit(None).cast("string").alias(c) for c in wanted))


def grep(texts: DataFrame, id_col: str, text_col: str, pattern: str, limit: int = 50, ignore_case: bool = True) -> DataFrame:
    """Lines that match: id, line (from 1), text trimmed and cut to 200 characters, in order of id and line."""
    if len(pattern) > 200:
        raise ValueError("the pattern is longer than 200 characters")
    re.compile(pattern)
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "raw"))
    hits = lines.where(F.col("raw").rlike(("(?i)" if ignore_case else "") + pattern))
    return hits.select("id", (F.col("at") + 1).cast("long").alias("line"), F.substring(F.trim("raw"), 1, 200).alias("text")).orderBy("id", "line").limit(max(1, min(limit, 200)))


def in_service(vertices: DataFrame, service: str) -> DataFrame:
    return vertices.where(F.startswith("file_path", F.lit(service.strip("/"))))


def ui_view(g: PropertyGraph, max_nodes: int = 200, max_edges: int = 400) -> PropertyGraph:
    """The first vertices that are neither files nor folders, and edges among them without CONTAINS."""
    v = g.vertices.where(~F.col("label").isin("File", "Folder")).orderBy("id").limit(max_nodes)
    e = PropertyGraph(v, g.edges.where("type <> 'CONTAINS'")).without_dangling().edges
    return PropertyGraph(v, e.orderBy("src", "dst", "type", "confidence").limit(max_edges))


ENTRY_FILES = r"(?i)^(main|index|app|server|cli|start|__main__)\.[a-z]+$"


def entry_points(g: PropertyGraph, least: float = 0.5) -> DataFrame:
    """Functions and methods by the sum of ten hints from name, path, export, role and calls; those over ``least``."""
    calls = g.edges.where("type = 'CALLS'")
    out = calls.groupBy("src").agg(F.count(F.lit(1)).alias("n_out")).withColumnRenamed("src", "id")
    into = calls.groupBy("dst").agg(F.count(F.lit(1)).alias("n_in")).withColumnRenamed("dst", "id")
    role = lambda end, *types: g.edges.where(F.col("type").isin(*types)).select(F.col(end).alias("id")).distinct()
    handles = role("dst", "HANDLES_ROUTE", "HANDLES_TOOL").withColumn("handler", F.lit(True))
    wraps = role("src", "WRAPS").withColumn("wraps", F.lit(True))
    fetches = role("src", "FETCHES").withColumn("fetches", F.lit(True))
    any_call = calls.limit(1).agg((F.count(F.lit(1)) > 0).alias("any_call"))
    v = g.vertices.where(F.col("label").isin("Function", "Method"))
    for extra in (out, into, handles, wraps, fetches):
        v = v.join(extra, "id", "left")
    v = v.crossJoin(F.broadcast(any_call))
    name, path = F.coalesce("name", F.lit("")), F.coalesce("file_path", F.lit(""))
    depth = F.size(F.split(path, "/")) - 1
    give = lambda cond, points: F.when(cond, points).otherwise(0.0)
    score = (
        give(F.col("handler").isNotNull(), 0.9)
        + F.when(name.rlike("(?i)^(main|start|init|run)$"), 0.6).when(name.rlike("(?i)^(handle|process|serve|execute)"), 0.5).otherwise(0.0)
        + give(basename(path).rlike(ENTRY_FILES), 0.4)
        + F.when(depth == 1, 0.3).when(depth == 2, 0.2).when(depth == 3, 0.1).otherwise(0.0)
        + give(path.rlike(r"(?i)routes?\b|api\b|handler|command"), 0.3)
        + (give(F.coalesce("is_exported", F.lit(False)), 0.3) if "is_exported" in v.columns else F.lit(0.0))
        + give(F.col("any_call") & F.col("n_in").isNull(), 0.3)
        + give(F.coalesce("n_out", F.lit(0)) >= 3, 0.2)
        + give(F.col("wraps").isNotNull(), 0.5)
        + give(F.col("fetches").isNotNull(), 0.5)
    )
    return v.select("id", F.round(score, 6).alias("score")).where(F.col("score") > least)
