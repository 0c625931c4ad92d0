"""Degrees, coupling and architecture metrics, coverage roll-ups, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import noisy_or, round_half_up
from ..model import PropertyGraph


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def degrees(g: PropertyGraph) -> DataFrame:
    """id, n_in, n_out, n_total; parallel edges count each; vertices without edges have zeros.

    One pass: every edge gives an in and an out row, summed before the shuffle.
    """
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return g.vertices.select("id").join(d, "id", "left").select("id", zero("n_in"), zero("n_out"), (F.coalesce("n_in", F.lit(0)) + F.coalesce("n_out", F.lit(0))).alias("n_total"))


def hubs(g: PropertyGraph, least_in: int = 3, least_out: int = 3, only_hubs: bool = False) -> DataFrame:
    """Fan-in, fan-out, instability and class of every vertex; only_hubs keeps the classes that are hubs."""
    d = degrees(g)
    kind = F.when((F.col("n_in") >= least_in) & (F.col("n_out") >= least_out), "god-module").when(F.col("n_in") >= least_in, "hub").when(F.col("n_out") >= least_out, "dependent").otherwise("isolated")
    out = d.select("id", F.col("n_in").alias("fan_in"), F.col("n_out").alias("fan_out"), F.when(F.col("n_total") > 0, F.col("n_out") / F.col("n_total")).otherwise(0.0).alias("instability"), kind.alias("kind"))
    return out.where("kind in ('god-module', 'hub')") if only_hubs else out


def martin_metrics(g: PropertyGraph) -> DataFrame:
    """Ca, Ce, instability I, abstractness A (1 for abstract labels) and distance |A + I - 1|."""
    d = degrees(g).join(g.vertices.select("id", "label"), "id")
    abstract = F.when(F.col("label").rlike("(?i)interface|abstract"), 1.0).otherwise(0.0)
    unstable = F.when(F.col("n_total") > 0, F.col("n_out") / F.col("n_total")).otherwise(0.0)
    return d.select("id", F.col("n_in").alias("ca"), F.col("n_out").alias("ce"), unstable.alias("instability"), abstract.alias("abstractness"), F.abs(abstract + unstable - 1).alias("distance"))


def spectral(g: PropertyGraph) -> DataFrame:
    """One row: counts, density, entropy of the out-degree histogram (bits), average and greatest out-degree."""
    d = degrees(g)
    hist = d.groupBy("n_out").agg(F.count(F.lit(1)).alias("c"))
    total = d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_out"), F.lit(0)).alias("e"), F.coalesce(F.max("n_out"), F.lit(0)).alias("max_degree"))
    entropy = hist.crossJoin(F.broadcast(total.select("n"))).agg(F.sum(-(F.col("c") / F.col("n")) * F.log2(F.col("c") / F.col("n"))).alias("entropy"))
    n, e = F.col("n"), F.col("e")
    density = F.when(n > 1, F.least(F.lit(1.0), e / (n * (n - 1)).cast("double"))).otherwise(0.0)
    average = F.when(n > 0, e / n).otherwise(0.0)
    return total.crossJoin(F.broadcast(entropy)).select(n.alias("n_vertices"), e.alias("n_edges"), density.alias("density"), F.coalesce("entropy", F.lit(0.0)).alias("entropy"), average.alias("avg_degree"), "max_degree")


def topology(metrics: DataFrame) -> DataFrame:
    """Adds topology and its confidence: a hub over half of a thin graph is a star, else sparse graphs are trees; a dense mesh overrides both."""
    n, e, top = F.col("n_vertices"), F.col("n_edges"), F.col("max_degree")
    sure = lambda cond: F.when(cond, 0.9).otherwise(0.7)
    rules = (
        ("mesh-like", (F.col("density") > 0.3) & (F.col("avg_degree") > 5), sure(F.col("density") > 0.5)),
        ("star-like", (n > 1) & (top >= n * 0.5) & (F.col("avg_degree") < 3), sure(top >= n * 0.8)),
        ("tree-like", (n > 1) & ((e <= n - 1) | (F.col("density") < 0.1)), sure(e <= n - 1)),
    )
    kind, confidence = F.lit("hybrid"), F.lit(0.5)
    for name, holds, c in reversed(rules):
        kind, confidence = F.when(holds, name).otherwise(kind), F.when(holds, c).otherwise(confidence)
    return metrics.withColumn("topology", kind).withColumn("topology_confidence", confidence)


def cohesion(g: PropertyGraph, members: DataFrame) -> DataFrame:
    """Per community: coupling edges inside / all that touch it; an edge across counts once on each side."""
    s, t = members.toDF("src", "cs"), members.toDF("dst", "ct")
    e = g.edges.join(s, "src").join(t, "dst")
    sides = e.select(F.explode(F.array_distinct(F.array("cs", "ct"))).alias("community"), (F.col("cs") == F.col("ct")).cast("int").alias("inside"))
    return sides.groupBy("community").agg(F.sum("inside").cast("bigint").alias("n_inside"), F.count(F.lit(1)).alias("n_touching"), F.avg("inside").alias("cohesion"))


def modularity_weighted(g: PropertyGraph, members: DataFrame) -> DataFrame:
    """Q of the undirected graph with summed confidences: sum over communities of in/m - (tot/m)^2, m both directions."""
    half = g.edges.where("src <> dst")
    w = half.select("src", "dst", "confidence").unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    e = w.join(members.toDF("src", "cs"), "src").join(members.toDF("dst", "ct"), "dst")
    per = e.groupBy("cs").agg(F.sum("confidence").alias("tot"), F.sum(F.when(F.col("cs") == F.col("ct"), F.col("confidence")).otherwise(0.0)).alias("inside"))
    m = per.agg(F.sum("tot").alias("m"))
    return per.crossJoin(F.broadcast(m)).agg(F.coalesce(F.sum(F.col("inside") / F.col("m") - (F.col("tot") / F.col("m")) * (F.col("tot") / F.col("m"))), F.lit(0.0)).alias("modularity"))


def modularity_directed(g: PropertyGraph, members: DataFrame) -> DataFrame:
    """Q over the directed listing with 2E; a vertex without a community is its own."""
    d = degrees(g).join(members, "id", "left").withColumn("community", F.coalesce("community", F.concat(F.lit("self:"), F.col("id"))))
    own = d.select("id", "community")
    e = g.edges.join(own.toDF("src", "cs"), "src").join(own.toDF("dst", "ct"), "dst")
    inside = e.where("cs = ct").groupBy(F.col("cs").alias("community")).agg((2 * F.count(F.lit(1))).alias("inside"))
    per = d.groupBy("community").agg(F.sum("n_total").alias("tot")).join(inside, "community", "left")
    m = g.edges.agg((2.0 * F.count(F.lit(1))).alias("m"))
    q = F.coalesce("inside", F.lit(0)) / F.col("m") - (F.col("tot") / F.col("m")) * (F.col("tot") / F.col("m"))
    return per.crossJoin(F.broadcast(m)).agg(F.sum(q).alias("modularity"))


def fused_confidence(paths: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Noisy-or of the evidence rows of each key."""
    return paths.groupBy(key).agg(noisy_or(F.col(p)).alias("p"))


def coverage_rollup(g: PropertyGraph, status: DataFrame, members: DataFrame) -> DataFrame:
    """Per community: vertices by status (id, status), share covered, edges with both ends covered of those inside it or across.

    An edge counts for its target's community and, if another, for its source's.
    """
    v = status.join(members, "id").groupBy("community").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "covered").alias("n_covered"), F.count_if(F.col("status") == "partial").alias("n_partial"), F.count_if(F.col("status") == "uncovered").alias("n_uncovered")
    )
    own = members.join(status, "id").select("id", "community", (F.col("status") == "covered").alias("cov"))
    e = g.edges.join(own.toDF("src", "cs", "vs"), "src").join(own.toDF("dst", "ct", "vt"), "dst")
    sides = e.select(F.explode(F.array_distinct(F.array("ct", "cs"))).alias("community"), (F.col("vs") & F.col("vt")).cast("int").alias("both"))
    edges = sides.groupBy("community").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("both").cast("bigint").alias("n_edges_covered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return v.join(edges, "community", "left").select("community", "n", "n_covered", "n_partial", "n_uncovered", (100 * F.col("n_covered") / F.col("n")).alias("share"), zero("n_edges"), zero("n_edges_covered"))


def coverage_gaps(g: PropertyGraph, status: DataFrame, least_in: int = 2, per: DataFrame | None = None, top: int = 5) -> DataFrame:
    """Uncovered vertices with in-degree >= least_in; with per (id, community), the first ``top`` of each community."""
    d = degrees(g).join(status.where("status = 'uncovered'").select("id"), "id", "left_semi").where(F.col("n_in") >= least_in)
    if per is None:
        return d.select("id", "n_in")
    w = Window.partitionBy("community").orderBy(F.desc("n_in"), "id")
    return d.join(per, "id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("community", "rank", "id", "n_in")


def trend(snapshots: DataFrame, at: str, value: str) -> DataFrame:
    """Linear regression over the index 0..n-1 in order of ``at``: slope, r2, projection at n (0 to 100), direction."""
    rows = snapshots.select(F.struct(F.col(at), F.col(value).cast("double").alias("y")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("ss")).select(F.posexplode("ss").alias("x", "s")).select("x", F.col("s.y").alias("y"))
    fit = rows.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    slope = F.coalesce("slope", F.lit(0.0))
    projected = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("intercept", F.lit(0.0)) + slope * F.col("n")))
    return fit.select("n", slope.alias("slope"), F.coalesce("r2", F.lit(0.0)).alias("r2"), projected.alias("projected"), F.when(F.abs(slope) < 0.5, "stable").when(slope > 0, "improving").otherwise("declining").alias("direction"))


def delta_trend(snapshots: DataFrame, at: str, value: str, tolerance: float = 0.05) -> DataFrame:
    """First against last snapshot."""
    d = snapshots.agg((F.max_by(value, at) - F.min_by(value, at)).alias("delta"))
    return d.withColumn("direction", F.when(F.col("delta") > tolerance, "improving").when(F.col("delta") < -tolerance, "declining").otherwise("stable"))


def snapshot_diff(snapshots: DataFrame, key: str, a, b, columns: list[str]) -> DataFrame:
    """Signed differences b - a of two snapshots."""
    one = lambda k, side: snapshots.where(F.col(key) == F.lit(k)).select(*(F.col(c).alias(f"{c}_{side}") for c in columns))
    return one(a, "a").crossJoin(F.broadcast(one(b, "b").limit(1))).select(*((F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"{c}_delta") for c in columns))


def shared_libraries(imports: DataFrame, least_repos: int = 2, max_files: int = 50) -> DataFrame:
    """Imports (repo, file_path, import_path) used by several repos; internal if the path starts with . or @."""
    g = imports.groupBy("import_path").agg(F.count_distinct("repo").alias("n_repos"), F.sort_array(F.collect_set("repo")).alias("repos"), F.count_distinct("file_path").alias("n_files"))
    w = Window.partitionBy("import_path").orderBy("file_path")
    files = imports.select("import_path", "file_path").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_files).groupBy("import_path").agg(F.sort_array(F.collect_list("file_path")).alias("files"))
    return g.where(F.col("n_repos") >= least_repos).join(files, "import_path").withColumn("internal", F.col("import_path").rlike(r"^[.@]"))


def super_nodes(g: PropertyGraph, members: DataFrame) -> DataFrame:
    """Per community: summed inner confidence, edges out or in, entry points (hit from outside), dominant label."""
    v = g.vertices.select("id", "label").join(members, "id")
    labels = v.groupBy("community", "label").agg(F.count(F.lit(1)).alias("c"))
    dominant = labels.groupBy("community").agg(F.sum("c").alias("n"), F.max_by("label", F.struct("c", F.col("label"))).alias("dominant_label"))
    e = g.edges.join(members.toDF("src", "cs"), "src").join(members.toDF("dst", "ct"), "dst")
    inner = e.where("cs = ct").groupBy(F.col("cs").alias("community")).agg(F.sum("confidence").alias("inner_weight"))
    across = e.where("cs <> ct").select(F.explode(F.array("cs", "ct")).alias("community")).groupBy("community").agg(F.count(F.lit(1)).alias("n_external"))
    entries = e.where("cs <> ct").groupBy(F.col("ct").alias("community")).agg(F.count_distinct("dst").alias("n_entry_points"))
    out = dominant.join(inner, "community", "left").join(across, "community", "left").join(entries, "community", "left")
    return out.select("community", "n", "dominant_label", F.coalesce("inner_weight", F.lit(0.0)).alias("inner_weight"), F.coalesce("n_external", F.lit(0)).alias("n_external"), F.coalesce("n_entry_points", F.lit(0)).alias("n_entry_points"))


def meta_edges(g: PropertyGraph, members: DataFrame) -> DataFrame:
    """Undirected edges between communities, weights of both directions summed."""
    e = g.edges.join(members.toDF("src", "cs"), "src").join(members.toDF("dst", "ct"), "dst").where("cs <> ct")
    return e.groupBy(F.least("cs", "ct").alias("a"), F.greatest("cs", "ct").alias("b")).agg(F.sum("confidence").alias("weight"), F.count(F.lit(1)).alias("n"))


def property_groups(vertices: DataFrame, columns: list[str]) -> DataFrame:
    """(label, property): properties with at least one value under the label."""
    g = vertices.groupBy("label").agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in columns))
    return g.select("label", F.explode(F.filter(F.array(*(F.when(F.col(c), F.lit(c)) for c in columns)), lambda x: x.isNotNull())).alias("property"))


def standardize(rows: DataFrame, columns: list[str], method: str = "zscore") -> DataFrame:
    """z-scores by population deviation, or min-max; a constant column becomes 0. Statistics are one row."""
    pick = (lambda c: (F.avg(c), F.stddev_pop(c))) if method == "zscore" else (lambda c: (F.min(c), F.max(c) - F.min(c)))
    stats = rows.agg(*(x.cast("double").alias(f"_{k}_{c}") for c in columns for k, x in zip("ms", pick(c))))
    out = rows.crossJoin(F.broadcast(stats))
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).select(*rows.columns)


def key_symbols(g: PropertyGraph, members: DataFrame, top: int = 5) -> DataFrame:
    """The vertices of each community with most edges inside it."""
    e = g.edges.join(members.toDF("src", "cs"), "src").join(members.toDF("dst", "ct"), "dst").where("cs = ct")
    n = e.select(F.col("cs").alias("community"), F.explode(F.array("src", "dst")).alias("id")).groupBy("community", "id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("community").orderBy(F.desc("n"), "id")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def risk_of_change(n_symbols: int | object, n_processes: object):
    """high over 3 processes, medium over 0, unknown if only symbols changed, else low."""
    return F.when(n_processes > 3, "high").when(n_processes > 0, "medium").when(n_symbols > 0, "unknown").otherwise("low")


def rounded(rows: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return rows.withColumns({c: round_half_up(F.col(c), digits) for c in columns})
