"""Motif counts and what they say about an architecture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_half_up
from ..model import MOTIF, PropertyGraph
from ..storage import Workspace

#: Neighbours of a vertex, in order of id, among which quads() looks, as its SQL twin does. The census has no such limit.
NEIGHBOURS = 30
MOTIF3, MOTIF4 = ("empty", "one_edge", "two_edge", "triangle"), ("chain", "star", "diamond", "cycle", "clique")


def _ordered(g: PropertyGraph) -> DataFrame:
    """Pairs directed from the vertex of lower degree (then smaller id), with both degrees: no vertex has many of them out, so hubs stay cheap."""
    pairs = g.undirected()
    d = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    e = pairs.join(d.toDF("a", "na").hint("merge"), "a").join(d.toDF("b", "nb").hint("merge"), "b")
    return e.where(F.struct("na", "a") < F.struct("nb", "b")).select("a", "b", "na", "nb")


def _triangles(g: PropertyGraph) -> DataFrame:
    """x, y, z, degrees: every triangle once and the sum of its vertices' degrees; x is the first in _ordered's order, y < z."""
    e = _ordered(g)
    wedge = e.toDF("x", "y", "nx", "ny").join(e.select(F.col("a").alias("x"), F.col("b").alias("z"), F.col("nb").alias("nz")).hint("merge"), "x").where("y < z")
    closing = e.select(F.least("a", "b").alias("y"), F.greatest("a", "b").alias("z"))
    return wedge.join(closing.hint("merge"), ["y", "z"]).select("x", "y", "z", (F.col("nx") + F.col("ny") + F.col("nz")).alias("degrees"))


def triangles(g: PropertyGraph) -> DataFrame:
    """(x, y, z) of every triangle, once."""
    return _triangles(g).select("x", "y", "z")


def triangle_counts(g: PropertyGraph) -> DataFrame:
    """id, n: triangles through each vertex, zeros included."""
    t = triangles(g).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return g.vertices.select("id").join(t, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def motif3(g: PropertyGraph, found: DataFrame | None = None) -> DataFrame:
    """One row, exact for any size: triples with no, one, two, three edges, from degrees and triangles (found, if at hand) alone."""
    pairs = g.undirected()
    d = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    sums = d.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("wedges"), F.coalesce(F.sum("d") / 2, F.lit(0.0)).alias("m"))
    t = (triangles(g) if found is None else found).agg(F.count(F.lit(1)).alias("t"))
    n = g.vertices.agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = n.crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(t))
    two = F.col("wedges") - 3 * F.col("t")
    single = F.col("m") * (F.col("n") - 2) - 2 * two - 3 * F.col("t")
    whole = F.col("n") * (F.col("n") - 1) * (F.col("n") - 2) / 6
    as_long = lambda c, name: F.round(c).cast("bigint").alias(name)
    return one.select(as_long(whole - single - two - F.col("t"), "empty"), as_long(single, "one_edge"), as_long(two, "two_edge"), as_long(F.col("t"), "triangle"), as_long(F.col("n"), "n_vertices"), as_long(F.col("m"), "n_edges"))


def quads(g: PropertyGraph, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Distinct four-vertex sets (a vertex and three of its first neighbours) with their edge count and shape."""
    pairs = g.undirected()
    w = Window.partitionBy("a").orderBy("b")
    few = pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= neighbours).groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("ns"))
    trio = few.select("a", F.posexplode("ns").alias("i", "b"), "ns").select("a", "b", F.posexplode(F.slice("ns", F.col("i") + 2, F.size("ns"))).alias("j", "c"), F.slice("ns", F.col("i") + 2, F.size("ns")).alias("ns"))
    trio = trio.select("a", "b", "c", F.explode(F.slice("ns", F.col("j") + 2, F.size("ns"))).alias("d"))
    sets = trio.select(F.sort_array(F.array("a", "b", "c", "d")).alias("q")).distinct()
    sides = F.array(*(F.struct(F.col("q")[i].alias("a"), F.col("q")[j].alias("b")) for i in range(4) for j in range(i + 1, 4)))
    e = sets.select("q", F.explode(sides).alias("s")).select("q", "s.*").join(pairs.hint("merge"), ["a", "b"])
    per = e.groupBy("q").agg(F.count(F.lit(1)).alias("n_edges"), F.collect_list(F.struct("a", "b")).alias("es"))
    top = F.array_max(F.transform("q", lambda v: F.size(F.filter("es", lambda x: (x["a"] == v) | (x["b"] == v)))))
    shape = F.when(F.col("n_edges") == 6, "clique").when(F.col("n_edges") == 5, "diamond").when((F.col("n_edges") == 4) & (top == 2), "cycle").when(F.col("n_edges") == 4, "diamond")
    shape = shape.when((F.col("n_edges") == 3) & (top == 3), "star").otherwise("chain")
    return per.select("q", "n_edges", shape.alias("shape"))


def motif4(g: PropertyGraph, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row: sets of four by shape."""
    return quads(g, neighbours).agg(*(F.count_if(F.col("shape") == s).alias(s) for s in MOTIF4))


def whole_motif4(g: PropertyGraph, found: DataFrame) -> DataFrame:
    """One row, exact for any size: motif4 with all neighbours of each vertex; found: the graph's _triangles.

    Stars, tailed triangles and diamonds are counted as subgraphs from degrees and triangles, cliques as pairs of triangles
    whose far ends meet; what larger shapes hold of smaller ones is then taken off. In chains and cycles no vertex has three
    neighbours, so both are 0.
    """
    pairs, t = g.undirected(), found.select("x", "y", "z")
    total = lambda c, name: F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(name)
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("d")).agg(total(F.expr("cast(d * (d - 1) div 2 as decimal(38,0))") * (F.col("d") - 2), "stars3"))
    tails = found.agg(total(F.col("degrees") - 6, "tails"))
    sides = t.select(F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in ("xy", "xz", "yz")))).alias("s"))
    twos = sides.groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("k")).agg(total(F.expr("k * (k - 1) div 2"), "twos"))
    far = t.join(t.toDF("x", "y", "w").hint("merge"), ["x", "y"]).where("z < w").groupBy(F.col("z").alias("a"), F.col("w").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    cliques = far.join(pairs.where("a < b").hint("merge"), ["a", "b"]).agg(total(F.col("k"), "clique"))
    one = stars.crossJoin(F.broadcast(tails)).crossJoin(F.broadcast(twos)).crossJoin(F.broadcast(cliques))
    near = F.col("twos") - 6 * F.col("clique")
    tailed = F.col("tails") - 4 * near - 12 * F.col("clique")
    star = F.col("stars3") / 3 - tailed - 2 * near - 4 * F.col("clique")
    shapes = {"chain": F.lit(0), "star": star, "diamond": tailed + near, "cycle": F.lit(0), "clique": F.col("clique")}
    return one.select(*(shapes[s].cast("bigint").alias(s) for s in MOTIF4))


def census(g: PropertyGraph) -> DataFrame:
    """One row: motif3, whole_motif4, n_vertices, n_edges over the dependency edges.

    The simple graph and its triangles are made and written once; no join sends a table of its size through the driver.
    """
    work, ids = Workspace(g.spark, "census"), g.vertices.select("id").hint("merge")
    e = g.of_types(*MOTIF).edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    d = PropertyGraph(g.vertices, work.save(e, "edges"))
    t = work.save(_triangles(d), "triangles")
    out = work.save(motif3(d, t).crossJoin(F.broadcast(whole_motif4(d, t))), "result")
    work.drop_all_but("result")
    return out


def typed_pairs(g: PropertyGraph) -> DataFrame:
    """key SourceLabel:TYPE:TargetLabel and how many edges have it."""
    labels = g.vertices.select("id", "label")
    e = g.edges.join(labels.toDF("src", "ls"), "src").join(labels.toDF("dst", "lt"), "dst")
    return e.groupBy(F.concat_ws(":", "ls", "type", "lt").alias("key")).agg(F.count(F.lit(1)).alias("n"))


# Patterns of typed edge counts as (name, least count, multiple of it that is certain, key patterns whose counts are added).
# A key that fits several of a pattern's entries counts for each.
TYPED_PATTERNS = (
    ("Controller-Fat", 6, 3, ("^Class:CALLS:", "^Class:CALLS:Method")),
    ("Inheritance-Deep", 8, 2, ("^Class:EXTENDS:",)),
    ("Callback-Hell", 8, 3, ("^Function:CALLS:Function", "^Function:CALLS:Method", "^Method:CALLS:Function", "^Method:CALLS:Method")),
    ("Interface-Segregation-Violation", 8, 2, ("^Interface:HAS_METHOD:",)),
    ("Circular-Import", 3, 2, ("^Module:IMPORTS:",)),
    ("Cross-Cutting-Concern", 6, 2, (":DECORATES:", ":USES:")),
)
DATA_CLUMP, LEAST_TYPED = 4, 5


def typed_patterns(pairs: DataFrame) -> DataFrame:
    """name, confidence, total of the typed patterns that counts by key (key, n) show; none under LEAST_TYPED edges.

    Data-Clump needs DATA_CLUMP uses among classes, or of anything by classes; its total adds both.
    """
    key, n = F.col("key"), F.col("n")
    total = lambda *parts: sum((F.coalesce(F.sum(F.when(key.rlike(p), n)), F.lit(0)) for p in parts), F.lit(0))
    one = lambda name, t, least, sure: F.when(t >= least, F.struct(F.lit(name).alias("name"), F.least(F.lit(1.0), t / F.lit(float(sure))).alias("confidence"), t.cast("bigint").alias("total")))
    sums = pairs.agg(F.sum("n").alias("every"), total("^Class:USES:").alias("uses"), total("^Class:USES:Class").alias("among"), *(total(*parts).alias(f"t{k}") for k, (_, _, _, parts) in enumerate(TYPED_PATTERNS)))
    both = F.col("uses") + F.col("among")
    clump = F.when(F.greatest("uses", "among") >= DATA_CLUMP, one("Data-Clump", both, 0, DATA_CLUMP * 2))
    found = [clump, *(one(name, F.col(f"t{k}"), least, least * sure) for k, (name, least, sure, _) in enumerate(TYPED_PATTERNS))]
    return sums.where(F.col("every") >= LEAST_TYPED).select(F.explode(F.array_compact(F.array(*found))).alias("p")).select("p.*")


def typed_triangles(g: PropertyGraph) -> DataFrame:
    """key: sorted labels joined by colons, a bar, sorted edge types joined by dashes; the smallest type counts per pair."""
    kinds = g.edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("type").alias("type"))
    t = triangles(g).withColumn("v", F.sort_array(F.array("x", "y", "z")))
    t = t.select("v", F.explode(F.array(*(F.struct(F.col("v")[i].alias("a"), F.col("v")[j].alias("b")) for i, j in ((0, 1), (0, 2), (1, 2))))).alias("s")).select("v", "s.*").join(kinds, ["a", "b"])
    t = t.groupBy("v").agg(F.array_join(F.sort_array(F.collect_list("type")), "-").alias("types"))
    named = t.select("v", "types", F.explode("v").alias("id")).join(g.vertices.select("id", "label"), "id").groupBy("v", "types").agg(F.array_join(F.sort_array(F.collect_list("label")), ":").alias("labels"))
    return named.groupBy(F.concat_ws("|", "labels", "types").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def ratios(profile: DataFrame) -> DataFrame:
    """Adds total3, total4 and each motif's share as <name>_ratio (0 for empty totals)."""
    out = profile.withColumn("total3", sum((F.col(c) for c in MOTIF3), F.lit(0))).withColumn("total4", sum((F.col(c) for c in MOTIF4), F.lit(0)))
    share = lambda c, t: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(t).cast("double")), F.lit(0.0))
    return out.withColumns({f"{c}_ratio": share(c, "total3") for c in MOTIF3} | {f"{c}_ratio": share(c, "total4") for c in MOTIF4})


def architecture_patterns(profile: DataFrame) -> DataFrame:
    """name, confidence of every rule that the motif shares meet; one fallback row if none does."""
    r = ratios(profile)
    chain, star, diamond, cycle, clique = (F.col(f"{c}_ratio") for c in MOTIF4)
    triangle, two = F.col("triangle_ratio"), F.col("two_edge_ratio")
    none = (F.col("total3") == 0) & (F.col("total4") == 0)
    # Thresholds and factors of the pattern rules.
    rules = [
        ("Layered", (chain > 0.35) & (star < 0.3), chain * 1.5),
        ("Microservices", star > 0.3, star * 1.5),
        ("Event-driven", (star > 0.2) & (diamond > 0.2), (star + diamond) * 0.8),
        ("MVC / Layered with diamonds", (diamond > 0.3) & (star < 0.25), diamond * 1.3),
        ("Monolithic", (triangle > 0.3) | (clique > 0.2), F.greatest(triangle, clique) * 1.5),
        ("Modular", (F.col("total4") > 0) & star.between(0.1000001, 0.3499999) & chain.between(0.1000001, 0.3999999) & (clique < 0.15) & (cycle < 0.2), (1 - F.abs(star - chain)) * 1.2),
        ("Circular dependencies", cycle > 0.2, cycle * 2),
        ("High coupling", (two > 0.6) & (F.col("total3") > 10), two),
    ]
    hits = F.filter(F.array(*(F.when(cond & ~none, F.struct(F.lit(name).alias("name"), F.least(F.lit(1.0), c).alias("confidence"))) for name, cond, c in rules)), lambda x: x.isNotNull())
    single = lambda name, c: F.array(F.struct(F.lit(name).alias("name"), F.lit(c).alias("confidence")))
    return r.select(F.explode(F.when(none, single("Insufficient data", 1.0)).when(F.size(hits) == 0, single("No dominant pattern", 0.5)).otherwise(hits)).alias("p")).select("p.*")


def architecture_health(profile: DataFrame, community_sizes: DataFrame, degrees: DataFrame | None = None) -> DataFrame:
    """One row: cohesion, modularity, complexity (3 digits), number of findings by severity, score 0 to 100.

    community_sizes: (community, n); degrees: (id, n) of the undirected simple graph, for god modules (over 20).
    """
    sizes = community_sizes.agg(F.count(F.lit(1)).alias("k"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    r = ratios(profile).crossJoin(F.broadcast(sizes))
    if degrees is not None:
        r = r.crossJoin(F.broadcast(degrees.agg(F.count_if(F.col("n").between(21, 40)).alias("god_warn"), F.count_if(F.col("n") > 40).alias("god_crit"))))
    else:
        r = r.withColumns({"god_warn": F.lit(0), "god_crit": F.lit(0)})
    n, e = F.col("n_vertices"), F.col("n_edges")
    cohesion = F.coalesce(F.try_divide(F.col("triangle") * 3.0 + F.col("two_edge") * 2.0, F.col("total3") * 3.0), F.lit(0.0))
    balance = F.when(F.col("mean") > 0, 1 - F.least(F.lit(1.0), F.when(F.col("k") > 1, F.col("sd")).otherwise(0.0) / F.col("mean"))).otherwise(0.0)
    factor = F.least(F.lit(1.0), F.col("k") / F.greatest(F.lit(1.0), F.sqrt(n)))
    modularity = F.when(F.col("k") > 0, factor * 0.6 + balance * 0.4).otherwise((1 - cohesion) * 0.5)
    density = F.when(n > 1, e / (n * (n - 1) / 2)).otherwise(0.0)
    complexity = F.least(F.lit(1.0), density * 0.4 + F.col("clique_ratio") * 0.3 + F.col("cycle_ratio") * 0.3)
    flag = lambda cond: cond.cast("int")
    cyc, tri, clq = F.col("cycle_ratio"), F.col("triangle_ratio"), F.col("clique_ratio")
    many3, many4 = F.col("total3") > 10, F.col("total4") > 5
    critical = F.col("god_crit") + flag((cyc > 0.3) & many4) + flag((tri > 0.5) & many3) + flag((clq > 0.35) & many4)
    warning = F.col("god_warn") + flag((cyc > 0.15) & (cyc <= 0.3) & many4) + flag((tri > 0.3) & (tri <= 0.5) & many3) + flag((clq > 0.2) & (clq <= 0.35) & many4)
    info = flag((F.col("empty_ratio") > 0.5) & many3)
    raw = 100 - F.when(cohesion > 0.5, (cohesion - 0.5) * 40).otherwise(0.0) - complexity * 25 + modularity * 20 - 10 * critical - 5 * warning - info
    empty = n == 0
    score = F.when(empty, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(raw + 0.5).cast("double"))))
    three = lambda c, name: round_half_up(c, 3).alias(name)
    return r.select(three(cohesion, "cohesion"), three(F.when(empty, 1.0).otherwise(modularity), "modularity"), three(complexity, "complexity"), critical.cast("bigint").alias("n_critical"), warning.cast("bigint").alias("n_warning"), info.cast("bigint").alias("n_info"), score.alias("score"))


# Typed smells as (name, source label, edge type, limit, critical over).
TYPED_SMELLS = (("God Controller", "Class", "CALLS", 15, 30), ("Interface Bloat", "Interface", "HAS_METHOD", 10, 20))


def typed_smells(g: PropertyGraph, property_limit: int = 5, call_limit: int = 1) -> DataFrame:
    """name, id, n, severity: classes with too many calls, bloated interfaces, data classes (many properties, hardly a call)."""
    n = g.edges.groupBy("src", "type").agg(F.count(F.lit(1)).alias("n")).join(g.vertices.select(F.col("id").alias("src"), "label"), "src")
    out = None
    for name, label, kind, limit, critical in TYPED_SMELLS:
        hit = n.where((F.col("label") == label) & (F.col("type") == kind) & (F.col("n") > limit))
        hit = hit.select(F.lit(name).alias("name"), F.col("src").alias("id"), "n", F.when(F.col("n") > critical, "critical").otherwise("warning").alias("severity"))
        out = hit if out is None else out.unionByName(hit)
    wide = n.where("label = 'Class'").groupBy("src").agg(F.sum(F.when(F.col("type") == "HAS_PROPERTY", F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("type") == "CALLS", F.col("n")).otherwise(0)).alias("c"))
    data = wide.where((F.col("p") >= property_limit) & (F.col("c") <= call_limit)).select(F.lit("Data Class").alias("name"), F.col("src").alias("id"), F.col("p").alias("n"), F.when(F.col("p") > 10, "warning").otherwise("info").alias("severity"))
    return out.unionByName(data)


def inheritance_depth(g: PropertyGraph, max_depth: int = 50) -> DataFrame:
    """id, depth: the longest chain of EXTENDS edges from each vertex, cut at max_depth on cycles."""
    work = Workspace(g.spark, "inheritance")
    e = work.save(g.edges.where("type = 'EXTENDS' and src <> dst").select("src", "dst").distinct(), "edges")
    state = e.select(F.col("src").alias("id")).distinct().withColumn("depth", F.lit(1))
    for k in range(2, max_depth + 1):
        up = e.join(state.select(F.col("id").alias("dst"), "depth"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("depth").alias("below"))
        new = work.save(state.join(up, "id", "left").select("id", F.greatest("depth", F.coalesce(F.col("below") + 1, F.lit(0))).alias("depth"), F.col("depth").alias("was")), f"state-{k}")
        grown = new.where("depth > was").isEmpty()
        state = new.select("id", "depth")
        if grown:
            break
    return state.select("id", F.least("depth", F.lit(max_depth)).cast("bigint").alias("depth"))


def shotgun_surgery(g: PropertyGraph, members: DataFrame) -> DataFrame:
    """n_calls, n_across, share, severity: calls that cross communities; a finding over 30 % of more than 20 calls."""
    e = g.edges.where("type = 'CALLS'").join(members.toDF("src", "cs"), "src").join(members.toDF("dst", "cd"), "dst")
    s = e.agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("cs") != F.col("cd")).alias("n_across"))
    share = F.coalesce(F.try_divide(F.col("n_across").cast("double"), F.col("n_calls").cast("double")), F.lit(0.0))
    found = (share > 0.3) & (F.col("n_calls") > 20)
    return s.select("n_calls", "n_across", share.alias("share"), F.when(found & (share > 0.5), "critical").when(found, "warning").otherwise("none").alias("severity"))
