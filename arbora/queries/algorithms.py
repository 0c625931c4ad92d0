"""Graph algorithms. Twins of loops are unrolled to the same number of steps, or recursive."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..features import matrices as L
from ..functions.scalar import EDGE_DECAY, OTHER_DECAY
from ..operators import aggregates as A
from ..operators import centrality as C
from ..operators import clones as W
from ..operators import community as G
from ..operators import components as K
from ..operators import embed as E
from ..operators import filters as P
from ..operators import motifs as M
from ..operators import traverse as T
from ..storage import Workspace
from . import query
from .relational import COMMERCE, DEG, PARTS, SNAPSHOTS, TRADE

UND = "u as (select src as a, dst as b from e where src <> dst union select dst, src from e where src <> dst)"


def bfs_sql(edges: str, seeds: str, depth: int, group: bool = False) -> str:
    """CTEs l0..ld and the union ``r`` of (id, depth) for searches over edges (src, dst); group adds a column g."""
    g, on = ("g, ", " and o.g = n.g") if group else ("", "")
    parts = [f"l0 as (select {g}id, 0 as depth from ({seeds}))"]
    for k in range(1, depth + 1):
        seen = " union all ".join(f"select {g}id from l{j}" for j in range(k))
        parts.append(f"l{k} as (select distinct {g}id, {k} as depth from (select l.{g if group else ''} x.dst as id from l{k - 1} l join {edges} x on l.id = x.src) n where not exists (select 1 from ({seen}) o where o.id = n.id{on}))".replace("select l.g,  x", "select l.g, x").replace("select l. x", "select x"))
    return ", ".join(parts) + ", r as (" + " union all ".join(f"select {g}id, depth from l{k}" for k in range(depth + 1)) + ")"


IMPACT = f"{COMMERCE}, f as (select dst as src, src as dst from e where confidence >= 0.3), {bfs_sql('f', 'select id from v where id = ' + chr(39) + 'part:7' + chr(39), 4)}"


@query("g24_impact", f"{IMPACT} select r.id, depth, label, name, file_path from r join v on r.id = v.id where depth > 0")
def g24(spark, d):
    return T.impact(V.commerce(spark, d), spark.createDataFrame([("part:7",)], "id string"), "upstream", 4, 0.3)


@query(
    "g24_impact_depth_groups",
    f"{IMPACT} select depth, count(*) as n, min(id) as first_id, case when depth <= 1 then 'WILL BREAK' when depth = 2 then 'LIKELY AFFECTED' else 'MAYBE AFFECTED' end as risk from r where depth > 0 group by depth",
)
def g24b(spark, d):
    return T.depth_groups(T.impact(V.commerce(spark, d), spark.createDataFrame([("part:7",)], "id string"), "upstream", 4, 0.3))


def probability_sql(depth: int) -> str:
    decay = "case type " + " ".join(f"when '{k}' then {v}" for k, v in EDGE_DECAY.items()) + f" else {OTHER_DECAY} end"
    parts = [f"w as (select dst as src, src as dst, {decay} * greatest(confidence, 0.1) as w from e)", "f0 as (select 'part:7' as id, cast(0 as double) as miss, 0 as n, 0 as depth)", "s0 as (select id, cast(1 as double) as score from f0)"]
    for k in range(1, depth + 1):
        parts.append(f"n{k} as (select dst as id, product(1 - score * w) as miss, count(*) as n from s{k - 1} join w on id = src where dst <> 'part:7' group by 1)")
        old = f"(select * from f{k - 1} where depth > 0)"
        parts.append(f"f{k} as (select coalesce(o.id, n.id) as id, coalesce(o.miss, 1) * coalesce(n.miss, 1) as miss, coalesce(o.n, 0) + coalesce(n.n, 0) as n, coalesce(o.depth, {k}) as depth from {old} o full join n{k} n on o.id = n.id)")
        parts.append(f"s{k} as (select id, 1 - miss as score from f{k} where depth = {k})")
    return ", ".join(parts) + f" select id, floor((1 - miss) * 1000 + 0.5) / 1000 as score, n as n_paths, depth, case when 1 - miss >= 0.7995 then 'direct' when 1 - miss >= 0.3995 then 'transitive' else 'low-risk' end as category from f{depth}"


@query("g25_impact_probability", f"{COMMERCE}, {probability_sql(3)}")
def g25(spark, d):
    return T.impact_probability(V.commerce(spark, d), "part:7", "upstream", 3)


@query(
    "g22_traverse",
    f"{COMMERCE}, s0 as (select id from v where label = 'Package' and name = (select min(n_name) from nation)), s1 as (select distinct dst as id from s0 join e on id = src where type = 'CONTAINS'), s2 as (select distinct dst as id from s1 join e on id = src where type = 'HAS_METHOD'), s as (select 0 as stage, id from s0 union all select 1, id from s1 union all select 2, id from s2) select stage, v.id, label, name, file_path from s join v on s.id = v.id order by stage, v.id limit 50",
)
def g22(spark, d):
    name = spark.read.parquet(f"{d}/nation.parquet").agg(F.min("n_name")).first()[0]
    return T.traverse(V.commerce(spark, d), {"label": "Package", "name": name}, [T.Hop("outgoing", "CONTAINS"), T.Hop("outgoing", "HAS_METHOD")])


@query(
    "g23_traverse_filtered",
    f"{COMMERCE}, b as (select src, dst, type, confidence from e union all select dst, src, type, confidence from e), s1 as (select distinct dst as id from b where src = 'part:7' and type = 'CALLS' and confidence >= 0.95), s2 as (select distinct dst as id from s1 join b on id = src join v on dst = v.id where v.id <> '' and label = 'Module'), s as (select 0 as stage, 'part:7' as id union all select 1, id from s1 union all select 2, id from s2) select stage, v.id, label, name, file_path from s join v on s.id = v.id",
)
def g23(spark, d):
    return T.traverse(V.commerce(spark, d), {"id": "part:7"}, [T.Hop("any", "CALLS", 0.95), T.Hop("any", vertex_filter={"label": "Module"})], limit=None)


@query(
    "g26_augment",
    f"{TRADE}, f as (select src, dst from e where type in ('CALLS', 'IMPORTS', 'MEMBER_OF') union select dst, src from e where type in ('CALLS', 'IMPORTS', 'MEMBER_OF')), {bfs_sql('f', 'select id from v where contains(lower(name), ' + chr(39) + '1' + chr(39) + ')', 2)} select id, min(depth) as depth from r group by id",
)
def g26(spark, d):
    from ..plans.rewrites import frontier_bfs

    g = V.trade(spark, d)
    seeds = g.vertices.where(F.contains(F.lower("name"), F.lit("1"))).select("id")
    return frontier_bfs(T.oriented(g.of_types("CALLS", "IMPORTS", "MEMBER_OF").edges, "any"), seeds, 2, Workspace(spark, "augment"))


@query(
    "g27_neighbourhood",
    f"{TRADE}, x as (select src as id, 'outgoing' as direction, type, dst as other from e union all select dst, 'incoming', type, src from e) select x.id, direction, lower(type) as type, list(name order by name) as names, count(*) as n from x join v on other = v.id group by 1, 2, 3",
)
def g27(spark, d):
    g = V.trade(spark, d)
    return T.neighbourhood(g, g.vertices)


SP = f"{TRADE}, {UND}, f as (select a as src, b as dst from u), {bfs_sql('f', 'select id from v where id = ' + chr(39) + 'nation:0' + chr(39), 8)}"


@query("g03_shortest_paths", f"{SP} select p.id, p.depth as distance, (select min(q.id) from r q join f on f.src = q.id where f.dst = p.id and q.depth = p.depth - 1) as parent from r p")
def g03(spark, d):
    return T.shortest_paths(V.trade(spark, d), "nation:0", max_depth=8)


@query(
    "g03b_bfs_paths",
    f"{TRADE}, w as (select distinct src, dst from e), p0 as (select id, [id] as path from v where id = 'nation:0'), p1 as (select dst as id, list_append(path, dst) as path from p0 join w on id = src where not list_contains(path, dst)), p2 as (select dst as id, list_append(path, dst) as path from p1 join w on id = src where not list_contains(path, dst)), p3 as (select dst as id, list_append(path, dst) as path from p2 join w on id = src where not list_contains(path, dst)), p4 as (select dst as id, list_append(path, dst) as path from p3 join w on id = src where not list_contains(path, dst)), h as (select 1 as k, path from p1 where id in (select id from v where name like '%3') union all select 2, path from p2 where id in (select id from v where name like '%3') union all select 3, path from p3 where id in (select id from v where name like '%3') union all select 4, path from p4 where id in (select id from v where name like '%3')) select path from h where k = (select min(k) from h)",
)
def g03b(spark, d):
    return T.bfs_paths(V.trade(spark, d), "id = 'nation:0'", "name like '%3'", 4)


@query(
    "g03c_landmark_distances",
    f"{TRADE}, f as (select distinct dst as src, src as dst from e), {bfs_sql('f', 'select id as g, id from v where id in (' + chr(39) + 'nation:1' + chr(39) + ', ' + chr(39) + 'nation:2' + chr(39) + ')', 6, group=True)} select g as landmark, id, depth as distance from r",
)
def g03c(spark, d):
    return T.landmark_distances(V.trade(spark, d), ["nation:1", "nation:2"], 6)


def pagerank_sql(k: int) -> str:
    parts = ["nn as (select count(*)::double as n from v)", "w as (select src, dst, count(*)::double as w from e where src in (select id from v) and dst in (select id from v) group by 1, 2)", "o as (select src, sum(w) as o from w group by 1)", "r0 as (select id, 1.0 / n as rank from v, nn)"]
    for i in range(1, k + 1):
        parts.append(f"s{i} as (select dst as id, sum(rank * w / o) as s from r{i - 1} join w on id = w.src join o on w.src = o.src group by 1)")
        parts.append(f"d{i} as (select coalesce(sum(rank), 0) as d from r{i - 1} where id not in (select src from o))")
        parts.append(f"r{i} as (select v.id, 0.15 / n + 0.85 * (coalesce(s, 0) + d / n) as rank from v left join s{i} on v.id = s{i}.id, nn, d{i})")
    return ", ".join(parts) + f" select id, round(rank, 9) as rank from r{k}"


@query("g01_pagerank", f"{PARTS}, {pagerank_sql(8)}")
def g01(spark, d):
    return C.pagerank(V.parts(spark, d), iterations=8, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


@query("g01b_pagerank_trade", f"{TRADE}, {pagerank_sql(12)}")
def g01b(spark, d):
    return C.pagerank(V.trade(spark, d), iterations=12, tolerance=None).select("id", F.round("rank", 9).alias("rank"))


def katz_sql(k: int) -> str:
    parts = ["k0 as (select id, cast(0 as double) as x from v)"]
    for i in range(1, k + 1):
        parts.append(f"k{i} as (select v.id, 0.1 * coalesce(s, 0) + 1 as x from v left join (select dst, sum(x) as s from k{i - 1} join e on id = src group by 1) t on v.id = dst)")
    return ", ".join(parts) + f" select id, round(x / sqrt((select sum(x * x) from k{k})), 9) as katz from k{k}"


@query("g37_katz", f"{TRADE}, {katz_sql(8)}")
def g37(spark, d):
    return C.katz(V.trade(spark, d), iterations=8).select("id", F.round("katz", 9).alias("katz"))


def hits_sql(k: int) -> str:
    parts = ["h0 as (select id, cast(1 as double) as s from v)"]
    for i in range(1, k + 1):
        parts.append(f"x{i} as (select v.id, coalesce(s, 0) as s from v left join (select dst, sum(s) as s from h{i - 1} join e on id = src group by 1) t on v.id = dst)")
        parts.append(f"a{i} as (select id, s / (select sum(s) from x{i}) as s from x{i})")
        parts.append(f"y{i} as (select v.id, coalesce(s, 0) as s from v left join (select src, sum(s) as s from a{i} join e on id = dst group by 1) t on v.id = src)")
        parts.append(f"h{i} as (select id, s / (select sum(s) from y{i}) as s from y{i})")
    return ", ".join(parts) + f" select h.id, round(h.s, 8) as hub, round(a.s, 8) as authority from h{k} h join a{k} a on h.id = a.id"


@query("g38_hits", f"{TRADE}, {hits_sql(5)}")
def g38(spark, d):
    return C.hits(V.trade(spark, d), 5).select("id", F.round("hub", 8).alias("hub"), F.round("authority", 8).alias("authority"))


@query(
    "g02_betweenness",
    f"""{TRADE}, {UND}, recursive_paths as (select 1), d as (with recursive p(s, t, k) as (select id, id, 0 from v union select s, b, k + 1 from p join u on t = a where k < 8) select s, t, min(k) as k from p group by 1, 2),
    n as (with recursive c(s, t, k, w) as (select id, id, 0, 1::bigint from v union all select * from (select c.s, u.b, c.k + 1, sum(c.w)::bigint from c join u on c.t = u.a join d on d.s = c.s and d.t = u.b and d.k = c.k + 1 group by 1, 2, 3)) select s, t, k, w from c)
    select v.id, round(coalesce((select sum(x.w::double * y.w / z.w) from n x join n y on y.s = x.t join n z on z.s = x.s and z.t = y.t and z.k = x.k + y.k where x.t = v.id and x.s <> v.id and y.t <> v.id and x.s <> y.t), 0) / 2, 7) as betweenness from v""",
)
def g02(spark, d):
    return C.betweenness(V.trade(spark, d)).select("id", F.round("betweenness", 7).alias("betweenness"))


CC = "cc as (with recursive p(id, x) as (select id, id from v union select b, x from p join u on id = a) select id, min(x) as component from p group by id)"


@query("g13_connected_components", f"{PARTS}, {UND}, {CC} select id, component from cc")
def g13(spark, d):
    return K.connected_components(V.parts(spark, d))


REACH = "reach as (with recursive p(s, t) as (select src, dst from e where src <> dst union select s, dst from p join e on t = src) select s, t from p)"


@query("g04_strong_components", f"{PARTS}, {REACH}, z as (select a.s as id, a.t as o from reach a join reach b on a.s = b.t and a.t = b.s) select id, min(o) as component from z group by id having count(distinct o) > 1")
def g04(spark, d):
    return K.strong_components(V.parts(spark, d))


@query(
    "g05_bridges",
    f"{TRADE}, {UND}, x as (select a, b from u where a < b), q as (with recursive p(ea, eb, id, ok) as (select a, b, a, true from x union select ea, eb, u.b, true from p join u on p.id = u.a where not (u.a = ea and u.b = eb) and not (u.a = eb and u.b = ea)) select ea, eb, id from p) select a, b from x where not exists (select 1 from q where ea = a and eb = b and q.id = b)",
)
def g05(spark, d):
    return K.bridges(V.trade(spark, d))


@query(
    "g06_cut_vertices",
    f"{PARTS}, {UND}, w as (select a, b from u), s as (select a as x, min(b) as r, count(*) as k from w group by 1 having count(*) > 1), q as (with recursive p(x, id) as (select x, r from s union select x, w.b from p join w on id = w.a where w.b <> x) select x, id from p) select distinct s.x as id from s join w on w.a = s.x where not exists (select 1 from q where q.x = s.x and q.id = w.b)",
)
def g06(spark, d):
    return K.cut_vertices(V.parts(spark, d)).select("id")


@query(
    "g07_mesh",
    f"{PARTS}, {REACH}, z as (select id, min(o) as component from (select a.s as id, a.t as o from reach a join reach b on a.s = b.t and a.t = b.s) group by 1), o as (select z.id, z.component, count(e.src) as o from z left join (e join z y on e.dst = y.id) on e.src = z.id and y.component = z.component group by 1, 2), p as (select component, count(*) as n, sum(o)::bigint as n_edges, min(o) as least from o group by 1) select p.component, n, n_edges, n_edges / (n * (n - 1))::double as density, string_agg(o.id, ',' order by o.id) as anchors from p join o on p.component = o.component and o.o = least where n >= 3 and n_edges / (n * (n - 1))::double >= 0.2 group by 1, 2, 3, 4",
)
def g07(spark, d):
    return K.mesh(V.parts(spark, d), 0.2).withColumn("anchors", F.array_join("anchors", ","))


@query(
    "g09_flow_hierarchy",
    f"{PARTS}, {REACH}, c as (select distinct s as id from reach where s = t), back as (select distinct t as id from reach where s in (select id from c) union select id from c) select avg(case when src in (select id from back) then 0 else 1 end) as flow_hierarchy from e",
)
def g09(spark, d):
    return K.flow_hierarchy(V.parts(spark, d))


@query(
    "g32_peel_order",
    f"{PARTS}, f as (select src, dst from e where type = 'EXTENDS'), l as (with recursive p(id, k) as (select id, 0 from v union select dst, k + 1 from p join f on id = src where k < 60) select id, max(k) as level from p group by id) select id, level from l",
)
def g32(spark, d):
    return K.peel_order(V.parts(spark, d).of_types("EXTENDS"))


@query("g32b_topological_order", f"{PARTS}, x as (select distinct src, dst from e where type = 'EXTENDS'), l as (with recursive p(id, k) as (select id, 0 from v union select src, k + 1 from p join x on p.id = dst where k < 60) select id, max(k) as level from p group by 1) select id, row_number() over (order by level, id) as position from l")
def g32b(spark, d):
    return K.topological_order(V.parts(spark, d).of_types("EXTENDS"))


def core_sql(k: int, rounds: int) -> str:
    parts = ["c0 as (select a, b from u)"]
    for i in range(1, rounds + 1):
        parts.append(f"q{i} as (select a from c{i - 1} group by 1 having count(*) >= {k})")
        parts.append(f"c{i} as (select a, b from c{i - 1} where a in (select a from q{i}) and b in (select a from q{i}))")
    return ", ".join(parts) + f" select distinct a as id from c{rounds}"


@query("g34_k_core", f"{TRADE}, {UND}, {core_sql(5, 10)}")
def g34(spark, d):
    return K.k_core(V.trade(spark, d), 5)


def labels_sql(rounds: int) -> str:
    parts = ["b0 as (select id, id as label from v)"]
    for i in range(1, rounds + 1):
        parts.append(f"n{i} as (select b as id, label, count(*) as n from b{i - 1} join u on id = a group by 1, 2)")
        parts.append(f"m{i} as (select id, label from (select *, row_number() over (partition by id order by n desc, label) as k from n{i}) where k = 1)")
        parts.append(f"b{i} as (select o.id, coalesce(m.label, o.label) as label from b{i - 1} o left join m{i} m on o.id = m.id)")
    return ", ".join(parts) + f" select id, label as community from b{rounds}"


@query("g12b_label_propagation", f"{PARTS}, {UND}, {labels_sql(5)}")
def g12b(spark, d):
    return G.label_propagation(V.parts(spark, d), 5)


@query("g12_louvain")
def g12(spark, d):
    return G.louvain(V.parts(spark, d))


@query("g20_hierarchy")
def g20(spark, d):
    return G.hierarchy(V.parts(spark, d))


@query(
    "g21_namespaces",
    f"{COMMERCE}, p as (select id, list_filter(string_split(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '') as d from v), x as (select id, array_to_string(d[1:k], '/') as namespace, case when k > 1 then array_to_string(d[1:k-1], '/') end as parent, k as depth from p, (values (1), (2), (3)) t(k) where k <= len(d)) select namespace, parent, depth, count(distinct id) as n from x group by 1, 2, 3",
)
def g21(spark, d):
    return G.namespaces(V.commerce(spark, d).vertices)


TRI = "tri as (select x.a as x, x.b as y, y.b as z from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b where x.a < x.b and y.a < y.b)"


@query("g14b_triangle_counts", f"{PARTS}, {UND}, {TRI}, t as (select id, count(*) as n from (select x as id from tri union all select y from tri union all select z from tri) group by 1) select v.id, coalesce(n, 0) as n from v left join t on v.id = t.id")
def g14b(spark, d):
    return M.triangle_counts(V.parts(spark, d))


@query(
    "g14_motif3",
    f"{TRADE}, {UND}, p as (select a.id as x, b.id as y, c.id as z from v a, v b, v c where a.id < b.id and b.id < c.id), k as (select (select count(*) from u where a = x and b = y) + (select count(*) from u where a = y and b = z) + (select count(*) from u where a = x and b = z) as k from p) select count(*) filter (where k = 0) as empty, count(*) filter (where k = 1) as one_edge, count(*) filter (where k = 2) as two_edge, count(*) filter (where k = 3) as triangle, (select count(*) from v) as n_vertices, (select count(*) // 2 from u) as n_edges from k",
)
def g14(spark, d):
    return M.motif3(V.trade(spark, d))


QUADS = f"{TRADE}, {UND}, f as (select a, b from (select *, row_number() over (partition by a order by b) as k from u) where k <= 30), s as (select distinct list_sort([x.a, x.b, y.b, z.b]) as q from f x join f y on x.a = y.a and x.b < y.b join f z on x.a = z.a and y.b < z.b), c as (select q, count(*) as n_edges from s join u on list_contains(q, u.a) and list_contains(q, u.b) and u.a < u.b group by q), dg as (select q, max(k) as top from (select q, u.a, count(*) as k from s join u on list_contains(q, u.a) and list_contains(q, u.b) group by 1, 2) group by q), h as (select case when n_edges = 6 then 'clique' when n_edges = 5 then 'diamond' when n_edges = 4 and top = 2 then 'cycle' when n_edges = 4 then 'diamond' when n_edges = 3 and top = 3 then 'star' else 'chain' end as shape from c join dg on c.q = dg.q)"


@query("g14c_motif4", f"{QUADS} select " + ", ".join(f"count(*) filter (where shape = '{s}') as {s}" for s in M.MOTIF4) + " from h")
def g14c(spark, d):
    return M.motif4(V.trade(spark, d))


@query("g15_typed_pairs", f"{COMMERCE} select a.label || ':' || type || ':' || b.label as key, count(*) as n from e join v a on src = a.id join v b on dst = b.id group by 1")
def g15(spark, d):
    return M.typed_pairs(V.commerce(spark, d))


@query(
    "g15b_typed_triangles",
    f"{PARTS}, {UND}, {TRI}, k as (select least(src, dst) as a, greatest(src, dst) as b, min(type) as type from e where src <> dst group by 1, 2) select array_to_string(list_sort([a.label, b.label, c.label]), ':') || '|' || array_to_string(list_sort([p.type, q.type, r.type]), '-') as key, count(*) as n from tri join v a on x = a.id join v b on y = b.id join v c on z = c.id join k p on p.a = x and p.b = y join k q on q.a = y and q.b = z join k r on r.a = x and r.b = z group by 1",
)
def g15b(spark, d):
    return M.typed_triangles(V.parts(spark, d))


@query("g16_architecture_patterns")
def g16(spark, d):
    return M.architecture_patterns(M.census(V.trade(spark, d)))


@query("g18_architecture_health")
def g18(spark, d):
    g = V.parts(spark, d)
    return M.architecture_health(M.census(g), A.counts_by(V.sql(spark, d, V.PART_MEMBERS), "community"), g.undirected().groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")))


@query("g19_typed_smells", f"{COMMERCE}, c as (select case when label = 'Method' then 'Class' else label end as label, id from v) select 'God Controller' as name, src as id, count(*) as n, case when count(*) > 30 then 'critical' else 'warning' end as severity from e join c on src = c.id where c.label = 'Class' and type = 'CALLS' group by src having count(*) > 15")
def g19(spark, d):
    g = V.commerce(spark, d)
    v = g.vertices.withColumn("label", F.when(F.col("label") == "Method", "Class").otherwise(F.col("label")))
    return M.typed_smells(type(g)(v, g.edges))


@query("g19b_inheritance_depth", f"{PARTS}, f as (select src, dst from e where type = 'EXTENDS'), l as (with recursive p(id, k) as (select src, 1 from f union select f.src, k + 1 from p join f on p.id = f.dst where k < 60) select id, max(k) as depth from p group by id) select id, depth from l")
def g19b(spark, d):
    return M.inheritance_depth(V.parts(spark, d))


@query("g19c_shotgun_surgery", f"{PARTS}, x as (select a.community <> b.community as c from e join m a on src = a.id join m b on dst = b.id where type = 'CALLS') select count(*) as n_calls, count(*) filter (where c) as n_across, count(*) filter (where c) / count(*) as share, 'none' as severity from x")
def g19c(spark, d):
    return M.shotgun_surgery(V.parts(spark, d), V.sql(spark, d, V.PART_MEMBERS))


WL = f"{PARTS}, {DEG}, w0 as (select id, 'd:' || n_out || ',' || n_in as label from d), w1 as (select w0.id, md5(label || '|' || coalesce((select string_agg(x.label, ',' order by x.label) from e join w0 x on e.dst = x.id where e.src = w0.id), '')) as label from w0), w2 as (select w1.id, md5(label || '|' || coalesce((select string_agg(x.label, ',' order by x.label) from e join w1 x on e.dst = x.id where e.src = w1.id), '')) as label from w1)"


@query("g11_clone_classes", f"{WL} select label, count(*) as n, min(id) as first_id from w2 where id in (select src from e) group by label having count(*) > 1")
def g11(spark, d):
    return W.clone_classes(V.parts(spark, d))


@query(
    "g11b_clone_buckets",
    f"{WL}, s as (select src as id, list_sort(list(distinct label)) as s from e join w2 on dst = w2.id group by 1), g as (select w2.id, label, s from w2 join s on w2.id = s.id), k as (select *, row_number() over (partition by label order by id) - 1 as k, count(*) over (partition by label) as n from g), t as (select * from k), j as (select floor(10000 * len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) + 0.5) / 10000 as similarity from t a join t b on a.label = b.label and a.id < b.id) select count(*) filter (where similarity >= 0.95) as exact, count(*) filter (where similarity >= 0.8 and similarity < 0.95) as near, count(*) filter (where similarity >= 0.6 and similarity < 0.8) as potential from j",
)
def g11b(spark, d):
    return W.similarity_buckets(W.clone_set_pairs(V.parts(spark, d)))


@query(
    "g11c_clone_clusters",
    f"{WL}, s as (select src as id, list_sort(list(distinct label)) as s from e join w2 on dst = w2.id group by 1), g as (select w2.id, label, s from w2 join s on w2.id = s.id), j as (select a.id as a, b.id as b, floor(10000 * len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) + 0.5)::bigint as units from g a join g b on a.label = b.label and a.id < b.id), k as (select * from j where units >= 8000), f as (select a, b, units from k union all select b, a, units from k), r as (with recursive p(id, o) as (select distinct a, a from f union select p.id, f.b from p join f on p.o = f.a) select id, min(o) as c from p group by 1), t as (select c, f.a as id, sum(units) as s from f join r on f.a = r.id group by 1, 2) select c as cluster, count(*) as n, (array_agg(id order by s desc, id))[1] as representative, (select floor(avg(units) + 0.5) / 10000 from k join r on k.a = r.id where r.c = t.c) as similarity from t group by c",
)
def g11c(spark, d):
    return W.clone_clusters(W.clone_set_pairs(V.parts(spark, d), 0.8), Workspace(spark, "clusters"))


@query(
    "g39_vertex_jaccard",
    f"{PARTS}, {UND}, p as (select a, b from u where a < b), i as (select p.a, p.b, count(*) as i from p join u x on p.a = x.a join u y on p.b = y.a and x.b = y.b group by 1, 2), k as (select a, count(*) as n from u group by 1) select p.a, p.b, coalesce(i, 0) / (ka.n + kb.n - coalesce(i, 0)) as jaccard from p left join i on p.a = i.a and p.b = i.b join k ka on p.a = ka.a join k kb on p.b = kb.a",
)
def g39(spark, d):
    return W.vertex_jaccard(V.parts(spark, d))


@query("g35_random_walks")
def g35(spark, d):
    return E.random_walks(V.trade(spark, d), walks=3, length=6)


@query("g35b_walk_embeddings")
def g35b(spark, d):
    return E.walk_embeddings(V.trade(spark, d), dims=16, walks=3, length=6)


EVENT_FLOW = "select event_type as src, nxt as dst, 'CALLS' as type, cast(1.0 as double) as confidence from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) x where nxt is not null"
FLOW_V = "select distinct event_type as id, 'Function' as label, event_type as name, 'events/' || event_type as file_path from events"
FLOW = f"with e as ({EVENT_FLOW}), f as (select distinct src, dst from e)"


@query(
    "g29_trace_processes",
    f"{FLOW}, {bfs_sql('f', 'select distinct event_type as g, event_type as id from events', 6, group=True)}, o as (select g as process, row_number() over (partition by g order by depth, id) as step, id, depth, count(*) over (partition by g) as n from r) select process, step, id, depth from o where n > 1",
)
def g29(spark, d):
    g = V.graph(spark, d, FLOW_V, EVENT_FLOW)
    return T.trace_processes(g, g.vertices.select("id"), 6)


@query("g30_classify_processes", "with s as (select 'order:' || l_orderkey as process, 'part:' || l_partkey as id from lineitem) select process, count(*) as n_steps, count(distinct p_brand) as n_communities, case when count(distinct p_brand) > 1 then 'cross_community' else 'intra_community' end as kind from s join part on id = 'part:' || p_partkey group by process")
def g30(spark, d):
    steps = V.sql(spark, d, "select 'order:' || l_orderkey as process, 'part:' || l_partkey as id from lineitem")
    return T.classify_processes(steps, V.sql(spark, d, V.PART_MEMBERS))


@query("i03_affected_descendants", f"{PARTS}, f as (select dst as src, src as dst from e where type = 'EXTENDS'), {bfs_sql('f', 'select id from v where id in (' + chr(39) + 'part:3' + chr(39) + ', ' + chr(39) + 'part:44' + chr(39) + ')', 20)} select id from r")
def i03(spark, d):
    from ..streaming.incremental import affected_descendants

    return affected_descendants(V.parts(spark, d).of_types("EXTENDS").edges, spark.createDataFrame([("part:3",), ("part:44",)], "id string"), 20)


@query("l01_vertex_features", f"{TRADE}, {DEG} select d.id, n_in::double as n_in, n_out::double as n_out, cast(1 as double) as hot from d")
def l01(spark, d):
    f = L.vertex_features(V.trade(spark, d))
    hot = F.aggregate(F.slice("features", 13, 100), F.lit(0.0), lambda s, x: s + x)
    return f.select("id", F.col("features")[0].alias("n_in"), F.col("features")[1].alias("n_out"), hot.alias("hot"))


@query("l02_edge_features", f"{COMMERCE} select src, dst, type, confidence, not (a.community is not distinct from b.community) as crosses from e left join m a on src = a.id left join m b on dst = b.id where type = 'USES'")
def l02(spark, d):
    return L.edge_features(V.commerce(spark, d).of_types("USES"), V.sql(spark, d, V.MEMBERS)).drop("features")


@query("l06_hetero_edges", f"{COMMERCE}, i as (select id, label, row_number() over (partition by label order by id) - 1 as k from v) select a.label as src_label, type, b.label as dst_label, count(*) as n, sum(a.k)::bigint as s, sum(b.k)::bigint as t from e join i a on src = a.id join i b on dst = b.id group by 1, 2, 3")
def l06(spark, d):
    return L.hetero_edges(V.commerce(spark, d)).groupBy("src_label", "type", "dst_label").agg(F.count(F.lit(1)).alias("n"), F.sum("src_index").alias("s"), F.sum("dst_index").alias("t"))


@query(
    "r12_propagate",
    f"{TRADE}, {UND}, x as (select 'nation:' || vec_id as id, embedding::double[] as vector from embeddings), q as (select u.a as id, k, avg(x.vector[k]) as m from u join x on u.b = x.id, range(1, 65) t(k) group by 1, 2), m as (select id, list(m order by k) as m from q group by 1) select coalesce(x.id, m.id) as id, round(case when m.m is null then x.vector[1] when x.vector is null then m.m[1] else x.vector[1] * 0.5 + m.m[1] * 0.5 end, 6) as v1, round(case when m.m is null then x.vector[64] when x.vector is null then m.m[64] else x.vector[64] * 0.5 + m.m[64] * 0.5 end, 6) as v64 from x full join m on x.id = m.id",
)
def r12(spark, d):
    x = V.sql(spark, d, "select 'nation:' || vec_id as id, embedding as vector from embeddings")
    return E.propagate(V.trade(spark, d), x).select("id", F.round(F.col("vector")[0], 6).alias("v1"), F.round(F.col("vector")[63], 6).alias("v64"))


@query("r13_propagate_by_type", f"{TRADE}, x as (select 'nation:' || vec_id as id, embedding::double[] as vector from embeddings), b as (select src as id, dst as o, type from e union all select dst, src, type from e) select b.id, type, round(avg(vector[1]), 6) as v1 from b join x on o = x.id group by 1, 2")
def r13(spark, d):
    x = V.sql(spark, d, "select 'nation:' || vec_id as id, embedding as vector from embeddings")
    return E.propagate_by_type(V.trade(spark, d), x).select("id", "type", F.round(F.col("mean")[0], 6).alias("v1"))


@query("p13_entry_filter", f"with s as ({SNAPSHOTS}) select count(*) as n from s where health >= 50")
def p13(spark, d):
    return V.sql(spark, d, SNAPSHOTS).where(P.compile_filter({"health": {"gte": 50}})).agg(F.count(F.lit(1)).alias("n"))
