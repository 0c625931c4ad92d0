"""Filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions.scalar import SEVERITIES, severity_rank
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..search.ranking import within_budget
from ..streaming.incremental import coalesce_events, file_changes, tumbling_counts
from . import query

COMMERCE = f"with v as ({V.COMMERCE_V}), e as ({V.COMMERCE_E}), m as ({V.MEMBERS})"
TRADE = f"with v as ({V.TRADE_V}), e as ({V.TRADE_E})"
PARTS = f"with v as ({V.PARTS_V}), e as ({V.PARTS_E}), m as ({V.PART_MEMBERS})"
STATUS = "select 'part:' || p_partkey as id, case when p_partkey % 3 = 0 then 'uncovered' when p_partkey % 3 = 1 then 'covered' else 'partial' end as status from part"


def status(spark, d):
    return V.sql(spark, d, STATUS)


def members(spark, d, text=V.MEMBERS):
    return V.sql(spark, d, text)


# -- filters


@query("p01_by_label", f"{COMMERCE} select id, label, name, file_path from v where label = 'Class'")
def p01(spark, d):
    return P.by_label(V.commerce(spark, d).vertices, "Class")


@query("p02_by_property", f"{COMMERCE} select id, name from v where name = 'red widget'")
def p02(spark, d):
    return P.by_property(V.commerce(spark, d).vertices, "name", "red widget").select("id", "name")


@query("p03_edges_by_type", f"{COMMERCE} select src, dst, confidence from e where type = 'USES'")
def p03(spark, d):
    return V.commerce(spark, d).of_types("USES").edges.select("src", "dst", "confidence")


@query("p04_filter_language", "select p_partkey, p_size from part where p_brand = 'Brand#2' and p_size >= 10 and p_size < 40 and p_retailprice > 1000")
def p04(spark, d):
    spec = {"p_brand": "Brand#2", "p_size": {"gte": 10, "lt": 40}, "p_retailprice": {"gt": 1000}}
    return V.sql(spark, d, "select * from part").where(P.compile_filter(spec)).select("p_partkey", "p_size")


@query("p05_match_vertices", f"{COMMERCE} select id, file_path from v where label = 'Function' and name = 'blue bolt'")
def p05(spark, d):
    return P.match_vertices(V.commerce(spark, d).vertices, label="Function", name="blue bolt").select("id", "file_path")


@query(
    "p06_resolve_symbol",
    f"{COMMERCE} select id, label, name, file_path, cast(0.9 as double) as relevance, count(*) over () > 1 as ambiguous from v where (id = 'small ring' or name = 'small ring') and label = 'Function' and contains(file_path, 'Brand#1')",
)
def p06(spark, d):
    return P.resolve_symbol(V.commerce(spark, d).vertices, "small ring", kind="Function", path="Brand#1")


@query("p07_ambiguous_names", f"{COMMERCE} select name, count(*) as n from v where label = 'Function' group by name having count(*) > 1")
def p07(spark, d):
    return P.by_label(V.commerce(spark, d).vertices, "Function").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "p08_severity",
    "select event_id, case event_type when 'error' then 0 when 'purchase' then 1 when 'click' then 3 else 4 end as rank from events where event_type in ('error', 'purchase')",
)
def p08(spark, d):
    names = {"error": "critical", "purchase": "high", "click": "low"}
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    rank = severity_rank(F.coalesce(F.element_at(table, F.col("event_type")), F.lit("info")))
    return V.sql(spark, d, "select * from events").select("event_id", rank.alias("rank")).where(F.col("rank") <= SEVERITIES.index("high"))


@query("p09_confident_edges", f"{COMMERCE} select type, count(*) as n from e where confidence >= 0.95 group by type")
def p09(spark, d):
    return A.counts_by(P.confident(V.commerce(spark, d).edges, 0.95), "type")


@query("p10_non_structural", f"{COMMERCE} select label, count(*) as n from v where label not in ('File', 'Folder', 'Import', 'Package') group by label")
def p10(spark, d):
    return A.counts_by(P.non_structural(V.commerce(spark, d).vertices), "label")


@query(
    "p12_coverage_gaps",
    f"{PARTS}, s as ({STATUS}) select s.id, count(*) as n_in from s join e on e.dst = s.id where status = 'uncovered' group by s.id having count(*) >= 2",
)
def p12(spark, d):
    return A.coverage_gaps(V.parts(spark, d), status(spark, d))


@query("p14_projection", f"{COMMERCE} select id, name, cast(null as varchar) as nothing from v where label = 'Package'")
def p14(spark, d):
    return P.project(P.match_vertices(V.commerce(spark, d).vertices, label="Package"), ["id", "name", "nothing"])


@query(
    "p15_grep",
    """with l as (select doc_id as id, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents)
    select id, line, substr(trim(raw, ' '), 1, 200) as text from l where regexp_matches(raw, '(?i)the.*tion$') order by id, line limit 50""",
)
def p15(spark, d):
    return P.grep(V.sql(spark, d, "select doc_id, text from documents"), "doc_id", "text", "the.*tion$")


@query("p16_service_prefix", f"{COMMERCE} select label, count(*) as n from v where starts_with(file_path, 'world/supply') group by label")
def p16(spark, d):
    return A.counts_by(P.in_service(V.commerce(spark, d).vertices, "/world/supply/"), "label")


@query(
    "p17_ui_view",
    f"{COMMERCE}, u as (select id from v where label not in ('File', 'Folder') order by id limit 200) select src, dst, type, confidence from e where type <> 'CONTAINS' and src in (select id from u) and dst in (select id from u) order by src, dst, type, confidence limit 400",
)
def p17(spark, d):
    return P.ui_view(V.commerce(spark, d)).edges


@query(
    "p18_entry_points",
    f"""{PARTS}, o as (select src as id, count(*) as n_out from e where type = 'CALLS' group by src), i as (select dst as id, count(*) as n_in from e where type = 'CALLS' group by dst),
    s as (select v.id, round(0.2::double + case when i.id is null then 0.3 else 0 end + case when n_out >= 3 then 0.2 else 0 end, 6) as score from v left join o on v.id = o.id left join i on v.id = i.id where label in ('Function', 'Method'))
    select id, score from s where score > 0.25""",
)
def p18(spark, d):
    return P.entry_points(V.parts(spark, d), 0.25)


# -- joins


@query(
    "j01_named_edges",
    f"{TRADE} select src, dst, type, confidence, coalesce(a.name, src) as src_name, coalesce(b.name, dst) as dst_name from e left join v a on src = a.id left join v b on dst = b.id",
)
def j01(spark, d):
    return J.named_edges(V.trade(spark, d))


@query("j02_without_dangling", f"{COMMERCE}, w as (select id from v where label <> 'Class') select type, count(*) as n from e where src in (select id from w) and dst in (select id from w) group by type")
def j02(spark, d):
    return A.counts_by(V.commerce(spark, d).where_vertices("label <> 'Class'").without_dangling().edges, "type")


@query("j03_attach", f"{TRADE} select v.id, name, n_in from v left join (select dst, count(*) as n_in from e group by dst) x on v.id = dst")
def j03(spark, d):
    g = V.trade(spark, d)
    n = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    return J.attach(g.vertices.select("id", "name"), n, ["id"])


STEPS = "select 'user:' || user_id as process, event_type as id, count(*) as step from events group by user_id, event_type"


@query("j04_outside_processes", f"{COMMERCE} select id from v where label = 'Class' and not exists (select 1 from v w where w.label = 'Class' and w.file_path = v.file_path and w.name = v.name and w.file_path like '%/1%')")
def j04(spark, d):
    v = P.by_label(V.commerce(spark, d).vertices, "Class")
    return J.outside_processes(v, v.where("file_path like '%/1%'")).select("id")


@query(
    "j05_changed_symbols",
    f"""{COMMERCE}, s as (select 'order:' || l_orderkey as process, 'part:' || l_partkey as id from lineitem),
    n as (select id, count(distinct process) as n_processes from s group by id)
    select v.id, name, file_path, coalesce(n_processes, 0) as n_processes from v left join n on v.id = n.id where file_path in ('world/parts/Brand#1', 'world/parts/Brand#2')""",
)
def j05(spark, d):
    steps = V.sql(spark, d, "select 'order:' || l_orderkey as process, 'part:' || l_partkey as id from lineitem")
    paths = spark.createDataFrame([("world/parts/Brand#1",), ("world/parts/Brand#2",)], "file_path string")
    return J.changed_symbols(V.commerce(spark, d), paths, steps)


@query(
    "j06_members_by_process",
    f"with s as ({STEPS}) select process, list_sort(list(distinct id)) as symbols, count(distinct id) as n_symbols from s where id in ('error', 'click') group by process",
)
def j06(spark, d):
    hits = spark.createDataFrame([("error",), ("click",)], "id string")
    return J.members_by_process(hits, V.sql(spark, d, STEPS))


@query("j07_community_of", f"with m as ({V.MEMBERS}) select id, max(community) as community from m group by id")
def j07(spark, d):
    return J.community_of(members(spark, d))


SYMBOLS = "select 'part:' || p_partkey as id, p_name as name, 'parts/' || p_brand || '/' || p_type || '.py' as file_path from part"


@query(
    "j08_resolve_imports",
    f"""with i as (select 'i' || s_suppkey as import_id, 'parts.Brand#' || (s_suppkey % 25 + 1) as module_path, 'red widget' as a, 'blue bolt' as b from supplier), s as ({SYMBOLS})
    select distinct import_id as src, id as dst, 'USES' as type, cast(0.8 as double) as confidence from i join s on 'parts/' || substr(module_path, 7) = regexp_extract(file_path, '^(.*)/[^/]*$', 1) and name in (a, b)""",
)
def j08(spark, d):
    i = V.sql(spark, d, "select 'i' || s_suppkey as import_id, 'parts.Brand#' || (s_suppkey % 25 + 1) as module_path, array('red widget', 'blue bolt') as names from supplier")
    return J.resolve_imports(i, V.sql(spark, d, SYMBOLS))


@query(
    "j09_wildcard_imports",
    f"""with i as (select 'i' || s_suppkey as import_id, 'parts.Brand#' || (s_suppkey % 25 + 1) || '.SMALL' as module_path from supplier), s as ({SYMBOLS})
    select distinct import_id as src, id as dst, 'USES' as type, cast(0.6 as double) as confidence from i join s on replace(module_path, '.', '/') = regexp_replace(file_path, '\\.[^./]*$', '')""",
)
def j09(spark, d):
    i = V.sql(spark, d, "select 'i' || s_suppkey as import_id, 'parts.Brand#' || (s_suppkey % 25 + 1) || '.SMALL' as module_path, array('') as names from supplier")
    return J.resolve_imports(i, V.sql(spark, d, SYMBOLS), wildcard=True)


CALLS = "select event_id as call_id, 'f' || (user_id % 7) as file_path, cast(floor(value * 10) as bigint) as line from events"
FUNCTIONS = "select 'part:' || p_partkey as id, 'f' || (p_partkey % 7) as file_path, cast(p_partkey * 3 as bigint) as start_line, cast(p_partkey * 3 + p_size * 4 as bigint) as end_line from part"


@query(
    "j10_enclosing_functions",
    f"""with c as ({CALLS}), f as ({FUNCTIONS}), x as (select call_id, id as function_id, row_number() over (partition by call_id order by start_line desc, end_line) as k
    from c join f on c.file_path = f.file_path and line between start_line and end_line) select call_id, function_id from x where k = 1""",
)
def j10(spark, d):
    return J.enclosing_functions(V.sql(spark, d, CALLS), V.sql(spark, d, FUNCTIONS))


@query(
    "j11_owners",
    f"""with f as ({FUNCTIONS}), m as (select id, file_path, start_line + 1 as start_line from f where start_line % 2 = 0), c as (select * from f where start_line % 2 = 1),
    x as (select m.id as member_id, c.id as class_id, row_number() over (partition by m.id order by c.start_line desc, c.end_line) as k from m join c on m.file_path = c.file_path and m.start_line between c.start_line and c.end_line)
    select member_id, class_id from x where k = 1""",
)
def j11(spark, d):
    f = V.sql(spark, d, FUNCTIONS)
    return J.owners(f.where("start_line % 2 = 0").withColumn("start_line", F.col("start_line") + 1), f.where("start_line % 2 = 1"))


BIND_CALLS = "select o_orderkey as call_id, 'order:' || o_orderkey as caller, 'fn' || (o_custkey % 300) as callee, 'f' || (o_orderkey % 11) as file_path from orders"
BIND_FUNCTIONS = "select 'part:' || p_partkey as id, 'fn' || (p_partkey % 250) as name, 'f' || (p_partkey % 13) as file_path from part"
BIND_IMPORTS = "select 'f' || s_nationkey as file_path, 'f' || (s_suppkey % 13) as target_path from supplier group by 1, 2"


@query(
    "j12_bind_calls",
    f"""with c as ({BIND_CALLS}), f as ({BIND_FUNCTIONS}), i as ({BIND_IMPORTS}),
    a as (select name, file_path, min(id) as id from f group by 1, 2), b as (select i.file_path, name, min(id) as id from i join f on target_path = f.file_path group by 1, 2), z as (select name, min(id) as id from f group by 1)
    select call_id, caller as src, coalesce(a.id, b.id, z.id) as dst, case when a.id is not null then 0.9 when b.id is not null then 0.8 else 0.4 end::double as confidence
    from c left join a on callee = a.name and c.file_path = a.file_path left join b on callee = b.name and c.file_path = b.file_path left join z on callee = z.name where coalesce(a.id, b.id, z.id) is not null""",
)
def j12(spark, d):
    return J.bind_calls(V.sql(spark, d, BIND_CALLS), V.sql(spark, d, BIND_FUNCTIONS), V.sql(spark, d, BIND_IMPORTS))


URL_ROWS = "select page_id as url_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages"


@query(
    "j13_match_routes",
    f"""with u as ({URL_ROWS}), us as (select url_id, list_filter(string_split(path, '/'), lambda x: x <> '') as s from u),
    r as (select distinct 'r' || k as route_id, p as pattern from (values (1, '/en/:id'), (2, '/:lang/:id'), (3, '/fr/{{id}}'), (4, '/de/100'), (5, '/a/b/c')) t(k, p)), rs as (select route_id, list_filter(string_split(pattern, '/'), lambda x: x <> '') as s from r)
    select distinct url_id, route_id from us join rs on len(us.s) = len(rs.s) and len(us.s) = 2 and (us.s[1] = rs.s[1] or rs.s[1][1] in (':', '{{')) and (us.s[2] = rs.s[2] or rs.s[2][1] in (':', '{{'))""",
)
def j13(spark, d):
    routes = spark.createDataFrame([("r1", "/en/:id"), ("r2", "/:lang/:id"), ("r3", "/fr/{id}"), ("r4", "/de/100"), ("r5", "/a/b/c")], "route_id string, pattern string")
    return J.match_routes(V.sql(spark, d, URL_ROWS), routes)


HTTP_P = "select s_nationkey % 5 as repo, '/api/' || (s_suppkey % 20) || '/items/' || s_nationkey as path from supplier"
HTTP_C = "select c_nationkey % 5 as repo, '/api/' || (c_custkey % 20) || '/list/' || c_nationkey as path from customer"


@query(
    "j14_http_contracts",
    f"""with p as (select distinct repo as provider_repo, path as provider_path, list_distinct(list_filter(string_split(path, '/'), lambda x: x <> '')) as s from ({HTTP_P})), c as (select distinct repo as consumer_repo, path as consumer_path, list_distinct(list_filter(string_split(path, '/'), lambda x: x <> '')) as s from ({HTTP_C})),
    j as (select provider_repo, provider_path, consumer_repo, consumer_path, len(list_intersect(p.s, c.s))::double / (len(p.s) + len(c.s) - len(list_intersect(p.s, c.s))) as jaccard from p join c on provider_repo <> consumer_repo)
    select * from j where jaccard > 0.3""",
)
def j14(spark, d):
    return J.match_http_contracts(V.sql(spark, d, HTTP_P), V.sql(spark, d, HTTP_C))


@query(
    "j15_grpc_contracts",
    """with p as (select s_nationkey as repo, 'Item' || (s_suppkey % 9) || 'Service' as service from supplier), c as (select c_nationkey as repo, 'item' || (c_custkey % 12) || 'Client' as service from customer)
    select distinct p.repo as provider_repo, p.service as provider_service, c.repo as consumer_repo, c.service as consumer_service, cast(0.7 as double) as confidence
    from p join c on regexp_replace(lower(p.service), '(service|client|grpc|stub)+$', '') = regexp_replace(lower(c.service), '(service|client|grpc|stub)+$', '') and p.repo <> c.repo""",
)
def j15(spark, d):
    p = V.sql(spark, d, "select s_nationkey as repo, 'Item' || (s_suppkey % 9) || 'Service' as service from supplier")
    return J.match_grpc(p, V.sql(spark, d, "select c_nationkey as repo, 'item' || (c_custkey % 12) || 'Client' as service from customer"))


@query(
    "j16_topic_contracts",
    "with p as (select distinct n_regionkey as r, lower(n_name) as topic from nation) select p.r as producer_repo, topic, c.k as consumer_repo, cast(0.8 as double) as confidence from p join (select distinct r_regionkey as k from region) c on p.r <> c.k",
)
def j16(spark, d):
    return J.match_topics(V.sql(spark, d, "select n_regionkey as repo, n_name as topic from nation"), V.sql(spark, d, "select r_regionkey as repo, upper(n_name) as topic from region, nation")).select("producer_repo", "topic", "consumer_repo", "confidence")


VECTORS = "select vec_id as id, label as repo, embedding as vector from embeddings"
COS = "list_dot_product(a.vector::double[], b.vector::double[]) / (sqrt(list_dot_product(a.vector::double[], a.vector::double[])) * sqrt(list_dot_product(b.vector::double[], b.vector::double[])))"


@query(
    "j17_fuzzy_contracts",
    f"""with x as ({VECTORS}), a as (select * from x where id % 2 = 0), b as (select * from x where id % 2 = 1), s as (select a.id as provider_id, b.id as consumer_id, {COS} as similarity from a join b on a.repo <> b.repo)
    select provider_id, consumer_id, similarity, floor(similarity * 0.7 * 100 + 0.5) / 100 as confidence from s where similarity >= 0.45""",
)
def j17(spark, d):
    x = V.sql(spark, d, VECTORS)
    linked = spark.createDataFrame([], "provider_id bigint, consumer_id bigint")
    return J.match_fuzzy(x.where("id % 2 = 0"), x.where("id % 2 = 1"), linked, 0.45)


@query(
    "j18_cover_functions",
    """with c as (select 'build/src/m' || (p_partkey % 5) || '.ts' as cp, p_name as name, p_partkey as line, p_size as hits from part), f as (select 'fn:' || p_partkey as id, p_name as name, 'src/m' || (p_partkey % 5) || '.ts' as fp, p_partkey + p_size as start_line from part),
    x as (select id, line, hits, hits > 0 as covered, row_number() over (partition by cp, c.name, line order by abs(line - start_line), id) as k from c join f on c.name = f.name and ends_with(cp, fp)) select id, line, hits, covered from x where k = 1""",
)
def j18(spark, d):
    c = V.sql(spark, d, "select 'build/src/m' || (p_partkey % 5) || '.ts' as file_path, p_name as name, p_partkey as line, p_size as hits from part")
    f = V.sql(spark, d, "select 'fn:' || p_partkey as id, p_name as name, 'src/m' || (p_partkey % 5) || '.ts' as file_path, p_partkey + p_size as start_line from part")
    return J.cover_functions(c, f)


@query(
    "j22_shape_check",
    """with p as (select distinct p_brand as route, p_type as field from part where p_size < 10), a as (select distinct p_brand as route, p_type as field from part where p_size > 45)
    select coalesce(p.route, a.route) as route, coalesce(p.field, a.field) as field, case when p.route is null then 'missing' else 'unused' end as status from p full join a on p.route = a.route and p.field = a.field where p.route is null or a.route is null order by 1, 2 limit 30""",
)
def j22(spark, d):
    return J.shape_check(V.sql(spark, d, "select p_brand as route, p_type as field from part where p_size < 10"), V.sql(spark, d, "select p_brand as route, p_type as field from part where p_size > 45"))


@query("j23_semantic_edges", f"with x as (select vec_id as id, embedding as vector from embeddings) select a.id as a, b.id as b, {COS} as similarity from x a join x b on a.id < b.id where {COS} >= 0.5")
def j23(spark, d):
    return J.semantic_edges(V.sql(spark, d, "select vec_id as id, embedding as vector from embeddings"), 0.5)


@query("j25_group_query", f"{COMMERCE} select split_part(file_path, '/', 2) as repo, label, count(*) as n from v where split_part(file_path, '/', 2) in ('supply', 'demand') group by 1, 2")
def j25(spark, d):
    v = V.commerce(spark, d).vertices.withColumn("repo", F.split_part("file_path", F.lit("/"), F.lit(2)))
    return v.where(F.col("repo").isin("supply", "demand")).groupBy("repo", "label").agg(F.count(F.lit(1)).alias("n"))


# -- aggregates


@query("a01_counts", f"{COMMERCE} select label as name, count(*) as n from v group by label union all select type, count(*) from e group by type")
def a01(spark, d):
    g = V.commerce(spark, d)
    return A.counts_by(g.vertices, "label").withColumnRenamed("label", "name").unionByName(A.counts_by(g.edges, "type").withColumnRenamed("type", "name"))


DEG = "d as (select v.id, label, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out from v left join (select dst, count(*) as n_in from e group by dst) i on v.id = dst left join (select src, count(*) as n_out from e group by src) o on v.id = src)"


@query("a02_degrees", f"{COMMERCE}, {DEG} select id, n_in, n_out, n_in + n_out as n_total from d")
def a02(spark, d):
    return A.degrees(V.commerce(spark, d))


@query(
    "a03_hubs",
    f"{PARTS}, {DEG} select id, n_in as fan_in, n_out as fan_out, case when n_in + n_out > 0 then n_out / (n_in + n_out) else 0 end as instability, case when n_in >= 3 and n_out >= 3 then 'god-module' when n_in >= 3 then 'hub' when n_out >= 3 then 'dependent' else 'isolated' end as kind from d",
)
def a03(spark, d):
    return A.hubs(V.parts(spark, d))


@query(
    "a04_martin_metrics",
    f"{TRADE}, {DEG} select id, n_in as ca, n_out as ce, case when n_in + n_out > 0 then n_out / (n_in + n_out) else 0 end as instability, cast(0 as double) as abstractness, abs(case when n_in + n_out > 0 then n_out / (n_in + n_out) else 0 end - 1) as distance from d",
)
def a04(spark, d):
    return A.martin_metrics(V.trade(spark, d))


SPECTRAL = f"{{base}}, {DEG}, h as (select n_out, count(*) as c from d group by n_out), t as (select count(*) as n, sum(n_out) as e, max(n_out) as mx from d), x as (select t.n as n_vertices, t.e::bigint as n_edges, least(1, t.e / (t.n * (t.n - 1))) as density, (select sum(-(c / t.n) * log2(c / t.n)) from h, t) as entropy, t.e / t.n as avg_degree, mx as max_degree from t)"


@query("a05_spectral", SPECTRAL.format(base=TRADE) + " select * from x")
def a05(spark, d):
    return A.spectral(V.trade(spark, d))


@query(
    "g10_topology",
    SPECTRAL.format(base=PARTS)
    + " select *, case when density > 0.3 and avg_degree > 5 then 'mesh-like' when max_degree >= n_vertices * 0.5 and avg_degree < 3 then 'star-like' when n_edges <= n_vertices - 1 or density < 0.1 then 'tree-like' else 'hybrid' end as topology, case when n_edges <= n_vertices - 1 then 0.9 else 0.7 end::double as topology_confidence from x",
)
def g10(spark, d):
    return A.topology(A.spectral(V.parts(spark, d)))


@query(
    "a06_cohesion",
    f"{COMMERCE}, x as (select a.community as cs, b.community as ct from e join m a on src = a.id join m b on dst = b.id), s as (select cs as community, case when cs = ct then 1 else 0 end as inside from x union all select ct, 0 from x where cs <> ct) select community, sum(inside)::bigint as n_inside, count(*) as n_touching, avg(inside) as cohesion from s group by community",
)
def a06(spark, d):
    return A.cohesion(V.commerce(spark, d), members(spark, d))


@query(
    "a07_modularity_weighted",
    f"{PARTS}, w as (select src, dst, confidence from e where src <> dst union all select dst, src, confidence from e where src <> dst), x as (select a.community as cs, sum(confidence) as tot, sum(case when a.community = b.community then confidence else 0 end) as ins from w join m a on src = a.id join m b on dst = b.id group by 1), t as (select sum(tot) as mm from x) select round(sum(ins / mm - (tot / mm) * (tot / mm)), 9) as modularity from x, t",
)
def a07(spark, d):
    return A.modularity_weighted(V.parts(spark, d), members(spark, d, V.PART_MEMBERS)).select(F.round("modularity", 9).alias("modularity"))


@query(
    "a08_modularity_directed",
    f"{PARTS}, {DEG}, o as (select d.id, n_in + n_out as k, community from d join m on d.id = m.id), i as (select a.community, 2.0 * count(*) as ins from e join m a on src = a.id join m b on dst = b.id where a.community = b.community group by 1), p as (select community, sum(k) as tot from o group by 1), t as (select 2.0 * count(*) as mm from e) select round(sum(coalesce(ins, 0)::double / mm::double - (tot::double / mm::double) * (tot::double / mm::double)), 9) as modularity from p left join i on p.community = i.community, t",
)
def a08(spark, d):
    return A.modularity_directed(V.parts(spark, d), members(spark, d, V.PART_MEMBERS)).select(F.round("modularity", 9).alias("modularity"))


@query(
    "a09_coverage_rollup",
    f"""{PARTS}, s as ({STATUS}), n as (select community, count(*) as n, count(*) filter (where status = 'covered') as n_covered, count(*) filter (where status = 'partial') as n_partial, count(*) filter (where status = 'uncovered') as n_uncovered from s join m on s.id = m.id group by 1),
    o as (select m.id, community, status = 'covered' as cov from m join s on m.id = s.id), x as (select a.community as cs, b.community as ct, (a.cov and b.cov)::int as both_ from e join o a on src = a.id join o b on dst = b.id), y as (select ct as community, both_ from x union all select cs, both_ from x where cs <> ct), z as (select community, count(*) as n_edges, sum(both_)::bigint as n_edges_covered from y group by 1)
    select n.community, n, n_covered, n_partial, n_uncovered, 100 * n_covered / n as share, coalesce(n_edges, 0) as n_edges, coalesce(n_edges_covered, 0) as n_edges_covered from n left join z on n.community = z.community""",
)
def a09(spark, d):
    return A.coverage_rollup(V.parts(spark, d), status(spark, d), members(spark, d, V.PART_MEMBERS))


@query("a10_coverage_by_label", f"{PARTS}, s as ({STATUS}) select label, count(*) as n, count(*) filter (where status = 'covered') as n_covered from v join s on v.id = s.id group by label")
def a10(spark, d):
    return V.parts(spark, d).vertices.join(status(spark, d), "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "covered").alias("n_covered"))


@query("a12_noisy_or", f"{COMMERCE} select dst, round(1 - product(1 - confidence * 0.5), 9) as p from e where type = 'CALLS' group by dst")
def a12(spark, d):
    e = V.commerce(spark, d).of_types("CALLS").edges.select("dst", (F.col("confidence") * 0.5).alias("p"))
    return A.fused_confidence(e, "dst").select("dst", F.round("p", 9).alias("p"))


SNAPSHOTS = "select cast(ts as date) as day, 50 + avg(value) as health, avg(value) / 100 as cohesion, count(*) as n from events group by 1"


@query(
    "a14_trend",
    f"with s as ({SNAPSHOTS}), x as (select health as y, row_number() over (order by day) - 1 as x from s), r as (select count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as i, regr_r2(y, x) as r2 from x) select n, round(slope, 7) as slope, round(r2, 7) as r2, round(greatest(0, least(100, i + slope * n)), 7) as projected, case when abs(slope) < 0.5 then 'stable' when slope > 0 then 'improving' else 'declining' end as direction from r",
)
def a14(spark, d):
    t = A.trend(V.sql(spark, d, SNAPSHOTS), "day", "health")
    return t.select("n", *(F.round(c, 7).alias(c) for c in ("slope", "r2", "projected")), "direction")


@query("a15_delta_trend", f"with s as ({SNAPSHOTS}), x as (select round(max_by(cohesion, day) - min_by(cohesion, day), 9) as delta from s) select delta, case when delta > 0.05 then 'improving' when delta < -0.05 then 'declining' else 'stable' end as direction from x")
def a15(spark, d):
    return A.delta_trend(V.sql(spark, d, SNAPSHOTS), "day", "cohesion").withColumn("delta", F.round("delta", 9))


@query("k02_snapshot_diff", "select (select count(*) from events where month(ts) = 2) - (select count(*) from events where month(ts) = 1) as n_delta")
def k02(spark, d):
    s = V.sql(spark, d, "select month(ts) as at, count(*) as n from events group by 1 union all select 2 as at, 0 as n from region where r_regionkey < 0")
    s = spark.createDataFrame([(1,), (2,)], "at int").join(s, "at", "left").select("at", F.coalesce("n", F.lit(0)).alias("n"))
    return A.snapshot_diff(s, "at", 1, 2, ["n"])


LIBS = "select s_nationkey as repo, 'f' || s_suppkey as file_path, case when s_suppkey % 3 = 0 then '@lib/' else 'lib/' end || (s_suppkey % 17) as import_path from supplier"


@query(
    "a17_shared_libraries",
    f"with i as ({LIBS}), f as (select distinct import_path, file_path from i), k as (select *, row_number() over (partition by import_path order by file_path) as r from f), l as (select import_path, list(file_path order by file_path) as files from k where r <= 50 group by 1) select i.import_path, count(distinct repo) as n_repos, list_sort(list(distinct repo)) as repos, count(distinct file_path) as n_files, any_value(files) as files, any_value(regexp_matches(i.import_path, '^[.@]')) as internal from i join l on i.import_path = l.import_path group by 1 having count(distinct repo) >= 2",
)
def a17(spark, d):
    return A.shared_libraries(V.sql(spark, d, LIBS)).select("import_path", "n_repos", "repos", "n_files", "files", "internal")


@query(
    "a22_super_nodes",
    f"""{PARTS}, l as (select community, label, count(*) as c from v join m on v.id = m.id group by 1, 2), dom as (select community, sum(c)::bigint as n, max_by(label, lpad(c::varchar, 9, '0') || label) as dominant_label from l group by 1),
    x as (select a.community as cs, b.community as ct, src, dst, confidence from e join m a on src = a.id join m b on dst = b.id), i as (select cs as community, sum(confidence) as w from x where cs = ct group by 1), o as (select community, count(*) as k from (select cs as community from x where cs <> ct union all select ct from x where cs <> ct) group by 1), p as (select ct as community, count(distinct dst) as k from x where cs <> ct group by 1)
    select dom.community, n, dominant_label, round(coalesce(w, 0), 6) as inner_weight, coalesce(o.k, 0) as n_external, coalesce(p.k, 0) as n_entry_points from dom left join i on dom.community = i.community left join o on dom.community = o.community left join p on dom.community = p.community""",
)
def a22(spark, d):
    return A.super_nodes(V.parts(spark, d), members(spark, d, V.PART_MEMBERS)).withColumn("inner_weight", F.round("inner_weight", 6))


@query(
    "a23_meta_edges",
    f"{COMMERCE}, x as (select least(a.community, b.community) as a, greatest(a.community, b.community) as b, confidence from e join m a on src = a.id join m b on dst = b.id where a.community <> b.community) select a, b, round(sum(confidence), 4) as weight, count(*) as n from x group by a, b",
)
def a23(spark, d):
    return A.meta_edges(V.commerce(spark, d), members(spark, d)).withColumn("weight", F.round("weight", 4))


@query("a24_property_groups", "select * from (values ('1-URGENT', 'o_custkey'), ('1-URGENT', 'o_totalprice')) t(label, property) union all select distinct o_orderpriority, c from orders, (values ('o_custkey'), ('o_totalprice')) x(c) where o_orderpriority <> '1-URGENT'")
def a24(spark, d):
    o = V.sql(spark, d, "select o_orderpriority as label, o_custkey, o_totalprice, cast(null as string) as never from orders")
    return A.property_groups(o, ["o_custkey", "o_totalprice", "never"])


@query("a25_standardize", "select p_partkey, round((p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part), 7) as p_size, round((p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part), 7) as p_retailprice from part")
def a25(spark, d):
    rows = V.sql(spark, d, "select p_partkey, p_size, p_retailprice from part")
    return A.standardize(rows, ["p_size", "p_retailprice"]).select("p_partkey", F.round("p_size", 7).alias("p_size"), F.round("p_retailprice", 7).alias("p_retailprice"))


@query("a26_change_risk", "select o_custkey, case when count(*) > 3 then 'high' when count(*) > 0 then 'medium' else 'low' end as risk from orders group by 1")
def a26(spark, d):
    return V.sql(spark, d, "select * from orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("o_custkey", A.risk_of_change(F.lit(1), F.col("n")).alias("risk"))


@query(
    "a27_key_symbols",
    f"{PARTS}, x as (select a.community, src, dst from e join m a on src = a.id join m b on dst = b.id where a.community = b.community), n as (select community, id, count(*) as n from (select community, src as id from x union all select community, dst from x) group by 1, 2), r as (select *, row_number() over (partition by community order by n desc, id) as rank from n) select community, id, n, rank from r where rank <= 5",
)
def a27(spark, d):
    return A.key_symbols(V.parts(spark, d), members(spark, d, V.PART_MEMBERS))


# -- windows, top-k, sets


@query(
    "w02_gaps_per_community",
    f"{PARTS}, s as ({STATUS}), n as (select dst as id, count(*) as n_in from e group by 1 having count(*) >= 2), r as (select community, n.id, n_in, row_number() over (partition by community order by n_in desc, n.id) as rank from n join s on n.id = s.id and status = 'uncovered' join m on n.id = m.id) select community, rank, id, n_in from r where rank <= 5",
)
def w02(spark, d):
    return A.coverage_gaps(V.parts(spark, d), status(spark, d), per=members(spark, d, V.PART_MEMBERS))


@query("w07_last_wins", "select user_id, max_by(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def w07(spark, d):
    from ..model import last_wins

    return last_wins(V.sql(spark, d, "select user_id, event_type, event_id from events"), "user_id", "event_id")


@query("w07b_first_wins", "select user_id, min_by(event_type, event_id) as event_type, min(event_id) as event_id from events group by user_id")
def w07b(spark, d):
    from ..model import first_wins

    return first_wins(V.sql(spark, d, "select user_id, event_type, event_id from events"), "user_id", "event_id")


@query("o02_top_degrees", f"{COMMERCE}, {DEG} select id, n_in + n_out as n_total from d order by n_total desc, id limit 50")
def o02(spark, d):
    return A.degrees(V.commerce(spark, d)).select("id", "n_total").orderBy(F.desc("n_total"), "id").limit(50)


@query("u03_file_changes", "with a as (select doc_id::varchar as p, md5(text) as h from documents where doc_id % 10 <> 0), b as (select doc_id::varchar as p, case when doc_id % 7 = 0 then 'x' else md5(text) end as h from documents where doc_id % 11 <> 0) select coalesce(a.p, b.p) as file_path, case when a.p is null then 'added' when b.p is null then 'deleted' when a.h <> b.h then 'changed' else 'unchanged' end as status from a full join b on a.p = b.p")
def u03(spark, d):
    t = V.sql(spark, d, "select doc_id, cast(doc_id as string) as file_path, md5(text) as hash from documents")
    now = t.where("doc_id % 11 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.lit("x")).otherwise(F.col("hash")))
    return file_changes(t.where("doc_id % 10 <> 0"), now)


@query("u06_undirected_pairs", f"{COMMERCE} select count(*) as n from (select src as a, dst as b from e union select dst, src from e)")
def u06(spark, d):
    return V.commerce(spark, d).undirected().agg(F.count(F.lit(1)).alias("n"))


@query("u07_deduplicate", "select distinct p_brand, p_type from part")
def u07(spark, d):
    return V.sql(spark, d, "select * from part").select("p_brand", "p_type").dropDuplicates()


@query("i05_coalesce_events", "select user_id, max_by(event_type, (ts, event_id)) as event_type, max(ts) as ts, max_by(event_id, (ts, event_id)) as event_id from events group by user_id")
def i05(spark, d):
    return coalesce_events(V.sql(spark, d, "select user_id, event_type, ts, event_id from events"), "user_id", "ts", "event_id")


@query("i09_tumbling_counts", "select user_id as key, time_bucket(interval '60 seconds', ts) as start, count(*) as n, count(*) > 1 as over from events group by 1, 2")
def i09(spark, d):
    return tumbling_counts(V.sql(spark, d, "select user_id, ts from events"), "ts", "user_id", limit=1)


@query("f28_message_budget", "with t as (select conv_id, turn, sum(ceil(length(text) / 4))  over (partition by conv_id order by turn desc)::bigint as used from conversations) select conv_id, turn, used from t where used <= 200")
def f28(spark, d):
    return within_budget(V.sql(spark, d, "select conv_id, turn, text from conversations"), 200).select("conv_id", "turn", "used")
