"""Construction, sources, sinks and incremental operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..model import PropertyGraph
from ..operators import construct as N
from ..sources import readers as I
from ..sources import writers as O
from ..storage import Workspace
from . import query
from .relational import COMMERCE, PARTS, STEPS, TRADE

FILES = "select lang || '/' || source || '/' || doc_id || '.md' as file_path, text as content from documents"


def files(spark, d):
    return V.sql(spark, d, FILES)


@query(
    "e01_structure",
    "with f as (select lang || '/' || source || '/' || doc_id || '.md' as p, lang as a, lang || '/' || source as b from documents), e as (select 'folder:' || b as src, 'file:' || p as dst from f union select 'folder:' || a, 'folder:' || b from f) select src, dst, 'CONTAINS' as type, cast(1 as double) as confidence from e",
)
def e01(spark, d):
    return N.structure(files(spark, d)).edges


@query("e01b_structure_vertices", "with f as (select lang || '/' || source || '/' || doc_id || '.md' as p, lang as a, lang || '/' || source as b from documents) select 'File' as label, count(*) as n from f union all select 'Folder', count(*) from (select a from f union select b from f)")
def e01b(spark, d):
    return N.structure(files(spark, d)).vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("e07_routes", "with h as (select 'p' || page_id || '.html' as file_path, unnest(regexp_extract_all(html, '(?i)<form[^>]*action\\s*=\\s*[''\"]([^''\"]+)[''\"]', 1)) as path from pages) select distinct file_path, 'html-template' as framework, 'GET' as method, path from h")
def e07(spark, d):
    return N.routes(V.sql(spark, d, "select 'p' || page_id || '.html' as file_path, html as content from pages")).where("framework = 'html-template'").select("file_path", "framework", "method", "path")


@query("e16_security_findings", "select doc_id as id, 'AWS Access Key' as rule, 'critical' as severity from documents where regexp_matches(text, 'AKIA[0-9A-Z]{16}') union all select doc_id, 'Generic Secret', 'high' from documents where regexp_matches(text, '(?i)(?:secret|password|token)\\s*[=:]\\s*[''\"][A-Za-z0-9!@#$%^&*]{16,}[''\"]')")
def e16(spark, d):
    found = N.security_findings(V.sql(spark, d, "select doc_id, text from documents"), "doc_id", "text", "high")
    return found.where("rule in ('AWS Access Key', 'Generic Secret')").select("id", "rule", "severity")


@query("e16b_sensitive_text", "select severity, count(*) as n from (select 'medium' as severity from documents where regexp_matches(text, '(?i)\\b(?:encrypt|decrypt|hash|sign|verify|cipher|digest)\\b') union all select 'medium' from documents where regexp_matches(text, '(?i)\\b(?:login|authenticate|authorize|logout|session)\\b')) group by 1")
def e16b(spark, d):
    found = N.security_findings(V.sql(spark, d, "select doc_id, text from documents"), "doc_id", "text", "medium", N.SENSITIVE)
    return found.where("rule in ('auth', 'crypto')").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("e05_raise_confidence", f"{COMMERCE} select type, round(sum(greatest(confidence, case when type = 'USES' then 0.95 when type = 'CALLS' then 0.9 else 0.5 end)), 4) as s from e group by type")
def e05(spark, d):
    e = V.commerce(spark, d).edges.withColumns({"same_file": F.col("type") == "USES", "imported": F.col("type") == "CALLS", "parameters": F.lit(1)})
    return N.raise_confidence(e).groupBy("type").agg(F.round(F.sum("confidence"), 4).alias("s"))


@query("e17_design_patterns")
def e17(spark, d):
    return N.design_patterns(files(spark, d), 0.3)


@query("e12_markdown", "with l as (select lang || '/' || source || '/' || doc_id || '.md' as file_path, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from documents) select file_path, line, length(regexp_extract(l, '^(#{1,6})\\s+(.+)', 1)) as level from l where regexp_matches(l, '^(#{1,6})\\s+(.+)')")
def e12(spark, d):
    return N.markdown_sections(files(spark, d))[0].select("file_path", "line", "level")


@query("s01_file_scan")
def s01(spark, d):
    return I.scan_files(spark, d).select("file_path", "size", "hash")


@query("s06_graph_stats", f"{COMMERCE} select 'label' as kind, label as name, count(*) as n from v group by 2 union all select 'type', type, count(*) from e group by 2")
def s06(spark, d):
    return I.graph_stats(V.commerce(spark, d))


@query("s05_many_graphs", f"{TRADE}, w as ({V.PARTS_V}) select 'trade' as graph_id, count(*) as n from v union all select 'parts', count(*) from w")
def s05(spark, d):
    g = I.load_many({"trade": V.trade(spark, d), "parts": V.parts(spark, d)})
    return g.vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


@query("s10_record_stream", f"{TRADE} select 'node' as kind, id as a, name as b, null as confidence from v union all select 'edge', src, dst, confidence from e")
def s10(spark, d):
    r = I.record_stream(V.trade(spark, d)).withColumn("r", F.from_json("record", "id string, name string, src string, dst string, confidence double"))
    return r.select("kind", F.coalesce("r.id", "r.src").alias("a"), F.coalesce("r.name", "r.dst").alias("b"), "r.confidence")


@query("k01_round_trip", f"{PARTS} select 'v' as kind, label as name, count(*) as n from v group by 2 union all select 'e', type, count(*) from e group by 2")
def k01(spark, d):
    work = Workspace(spark, "graph")
    V.parts(spark, d).save(work.root)
    g = PropertyGraph.load(spark, work.root)
    v = g.vertices.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("v").alias("kind"), "name", "n")
    return v.unionByName(g.edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("e").alias("kind"), "name", "n"))


@query("k04_edge_index", f"{TRADE}, i as (select id, row_number() over (order by id) - 1 as k from v) select a.k as src_index, b.k as dst_index, type, confidence from e join i a on src = a.id join i b on dst = b.id")
def k04(spark, d):
    return O.edge_index(V.trade(spark, d))


@query("k05_graphml", f"{TRADE} select '<node id=\"' || id || '\">' as tag, '<data key=\"name\">' || name || '</data>' as datum from v union all select '<edge source=\"' || src || '\" target=\"' || dst || '\">', '<data key=\"type\">IMPORTS</data>' from e")
def k05(spark, d):
    r = O.graphml_rows(V.trade(spark, d))
    return r.select(F.regexp_extract("xml", "^<[^>]*>", 0).alias("tag"), F.regexp_extract("xml", '<data key="(?:name|type)">[^<]*</data>', 0).alias("datum"))


@query("k09a_community_diagram", f"{COMMERCE}, k as (select community, v.id, name, row_number() over (partition by community order by v.id) as k from v join m on v.id = m.id), c as (select greatest(1, floor(200 / count(distinct community))) as c from m) select community, id, name from k, c where k <= c")
def k09a(spark, d):
    return O.community_diagram(V.commerce(spark, d), V.sql(spark, d, V.MEMBERS))


@query("k09b_process_diagram", f"with s as ({STEPS}), o as (select process, step, max(id) as id from s group by 1, 2), l as (select process, id as src, lead(id) over (partition by process order by step) as dst from o) select process, src, dst from l where dst is not null")
def k09b(spark, d):
    return O.process_diagram(V.sql(spark, d, STEPS))


@query("k09c_dependency_diagram", f"{PARTS} select distinct src, dst, type from e where type in ('CALLS', 'IMPORTS', 'USES', 'ACCESSES', 'EXTENDS', 'IMPLEMENTS') and confidence >= 0.5 order by src, dst, type limit 300")
def k09c(spark, d):
    return O.dependency_diagram(V.parts(spark, d))


@query("k09d_hierarchy_diagram", f"{PARTS}, c as (select id from v where label in ('Class', 'Interface')) select distinct src, dst, type from e where type in ('EXTENDS', 'IMPLEMENTS') and confidence >= 0.5 and (src in (select id from c) or dst in (select id from c)) order by src, dst, type limit 100")
def k09d(spark, d):
    return O.hierarchy_diagram(V.parts(spark, d))


@query("g40_remove_files", f"{COMMERCE}, w as (select id from v where file_path not like 'world/supply/%') select type, count(*) as n from e where src in (select id from w) and dst in (select id from w) group by 1")
def g40(spark, d):
    g = V.commerce(spark, d)
    left = g.remove_files(g.vertices.where("file_path like 'world/supply/%'").select("file_path"))
    return left.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("g40b_upsert", f"{TRADE}, n as (select id, case when id in ('nation:1', 'nation:2') then 'new' else name end as name from v union all select 'nation:99', 'new') select id, name from n")
def g40b(spark, d):
    g = V.trade(spark, d)
    rows = spark.createDataFrame([(i, "Class", "new", "x") for i in ("nation:1", "nation:2", "nation:99")], "id string, label string, name string, file_path string")
    return g.upsert_vertices(rows).vertices.select("id", "name")


@query("i02_refresh", f"{PARTS} select label, count(*) as n from v where file_path <> 'parts/Brand#1/SMALL' group by label")
def i02(spark, d):
    from ..streaming.incremental import refresh

    g = V.parts(spark, d)
    changes = spark.createDataFrame([("parts/Brand#1/SMALL", "deleted"), ("parts/Brand#2/SMALL", "changed")], "file_path string, status string")

    def rebuild(paths):
        v = g.vertices.join(paths, "file_path", "left_semi")
        ids = v.select("id")
        e = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*g.edges.columns)
        return PropertyGraph(v.select(*g.vertices.columns), e)

    return refresh(g, changes, rebuild).vertices.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


#: Orders handle routes (their priority) and tools (their status); customers call orders; regions of customers fetch routes.
API_V = "select 'order:' || o_orderkey as id, 'Function' as label, o_orderpriority as name, 'api/' || o_orderstatus as file_path from orders"
API_E = """
select 'order:' || o_orderkey as src, 'route:' || o_orderpriority || (o_custkey % 50) as dst, 'HANDLES_ROUTE' as type, cast(0.7 as double) as confidence from orders where o_orderstatus = 'F'
union all select 'order:' || o_orderkey, 'tool:' || o_orderpriority, 'HANDLES_TOOL', cast(0.6 as double) from orders where o_orderstatus = 'P'
union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'CALLS', cast(0.9 as double) from orders
union all select 'nation:' || c_nationkey, 'route:5-LOW' || (c_custkey % 50), 'FETCHES', cast(0.7 as double) from customer
"""
API = f"with v as ({API_V}), e as ({API_E}), h as (select src as handler, dst as route from e where type = 'HANDLES_ROUTE'), rc as (select route, handler, src as consumer from h join e on handler = dst and type = 'CALLS' union select h.route, handler, src from h join e on h.route = dst and type = 'FETCHES')"


@query("j19_route_consumers", f"{API} select route, handler, consumer from rc")
def j19(spark, d):
    from ..operators.api import route_consumers

    return route_consumers(V.graph(spark, d, API_V, API_E))


@query("j20_tool_callers", f"{API}, t as (select src as handler, dst as tool from e where type = 'HANDLES_TOOL') select distinct tool, handler, src as caller from t left join e on handler = dst and type = 'CALLS'")
def j20(spark, d):
    from ..operators.api import tool_callers

    return tool_callers(V.graph(spark, d, API_V, API_E))


@query(
    "j21_api_impact",
    f"{API}, r as (select src as id, count(distinct dst) as n from e where type = 'HANDLES_ROUTE' group by 1), t as (select src as id, count(distinct dst) as n from e where type = 'HANDLES_TOOL' group by 1), c as (select handler as id, count(distinct consumer) as n from rc group by 1), x as (select v.id, coalesce(r.n, 0) as n_routes, coalesce(t.n, 0) as n_tools, coalesce(c.n, 0) as n_consumers from v left join r on v.id = r.id left join t on v.id = t.id left join c on v.id = c.id) select *, case when n_routes + n_tools = 0 then 'internal' when n_consumers > 0 then 'exposed' else 'unused' end as status from x",
)
def j21(spark, d):
    from ..operators.api import api_impact

    g = V.graph(spark, d, API_V, API_E)
    return api_impact(g, g.vertices)


@query(
    "j29_wrap_routes",
    "with u as (select distinct 'route:' || p_brand as route, p_type as middleware from part), k as (select p_type as middleware, min('fn:' || p_partkey) as id from part where p_type <> 'SMALL' group by 1) select coalesce(id, 'middleware:' || u.middleware) as src, route as dst, 'WRAPS' as type, case when id is null then 0.7 else 0.8 end::double as confidence from u left join k on u.middleware = k.middleware",
)
def j29(spark, d):
    from ..operators.api import wrap_routes

    uses = V.sql(spark, d, "select 'route:' || p_brand as route, p_type as middleware from part")
    return wrap_routes(uses, V.sql(spark, d, "select 'fn:' || p_partkey as id, p_type as name from part where p_type <> 'SMALL'"))[1]


@query(
    "j28_type_edges",
    """with d as (select 'c' || c_custkey as id, 'f' || c_nationkey as file_path, 'T' || (c_custkey % 9) as type_name, case when c_custkey % 2 = 0 then 'RETURNS_TYPE' else 'DECLARES_TYPE' end as kind from customer),
    t as (select 's' || s_suppkey as type_id, 'T' || (s_suppkey % 9) as type_name, 'f' || s_nationkey as loc from supplier), i as (select 'f' || n_nationkey as src, 'f' || (n_nationkey + 5) as dst from nation),
    v as (with recursive p(root, loc, k) as (select distinct file_path, file_path, 0 from d union select root, dst, k + 1 from p join i on loc = src) select root, loc, k from p),
    h as (select d.id as src, kind as type, type_id, row_number() over (partition by d.id, kind order by k > 0, type_id) as r from d join v on d.file_path = v.root join t on t.loc = v.loc and t.type_name = d.type_name) select src, type_id as dst, type from h where r = 1""",
)
def j28(spark, d):
    from ..operators.api import type_edges

    declared = V.sql(spark, d, "select 'c' || c_custkey as id, 'f' || c_nationkey as file_path, 'T' || (c_custkey % 9) as type_name, case when c_custkey % 2 = 0 then 'RETURNS_TYPE' else 'DECLARES_TYPE' end as kind from customer")
    types = V.sql(spark, d, "select 's' || s_suppkey as id, 'T' || (s_suppkey % 9) as name, 'f' || s_nationkey as file_path from supplier")
    return type_edges(declared, types, V.sql(spark, d, "select 'f' || n_nationkey as file_path, 'f' || (n_nationkey + 5) as target_path from nation "))
