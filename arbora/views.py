"""Graph views over the driver's tables, defined by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .model import PropertyGraph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Vertices (id, label, name, file_path) of the trade hierarchy.
COMMERCE_V = """
select 'region:' || r_regionkey as id, 'Project' as label, r_name as name, 'world/' || r_name as file_path from region
union all select 'nation:' || n_nationkey, 'Package', n_name, 'world/' || r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey
union all select 'supplier:' || s_suppkey, 'Class', s_name, 'world/supply/' || s_nationkey from supplier
union all select 'customer:' || c_custkey, 'Module', c_name, 'world/demand/' || c_nationkey from customer
union all select 'order:' || o_orderkey, 'Method', o_orderpriority, 'world/orders/' || o_orderstatus from orders
union all select 'part:' || p_partkey, 'Function', p_name, 'world/parts/' || p_brand from part
"""
#: Edges (src, dst, type, confidence): one CALLS edge per line item.
COMMERCE_E = """
select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst, 'CONTAINS' as type, cast(1.0 as double) as confidence from nation
union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS', cast(1.0 as double) from supplier
union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS', cast(1.0 as double) from customer
union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'HAS_METHOD', cast(1.0 as double) from orders
union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'CALLS', round(1 - l_discount, 2) from lineitem
union all select 'part:' || l_partkey, 'supplier:' || l_suppkey, 'USES', round(1 - avg(l_discount), 6) from lineitem group by l_partkey, l_suppkey
"""
#: Nations; imports from the three greatest supplying nations of each.
TRADE_V = "select 'nation:' || n_nationkey as id, 'Class' as label, n_name as name, 'world/' || n_regionkey as file_path from nation"
TRADE_E = """
select src, dst, 'IMPORTS' as type, round(n / t, 6) as confidence from (
  select src, dst, n, cast(sum(n) over (partition by src) as double) as t, row_number() over (partition by src order by n desc, dst) as k from (
    select 'nation:' || c_nationkey as src, 'nation:' || s_nationkey as dst, count(*) as n
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
    where c_nationkey <> s_nationkey group by c_nationkey, s_nationkey) x) y where k <= 3
"""
#: Parts of one brand and type call the next larger ones: many small components with cycles and chains.
PARTS_V = "select 'part:' || p_partkey as id, case when p_size % 3 = 0 then 'Class' when p_size % 3 = 1 then 'Method' else 'Function' end as label, p_name as name, 'parts/' || p_brand || '/' || p_type as file_path from part"
PARTS_E = """
select 'part:' || p_partkey as src, 'part:' || nxt as dst, case when p_partkey % 4 = 0 then 'EXTENDS' when p_partkey % 4 = 1 then 'IMPORTS' else 'CALLS' end as type, cast(0.5 + (p_partkey % 5) / 10.0 as double) as confidence from (
  select p_partkey, lead(p_partkey, 1) over w as nxt from part window w as (partition by p_brand, p_type order by p_size, p_partkey)) a where nxt is not null
union all
select 'part:' || p_partkey, 'part:' || nxt, 'CALLS', cast(0.9 as double) from (
  select p_partkey, lead(p_partkey, 2) over w as nxt from part window w as (partition by p_brand, p_type order by p_size, p_partkey)) b where nxt is not null and p_partkey % 2 = 0
union all
select 'part:' || nxt, 'part:' || p_partkey, 'CALLS', cast(0.7 as double) from (
  select p_partkey, lead(p_partkey, 3) over w as nxt from part window w as (partition by p_brand, p_type order by p_size, p_partkey)) c where nxt is not null and p_partkey % 7 = 0
"""
#: Communities given from outside: the nation of suppliers and customers, the brand of parts.
MEMBERS = """
select 'supplier:' || s_suppkey as id, 'community:' || s_nationkey as community from supplier
union all select 'customer:' || c_custkey, 'community:' || c_nationkey from customer
union all select 'part:' || p_partkey, 'community:' || substr(p_brand, 7) from part
"""
PART_MEMBERS = "select 'part:' || p_partkey as id, 'community:' || substr(p_brand, 7) as community from part"


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables, under their own names."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    import re

    register(spark, sf_dir, tuple(n for n in TABLES if re.search(rf"\b{n}\b", text)))
    return spark.sql(text)


def graph(spark: SparkSession, sf_dir: str, vertices: str, edges: str) -> PropertyGraph:
    return PropertyGraph(sql(spark, sf_dir, vertices), sql(spark, sf_dir, edges))


def commerce(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return graph(spark, sf_dir, COMMERCE_V, COMMERCE_E)


def trade(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return graph(spark, sf_dir, TRADE_V, TRADE_E)


def parts(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return graph(spark, sf_dir, PARTS_V, PARTS_E)
