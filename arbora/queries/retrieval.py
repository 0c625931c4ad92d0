"""Search, vectors and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views as V
from ..functions import scalar as S
from ..functions import text as X
from ..operators import aggregates as A
from ..search import ranking as R
from . import query
from .relational import COMMERCE

DOCS = "select cast(doc_id as string) as id, text from documents"
WORDS = "w as (select doc_id::varchar as id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from documents), p as (select id, term, count(*) as tf from w group by 1, 2), n as (select id, sum(tf) as len from p group by 1), st as (select count(*)::double as n, avg(len) as mean from n)"


def docs(spark, d):
    return V.sql(spark, d, DOCS)


@query("r01_postings", f"with {WORDS} select id, term, tf from p")
def r01(spark, d):
    return R.postings(docs(spark, d))


def bm25_sql(terms: list[str], limit: int) -> str:
    hit = " union all ".join(f"select id, {k} as q, sum(tf) as tf from p where starts_with(term, '{t}') group by id" for k, t in enumerate(terms))
    return f"with {WORDS}, h as ({hit}), df as (select q, count(*)::double as df from h group by 1), s as (select h.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score, count(*) as k from h join df on h.q = df.q join n on h.id = n.id, st group by 1) select id, round(score, 7) as score from s where k = {len(terms)} order by round(score, 9) desc, id limit {limit}"


@query("r02_bm25_search", bm25_sql(["tion", "thblee"], 20))
def r02(spark, d):
    return R.bm25_search(R.postings(docs(spark, d)), "tion thblee", 20).select("id", F.round("score", 7).alias("score"))


@query("r02b_bm25_stemmed")
def r02b(spark, d):
    return R.bm25_search(R.word_rows(docs(spark, d), stemming=True), "thering andings", 20, stemming=True)


STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS = f"t as (select doc_id::varchar as id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 1 and not list_contains([{STOPS}], x))) as term from documents)"
TFIDF = f"with {TOKENS}, c as (select id, term, count(*) as c from t group by 1, 2), l as (select id, sum(c) as len from c group by 1), df as (select term, count(*)::double as df from c group by 1), nn as (select count(*)::double as n from documents), w as (select c.id, c.term, c / len * ln(n / (df + 1)) as w, df from c join l on c.id = l.id join df on c.term = df.term, nn), nm as (select id, case when sqrt(sum(w * w)) = 0 then 1 else sqrt(sum(w * w)) end as norm from w group by 1)"


@query("a19_tfidf_weights", f"{TFIDF} select term, count(*) as n, round(sum(w), 6) as w from w group by term")
def a19(spark, d):
    return R.TfidfIndex(docs(spark, d)).weights.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 6).alias("w"))


@query(
    "r04_tfidf_search",
    f"{TFIDF}, q as (select term, count(*) as c from (values ('thblees'), ('sotion'), ('idiot'), ('idiot'), ('worthless'), ('clown')) x(term) group by 1), qw as (select q.term, c * ln((n + 1) / (df + 1)) as qw from q join df on q.term = df.term, nn), qn as (select sqrt(sum(qw * qw)) as qn from qw), s as (select w.id, sum(w * qw) as dot, count(*) as n_terms from w join qw on w.term = qw.term group by 1) select s.id, round(dot / (norm * qn), 7) as score, n_terms from s join nm on s.id = nm.id, qn where dot > 0 order by round(dot / (norm * qn), 9) desc, s.id limit 10",
)
def r04(spark, d):
    return R.TfidfIndex(docs(spark, d)).search("thblees sotion idiot idiot worthless clown").select("id", F.round("score", 7).alias("score"), "n_terms")


def first_vector(spark, d):
    return [float(x) for x in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").select("embedding").first()[0]]


COSQ = "list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))"


@query("r05_vector_search", f"select e.vec_id as id, round({COSQ}, 7) as score from embeddings e, embeddings q where q.vec_id = 0 order by round({COSQ}, 9) desc, e.vec_id limit 10")
def r05(spark, d):
    v = V.sql(spark, d, "select vec_id as id, embedding as vector from embeddings")
    return R.vector_search(v, first_vector(spark, d), 10).select("id", F.round("score", 7).alias("score"))


FUSED = bm25_sql(["tion"], 50).replace("select id, round(score, 7) as score from s", "select id, row_number() over (order by round(score, 9) desc, id) as r from s").replace("order by round(score, 9) desc, id limit 50", "qualify r <= 50")


@query(
    "r06_hybrid_search",
    f"with a as ({FUSED}), b as (select e.vec_id::varchar as id, row_number() over (order by round({COSQ}, 9) desc, e.vec_id::varchar) as r from embeddings e, embeddings q where q.vec_id = 0 qualify r <= 50) select coalesce(a.id, b.id) as id, round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0), 9) as score from a full join b on a.id = b.id order by score desc, 1 limit 20",
)
def r06(spark, d):
    v = V.sql(spark, d, "select cast(vec_id as string) as id, embedding as vector from embeddings")
    keyword = R.bm25_search(R.postings(docs(spark, d)), "tion", 50)
    return R.fuse(keyword, R.vector_search(v, first_vector(spark, d), 50)).select("id", F.round("score", 9).alias("score"))


@query(
    "r07_cohesion_boost",
    f"{COMMERCE}, x as (select a.community as cs, b.community as ct from e join m a on src = a.id join m b on dst = b.id), s as (select cs as community, case when cs = ct then 1 else 0 end as i from x union all select ct, 0 from x where cs <> ct), c as (select community, avg(i) as cohesion from s group by 1), o as (select id, max(community) as community from m group by 1) select v.id, round(length(name) * (1 + 0.15 * coalesce(cohesion, 0)), 7) as score from v left join o on v.id = o.id left join c on o.community = c.community where label = 'Class'",
)
def r07(spark, d):
    g, m = V.commerce(spark, d), V.sql(spark, d, V.MEMBERS)
    hits = g.vertices.where("label = 'Class'").select("id", F.length("name").cast("double").alias("score"))
    return R.boost_by_cohesion(hits, m, A.cohesion(g, m)).select("id", F.round("score", 7).alias("score"))


@query("r08_process_hits", "select 'order:' || l_orderkey as process, count(distinct l_partkey) as n_symbols from lineitem join part on l_partkey = p_partkey where p_name = 'blue bolt' group by 1")
def r08(spark, d):
    from ..operators.joins import members_by_process

    hits = V.commerce(spark, d).vertices.where("label = 'Function' and name = 'blue bolt'")
    steps = V.sql(spark, d, "select 'order:' || l_orderkey as process, 'part:' || l_partkey as id from lineitem")
    return members_by_process(hits, steps).select("process", "n_symbols")


@query("r09_context_boost", f"{COMMERCE} select id, (1 + least(0.5, case when contains(lower(name), 'red') then 0.1 else 0 end + case when contains(lower(file_path), 'red') then 0.05 else 0 end + case when contains(lower(name), 'bolt') then 0.1 else 0 end + case when contains(lower(file_path), 'bolt') then 0.05 else 0 end))::double as score from v where label = 'Function'")
def r09(spark, d):
    v = V.commerce(spark, d).vertices.where("label = 'Function'").withColumn("score", F.lit(1.0))
    return R.boost_by_context(v, ["red", "bolt"]).select("id", "score")


@query("r10_stale_embeddings", "select doc_id::varchar as id, sha1(text) as hash from documents where length(text) >= 3 and doc_id % 3 <> 0")
def r10(spark, d):
    t = docs(spark, d)
    stored = t.where("cast(id as bigint) % 3 = 0").select("id", F.sha1("text").alias("hash"))
    return R.stale_embeddings(t, stored).select("id", "hash")


# -- functions


@query("f01_tokens", f"with {TOKENS} select id, count(*) as n, count(distinct term) as n_distinct from t group by id")
def f01(spark, d):
    return docs(spark, d).select("id", F.explode(X.tokens(F.col("text"))).alias("t")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("n_distinct"))


@query("f02_key_terms", f"select p_partkey, list_sort(list_filter(regexp_split_to_array(lower(p_name || ' of the ' || p_type || ' to find a p1 by'), '[^a-z0-9_]+'), lambda x: length(x) > 1 and x not in ('of', 'the', 'to', 'find', 'by'))) as terms from part")
def f02(spark, d):
    return V.sql(spark, d, "select p_partkey, p_name || ' of the ' || p_type || ' to find a p1 by' as t from part").select("p_partkey", F.sort_array(X.key_terms(F.col("t"))).alias("terms"))


@query("f04_porter_stem")
def f04(spark, d):
    return docs(spark, d).select(F.explode(X.tokens(F.col("text"))).alias("t")).distinct().select("t", X.stem("t").alias("stem"))


@query("f05_snippet", "select p_partkey, regexp_replace(p_name, '(?i)(bolt)', '<b>\\1</b>', 'g') as s from part where contains(p_name, 'bolt')")
def f05(spark, d):
    return V.sql(spark, d, "select * from part where contains(p_name, 'bolt')").select("p_partkey", X.snippet(F.col("p_name"), "bolt").alias("s"))


@query("f06_cosine", f"select a.vec_id as a, b.vec_id as b, round({COSQ.replace('e.', 'a.').replace('q.', 'b.')}, 7) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def f06(spark, d):
    v = V.sql(spark, d, "select vec_id, embedding from embeddings")
    a, b = v.toDF("a", "va"), v.toDF("b", "vb")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(S.cosine(F.col("va"), F.col("vb")), 7).alias("c"))


CODE_POINTS = "[ascii(c) for c in string_split(w, '')]"
HASH = f"list_reduce([0::bigint] || {CODE_POINTS}, lambda h, c: (h * 31 + c) % 4294967296)"


@query(
    "f07_bag_of_words",
    f"with t as (select p_partkey as id, unnest(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: length(x) > 1)) as w from part), h as (select id, {HASH} as h from t), s as (select id, abs(case when h >= 2147483648 then h - 4294967296 else h end) % 8 as s, count(*)::double as c from h group by 1, 2), n as (select id, sqrt(sum(c * c)) as n from s group by 1) select id, s::bigint as slot, round(c / n, 9) as x from s join n using (id)",
)
def f07(spark, d):
    t = V.sql(spark, d, "select p_partkey as id, p_name || ' ' || p_type as t from part")
    v = t.select("id", X.bag_of_words(X.plain_tokens(F.col("t")), 8).alias("v")).select("id", F.posexplode("v").alias("slot", "x")).where("x > 0")
    return v.select("id", F.col("slot").cast("bigint").alias("slot"), F.round("x", 9).alias("x"))


@query("f10_hashes", "select doc_id::varchar as id, sha256(text) as h, sha1(text) as s from documents")
def f10(spark, d):
    return docs(spark, d).select("id", F.sha2("text", 256).alias("h"), F.sha1("text").alias("s"))


@query("f11_decay", "select l_linenumber as depth, round(exp(-0.3 * (l_linenumber - 1)), 9) as e, round(1 / log2(l_linenumber + 1), 9) as l from lineitem group by 1")
def f11(spark, d):
    t = V.sql(spark, d, "select distinct l_linenumber as depth from lineitem")
    one = F.lit(1.0)
    return t.select("depth", F.round(S.distance_decay(one, F.col("depth"), "exponential"), 9).alias("e"), F.round(S.distance_decay(one, F.col("depth"), "logarithmic"), 9).alias("l"))


@query("f12_paths", f"{COMMERCE} select id, regexp_extract(file_path, '^(.*)/[^/]*$', 1) as dir, split_part(file_path, '/', -1) as base from v")
def f12(spark, d):
    return V.commerce(spark, d).vertices.select("id", S.dirname(F.col("file_path")).alias("dir"), S.basename(F.col("file_path")).alias("base"))


@query("f19_one_hot", "select p_partkey, [case when p_type = t then 1 else 0 end for t in ['ECONOMY', 'SMALL', 'LARGE']] as h from part")
def f19(spark, d):
    return V.sql(spark, d, "select * from part").select("p_partkey", S.one_hot(F.col("p_type"), ["ECONOMY", "SMALL", "LARGE"]).alias("h"))


@query("f21_round_half_up", "select event_id, floor(-value * 10 + 0.5) / 10 as r from events")
def f21(spark, d):
    return V.sql(spark, d, "select event_id, value from events").select("event_id", S.round_half_up(-F.col("value"), 1).alias("r"))


@query("f25_json", "select event_id, json_extract(props, '$.k')::bigint as k from events")
def f25(spark, d):
    return V.sql(spark, d, "select event_id, props from events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("f27_mermaid", "select p_partkey, regexp_replace(p_name || '[' || p_brand || ']', '[^A-Za-z0-9_]', '_', 'g') as i, regexp_replace(p_name || '[' || p_brand || ']', '[\"\\[\\]{}()<>|]', '', 'g') as l from part")
def f27(spark, d):
    t = V.sql(spark, d, "select p_partkey, p_name || '[' || p_brand || ']' as n from part")
    return t.select("p_partkey", S.mermaid_id(F.col("n")).alias("i"), S.mermaid_label(F.col("n")).alias("l"))


@query("f09_node_text", "select doc_id, sha1(case when doc_id % 3 = 0 or length(text) = 0 then 'Section: ' || source else substr(text, 1, 2048) end) as hash from documents")
def f09(spark, d):
    t = V.sql(spark, d, "select doc_id, source, case when doc_id % 3 = 0 then null else text end as text from documents")
    return t.select("doc_id", F.sha1(X.node_text(F.col("text"), F.lit("Section"), F.col("source"))).alias("hash"))


@query(
    "r03_update_index",
    "with t as (select doc_id::varchar as id, case when doc_id % 5 = 0 then 'fresh fresh words' else text end as text from documents where doc_id % 7 <> 0), w as (select id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from t) select id, term, count(*) as tf from w group by 1, 2",
)
def r03(spark, d):
    index = R.postings(docs(spark, d))
    changed = V.sql(spark, d, "select cast(doc_id as string) as id, 'fresh fresh words' as text from documents where doc_id % 5 = 0 and doc_id % 7 <> 0")
    return R.update_postings(index, changed, V.sql(spark, d, "select cast(doc_id as string) as id from documents where doc_id % 7 = 0"))


@query(
    "r11_provider_chain",
    "select vec_id as id, case when vec_id % 3 = 0 then 0 when vec_id % 5 = 0 then 1 else -1 end as provider, round(case when vec_id % 3 = 0 or vec_id % 5 = 0 then embedding[1]::double else 0 end, 7) as x from embeddings",
)
def r11(spark, d):
    v = V.sql(spark, d, "select vec_id as id, embedding as vector from embeddings")
    dims = len(first_vector(spark, d))
    remote = v.where("id % 3 = 0").unionByName(v.where("id % 3 = 1").select("id", F.slice("vector", 1, 3).alias("vector")))
    out = R.first_vectors(v, [remote, v.where("id % 5 = 0")], dims)
    return out.select("id", "provider", F.round(F.col("vector")[0], 7).alias("x"))


PART_WORDS = "w as (select 'part:' || p_partkey as id, unnest(regexp_extract_all(lower('part:' || p_partkey || ' Function ' || p_name || ' world/parts/' || p_brand), '[a-z0-9_]+')) as term from part), p as (select id, term, count(*) as tf from w group by 1, 2), n as (select id, sum(tf) as len from p group by 1), st as (select count(*)::double as n, avg(len) as mean from n)"


@query(
    "r15_retrieve_context",
    f"with {PART_WORDS}, h as (select id, 0 as q, sum(tf) as tf from p where starts_with(term, 'red') group by id union all select id, 1, sum(tf) from p where starts_with(term, 'bolt') group by id), df as (select q, count(*)::double as df from h group by 1), s as (select h.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score, count(*) as k from h join df on h.q = df.q join n on h.id = n.id, st group by 1), r as (select id, score, row_number() over (order by round(score, 9) desc, id) as place from s where k = 2 qualify place <= 10) select place, id, place || '. **' || p_name || '** (Function) in `world/parts/' || p_brand || '` [score: ' || printf('%.3f', score) || ']' as line from r join part on id = 'part:' || p_partkey",
)
def r15(spark, d):
    v = V.commerce(spark, d).vertices.where("label = 'Function'")
    return R.retrieve_context(v, "red bolt").select("place", "id", "line")
