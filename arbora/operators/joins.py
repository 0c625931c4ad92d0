"""Joins of the graph with its own vertices, communities, processes, files and other graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine, dirname, dotted_to_path, without_extension
from ..model import PropertyGraph
from ..plans.rewrites import interval_join, near_vectors, nearest_join, set_similarity_join


def named_edges(g: PropertyGraph) -> DataFrame:
    """Edges with the names of both ends; an end without a vertex shows its id."""
    names = g.vertices.select("id", "name")
    s, t = names.toDF("src", "sn"), names.toDF("dst", "tn")
    e = g.edges.join(s, "src", "left").join(t, "dst", "left")
    return e.select("src", "dst", "type", "confidence", F.coalesce("sn", "src").alias("src_name"), F.coalesce("tn", "dst").alias("dst_name"))


def attach(rows: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Left outer: metrics, embeddings or other columns by key."""
    return rows.join(extra, keys, "left")


def members_by_process(hits: DataFrame, steps: DataFrame) -> DataFrame:
    """Hits (id) grouped by the processes (process, id, step) they are steps of."""
    return steps.join(hits.select("id").distinct(), "id", "left_semi").groupBy("process").agg(F.sort_array(F.collect_set("id")).alias("symbols"), F.count_distinct("id").alias("n_symbols"))


def outside_processes(hits: DataFrame, in_process: DataFrame) -> DataFrame:
    """Hits that no process holds, by (file_path, name)."""
    return hits.join(in_process.select("file_path", "name").distinct(), ["file_path", "name"], "left_anti")


def changed_symbols(g: PropertyGraph, paths: DataFrame, steps: DataFrame) -> DataFrame:
    """Symbols in the changed files (file_path) and how many processes each takes part in."""
    v = g.vertices.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("id", "name", "file_path")
    n = steps.groupBy("id").agg(F.count_distinct("process").alias("n_processes"))
    return v.join(n, "id", "left").withColumn("n_processes", F.coalesce("n_processes", F.lit(0)))


def community_of(members: DataFrame, seq: str | None = None) -> DataFrame:
    """(id, community): of several memberships the last by seq, or the greatest community."""
    pick = F.max_by("community", seq) if seq else F.max("community")
    return members.groupBy("id").agg(pick.alias("community"))


def resolve_imports(imports: DataFrame, symbols: DataFrame, wildcard: bool = False) -> DataFrame:
    """Import (import_id, module_path, names) to symbol (id, name, file_path).

    A symbol is meant if its file without extension is the module path, or its
    file lies directly in the directory of that name; without wildcard its name
    must be among the imported ones. Both conditions are equi-joins on derived
    keys. confidence: 0.8, or 0.6 for wildcards. A wildcard's edges are many and, where
    an import has one module path, distinct as they are, so only the others are compared.
    """
    module = dotted_to_path(F.col("module_path"))
    s = symbols.select("id", "name", "file_path")
    by_file = s.withColumn("key", without_extension(F.col("file_path")))
    by_dir = s.withColumn("key", dirname(F.col("file_path")))
    if wildcard:
        i = imports.select("import_id", module.alias("key")).distinct()
        n = i.groupBy("import_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
        several = i.join(n.where("n > 1").select("import_id"), "import_id", "left_semi")
        s = by_file.unionByName(by_dir).select("id", "key").distinct()
        pairs = lambda some: some.join(s, "key").select(F.col("import_id").alias("src"), F.col("id").alias("dst"))
        hit = pairs(n.where("n = 1")).unionByName(pairs(several).distinct())
    else:
        i = imports.select("import_id", "names", module.alias("key"))
        hit = i.join(by_file, "key").unionByName(i.join(by_dir, "key")).where(F.array_contains("names", F.col("name")))
        hit = hit.select(F.col("import_id").alias("src"), F.col("id").alias("dst")).distinct()
    return hit.withColumn("type", F.lit("USES")).withColumn("confidence", F.lit(0.6 if wildcard else 0.8))


def enclosing_functions(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Call site (call_id, file_path, line) to the innermost function (id, file_path, start_line, end_line)."""
    f = functions.select(F.col("id").alias("function_id"), "file_path", "start_line", "end_line")
    return interval_join(calls, f, ["file_path"], "line", "start_line", "end_line").select("call_id", "function_id")


def owners(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Member (id, file_path, start_line) to the innermost class around it."""
    m = members.select(F.col("id").alias("member_id"), "file_path", F.col("start_line").alias("at"))
    c = classes.select(F.col("id").alias("class_id"), "file_path", "start_line", "end_line")
    return interval_join(m, c, ["file_path"], "at", "start_line", "end_line").where("member_id <> class_id").select("member_id", "class_id")


def bind_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Call (call_id, caller, callee, file_path) to a function (id, name, file_path): same file 0.9, imported file 0.8, any 0.4.

    Of several candidates of a tier the smallest id counts. imports: (file_path, target_path).
    """
    f = functions.select("id", F.col("name").alias("callee"), F.col("file_path").alias("at"))
    same = f.groupBy("callee", F.col("at").alias("file_path")).agg(F.min("id").alias("same"))
    through = imports.join(f, imports["target_path"] == f["at"]).groupBy("file_path", "callee").agg(F.min("id").alias("imported"))
    anywhere = f.groupBy("callee").agg(F.min("id").alias("anywhere"))
    out = calls.join(same, ["callee", "file_path"], "left").join(through, ["file_path", "callee"], "left").join(anywhere, "callee", "left")
    tier = F.when(F.col("same").isNotNull(), 0.9).when(F.col("imported").isNotNull(), 0.8).otherwise(0.4)
    return out.select("call_id", F.col("caller").alias("src"), F.coalesce("same", "imported", "anywhere").alias("dst"), tier.alias("confidence")).where("dst is not null")


def match_routes(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """Url (url_id, path) to route (route_id, pattern): equal segment counts, ``:x`` or ``{x}`` match any segment.

    The join is on the segment count and, for routes with a fixed first segment, on that too.
    """
    parts = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    u = urls.select("url_id", parts(F.col("path")).alias("us")).withColumn("n", F.size("us"))
    r = routes.select("route_id", parts(F.col("pattern")).alias("rs")).withColumn("n", F.size("rs"))
    free = lambda s: F.startswith(s, F.lit(":")) | F.startswith(s, F.lit("{"))
    first = F.coalesce(F.try_element_at("rs", F.lit(1)), F.lit(""))
    r = r.withColumn("head", F.when(free(first), F.lit("*")).otherwise(first))
    both = F.array_distinct(F.array(F.coalesce(F.try_element_at("us", F.lit(1)), F.lit("")), F.lit("*")))
    u = u.withColumn("head", F.explode(both))
    fits = F.forall(F.zip_with("us", "rs", lambda a, b: (a == b) | free(b)), lambda x: x)
    return u.join(r, ["n", "head"]).where(fits).select("url_id", "route_id").distinct()


def match_http_contracts(providers: DataFrame, consumers: DataFrame, least: float = 0.3) -> DataFrame:
    """Provider and consumer (repo, path) of different repos whose path segments have Jaccard over ``least``."""
    p = providers.select(F.col("repo").alias("provider_repo"), F.col("path").alias("provider_path")).distinct()
    c = consumers.select(F.col("repo").alias("consumer_repo"), F.col("path").alias("consumer_path")).distinct()
    parts = lambda c: F.array_distinct(F.filter(F.split(c, "/"), lambda s: s != ""))
    paths = p.select(F.col("provider_path").alias("path")).union(c.select("consumer_path")).distinct()
    near = set_similarity_join(paths.select("path", F.explode(parts(F.col("path"))).alias("segment")), "path", "segment", least, strict=True)
    both = near.select(F.col("a").alias("provider_path"), F.col("b").alias("consumer_path"), "jaccard")
    both = both.unionByName(near.select(F.col("b").alias("provider_path"), F.col("a").alias("consumer_path"), "jaccard"))
    both = both.unionByName(paths.where(F.size(parts(F.col("path"))) > 0).select(F.col("path").alias("provider_path"), F.col("path").alias("consumer_path"), F.lit(1.0).alias("jaccard")))
    return both.join(p, "provider_path").join(c, "consumer_path").where("provider_repo <> consumer_repo")


def match_grpc(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Equal service base names (case and the endings Service, Client, Grpc, Stub aside), different repos, confidence 0.7."""
    base_of = lambda c: F.regexp_replace(F.lower(c), "(service|client|grpc|stub)+$", "").alias("base")
    p = providers.select(F.col("repo").alias("provider_repo"), F.col("service").alias("provider_service")).distinct().select("*", base_of("provider_service"))
    c = consumers.select(F.col("repo").alias("consumer_repo"), F.col("service").alias("consumer_service")).distinct().select("*", base_of("consumer_service"))
    return p.join(c, "base").where("provider_repo <> consumer_repo").select("provider_repo", "provider_service", "consumer_repo", "consumer_service").withColumn("confidence", F.lit(0.7))


def match_topics(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Equal topics, case aside, different repos, confidence 0.8."""
    p = producers.select(F.col("repo").alias("producer_repo"), F.lower("topic").alias("topic")).distinct()
    c = consumers.select(F.col("repo").alias("consumer_repo"), F.lower("topic").alias("topic")).distinct()
    return p.join(c, "topic").where("producer_repo <> consumer_repo").withColumn("confidence", F.lit(0.8))


def cross_links(http: DataFrame, grpc: DataFrame, topics: DataFrame) -> DataFrame:
    """All links between repos: kind, provider_repo, provider, consumer_repo, consumer, confidence (of paths: their Jaccard)."""
    row = lambda df, kind, a, b, c, d, score: df.select(F.lit(kind).alias("kind"), F.col(a).alias("provider_repo"), F.col(b).alias("provider"), F.col(c).alias("consumer_repo"), F.col(d).alias("consumer"), F.col(score).cast("double").alias("confidence"))
    out = row(http, "http", "provider_repo", "provider_path", "consumer_repo", "consumer_path", "jaccard")
    out = out.unionByName(row(grpc, "grpc", "provider_repo", "provider_service", "consumer_repo", "consumer_service", "confidence"))
    return out.unionByName(row(topics, "topic", "producer_repo", "topic", "consumer_repo", "topic", "confidence"))


def contract_counts(repos: DataFrame, providers: DataFrame, consumers: DataFrame, links: DataFrame) -> DataFrame:
    """repo, n_providers, n_consumers, n_links of every repo; a link counts once for each of its repos."""
    n = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    sides = links.select(F.explode(F.array_distinct(F.array("provider_repo", "consumer_repo"))).alias("repo"))
    out = repos.select("repo").distinct().join(n(providers, "n_providers"), "repo", "left").join(n(consumers, "n_consumers"), "repo", "left").join(n(sides, "n_links"), "repo", "left")
    return out.na.fill(0, ["n_providers", "n_consumers", "n_links"])


def save_contracts(path: str, **tables: DataFrame) -> None:
    """Overwrites the group's contracts (providers, consumers, links, shared libraries), a table each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def match_fuzzy(providers: DataFrame, consumers: DataFrame, linked: DataFrame, least: float = 0.7) -> DataFrame:
    """Still unlinked provider/consumer (id, repo, vector) with cosine >= least across repos.

    Only what is unmatched on both sides (linked: provider_id, consumer_id) is
    compared, all with all at every size, in blocks of bounded size.
    """
    unmatched = lambda df, side: df.select("id", "repo", "vector").join(linked.select(F.col(side).alias("id")).distinct(), "id", "left_anti")
    both = near_vectors(unmatched(providers, "provider_id"), unmatched(consumers, "consumer_id"), least, strict=True)
    sim = both.where("a_repo <> b_repo").withColumn("similarity", cosine(F.col("a_vector"), F.col("b_vector"), strict=True)).where(F.col("similarity") >= least)
    return sim.select(F.col("a_id").alias("provider_id"), F.col("b_id").alias("consumer_id"), "similarity", (F.floor(F.col("similarity") * 0.7 * 100 + 0.5) / 100).cast("double").alias("confidence"))


def cover_functions(coverage: DataFrame, functions: DataFrame) -> DataFrame:
    """Covered function (file_path, name, line, hits) to vertex (id, name, file_path, start_line).

    Names and base names must be equal and one path end in the other; the nearest line wins, then the smallest id. A
    vertex without a line counts only if no other does. Of coverage rows of one file, name and line the most hits count.
    Paths are matched once each, by their ends; the nearest line is found by a sweep, so no name is paired with itself.
    """
    c = coverage.select(F.col("file_path").alias("cp"), "name", "line", "hits").groupBy("cp", "name", "line").agg(F.max("hits").alias("hits"))
    f = functions.select("id", "name", F.col("file_path").alias("fp"), "start_line")
    cps, fps = c.select("cp").where("cp is not null").distinct(), f.select("fp").where("fp is not null").distinct()
    base = lambda c: F.length(F.element_at(F.split(c, "/"), -1))
    ends = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - base(c) + 1), lambda k: F.substr(F.col(c), k)))
    fits = cps.select("cp", ends("cp").alias("fp")).join(fps, "fp").select("cp", "fp")
    fits = fits.unionByName(fps.select("fp", ends("fp").alias("cp")).join(cps, "cp").select("cp", "fp")).distinct()
    keys = c.select("cp", "name").distinct().join(fits, "cp")
    marks = keys.join(f, ["fp", "name"]).groupBy("cp", "name", F.col("start_line").alias("at")).agg(F.min("id").alias("id"))
    hit = nearest_join(c, marks, ["cp", "name"], "line", "at", "id")
    return hit.select("id", "line", "hits", (F.col("hits") > 0).alias("covered"))


def shape_check(provided: DataFrame, accessed: DataFrame, limit: int = 30) -> DataFrame:
    """(route, field) provided and accessed: missing if only accessed, unused if only provided."""
    p = provided.distinct().withColumn("p", F.lit(True))
    a = accessed.distinct().withColumn("a", F.lit(True))
    status = F.when(F.col("p").isNull(), "missing").when(F.col("a").isNull(), "unused").otherwise("ok")
    return p.join(a, ["route", "field"], "full_outer").select("route", "field", status.alias("status")).where("status <> 'ok'").orderBy("route", "field").limit(limit)


def inherited_methods(mro: DataFrame, methods: DataFrame) -> DataFrame:
    """Class (class, mro array) and methods (class, name) to all (class, name, defined_in): the first of the order wins."""
    m = mro.select("class", F.posexplode("mro").alias("pos", "base"))
    w = Window.partitionBy("class", "name").orderBy("pos")
    all_of = m.join(methods.select(F.col("class").alias("base"), "name"), "base")
    return all_of.withColumn("k", F.row_number().over(w)).where("k = 1").select("class", "name", F.col("base").alias("defined_in"))


def semantic_edges(vectors: DataFrame, least: float = 0.85, known: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) of vectors (id, vector) with cosine >= least, a < b.

    All pairs are compared at every size, in blocks of bounded size. Pairs in known (src, dst), either way round, are left out.
    """
    both = near_vectors(vectors.select("id", "vector").where("id is not null"), None, least)
    sim = both.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), cosine(F.col("a_vector"), F.col("b_vector")).alias("similarity"))
    out = sim.where(F.col("a") < F.col("b")).where(F.col("similarity") >= least)
    if known is not None:
        pairs = known.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        out = out.join(pairs, ["a", "b"], "left_anti")
    return out
