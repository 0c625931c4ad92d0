"""Files, coverage reports, manifests, SQLite graphs and CSV exports as DataFrames."""

from __future__ import annotations

import fnmatch
import json
import re
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph

#: Bytes above which a file is not scanned; an upper limit for the parameter.
MAX_FILE, MAX_FILE_LIMIT = 512 * 1024, 32 * 1024 * 1024
BINARY = "png jpg jpeg gif ico pdf zip gz tar jar class so dll exe bin wasm woff woff2 ttf mp3 mp4 sqlite db".split()
IGNORED = ["node_modules/", ".git/", "dist/", "build/", "__pycache__/", "*.min.js", "*.lock"]


def glob_regex(pattern: str) -> str:
    """A regex for one ignore pattern: ** any path, * within a segment, ? one character; a final slash means a directory."""
    directory, pattern = pattern.endswith("/"), pattern.strip("/")
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] in "*?":
            out, i = out + {"*": "[^/]*", "?": "[^/]"}[pattern[i]], i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^(?:.*/)?{out}{'/.*' if directory else '(?:/.*)?'}$"


def parse_ignore(text: str) -> list[str]:
    """Patterns of an ignore file; comments, blank lines and negations are skipped."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.strip().startswith(("#", "!"))]


def scan_files(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_FILE) -> DataFrame:
    """file_path (below root), size, hash (sha256), content (string) of text files, without ignored and oversized ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace("path", "^.*?" + re.escape(base) + "/", "")
    files = files.where(F.col("length") <= min(max_bytes, MAX_FILE_LIMIT)).select(path.alias("file_path"), F.col("length").alias("size"), "content")
    bad = "|".join([glob_regex(p) for p in (IGNORED if ignore is None else ignore)] + [rf"\.(?:{'|'.join(BINARY)})$"])
    return files.where(~F.col("file_path").rlike(bad)).select("file_path", "size", F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def load_sqlite(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from SQLite tables nodes and relationships (or edges); broken JSON gives no properties, a missing table no rows.

    One reader task opens the file, so it must be reachable from every executor; larger graphs belong in Parquet.
    """

    def read(table: str, columns: str, count: int) -> DataFrame:
        def rows(_: Iterator) -> Iterator:
            import pandas as pd

            con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            try:
                cur = con.execute(f"select {columns} from {table}")
                while batch := cur.fetchmany(10_000):
                    yield pd.DataFrame(batch, columns=[f"c{i}" for i in range(count)]).astype(object)
            except sqlite3.OperationalError:
                return
            finally:
                con.close()

        return spark.range(0, 1, 1, 1).mapInPandas(rows, ", ".join(f"c{i} string" for i in range(count)))

    v = read("nodes", "id, label, properties", 3)
    prop = lambda k: F.get_json_object("c2", f"$.{k}")
    vertices = v.select(
        F.col("c0").alias("id"), F.col("c1").alias("label"), prop("name").alias("name"), prop("filePath").alias("file_path"), prop("startLine").cast("bigint").alias("start_line"), prop("endLine").cast("bigint").alias("end_line"),
        prop("isExported").cast("boolean").alias("is_exported"), F.col("c2").alias("properties"),
    )
    e = read("relationships", "source_id, target_id, type, cast(confidence as text)", 4).unionByName(read("edges", "source_id, target_id, type, cast(confidence as text)", 4))
    edges = e.select(F.col("c0").alias("src"), F.col("c1").alias("dst"), F.col("c2").alias("type"), F.coalesce(F.col("c3").cast("double"), F.lit(1.0)).alias("confidence"))
    return PropertyGraph(vertices, edges)


def load_many(graphs: dict[str, PropertyGraph]) -> PropertyGraph:
    """Several graphs as one; every row carries its graph_id, ids are prefixed with it."""
    v = e = None
    for name, g in graphs.items():
        tag = lambda c: F.concat(F.lit(name + "/"), F.col(c)).alias(c)  # noqa: B023, E731
        gv = g.vertices.withColumn("id", tag("id")).withColumn("graph_id", F.lit(name))
        ge = g.edges.withColumns({"src": tag("src"), "dst": tag("dst")}).withColumn("graph_id", F.lit(name))
        v = gv if v is None else v.unionByName(gv, allowMissingColumns=True)
        e = ge if e is None else e.unionByName(ge, allowMissingColumns=True)
    return PropertyGraph(v, e)


def graph_stats(g: PropertyGraph) -> DataFrame:
    """kind, name, n: vertices by label and edges by type."""
    v = g.vertices.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), "name", "n")
    e = g.edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("kind"), "name", "n")
    return v.unionByName(e)


def record_stream(g: PropertyGraph) -> DataFrame:
    """Vertices, then edges, as one table of records with a kind."""
    v = g.vertices.select(F.lit("node").alias("kind"), F.to_json(F.struct(*g.vertices.columns)).alias("record"))
    e = g.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*g.edges.columns)).alias("record"))
    return v.unionByName(e)


def iterate(rows: DataFrame, batch: int = 10_000, where: str | None = None) -> Iterator[list]:
    """Batches of rows, one partition in the driver at a time."""
    held: list = []
    for r in (rows.where(where) if where else rows).toLocalIterator():
        held.append(r)
        if len(held) == batch:
            yield held
            held = []
    if held:
        yield held


def decode_vector(blob) -> list[float] | None:
    """float32 values of a little-endian blob."""
    return None if blob is None else list(struct.unpack(f"<{len(blob) // 4}f", blob))


def coverage_format(text: F.Column) -> F.Column:
    """lcov, istanbul, cobertura or unknown by the leading token."""
    t = F.ltrim(text)
    return F.when(t.rlike(r"^(TN|SF):"), "lcov").when(F.startswith(t, F.lit("{")), "istanbul").when(F.startswith(t, F.lit("<")), "cobertura").otherwise("unknown")


def read_lcov(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """file_path, lines array of (line, hits), functions array of (name, line, hits), line_share, function_share in percent."""
    r = texts.select(F.explode(F.split(text_col, "end_of_record")).alias("r")).where(F.contains("r", F.lit("SF:")))
    pairs = lambda p: F.regexp_extract_all("r", F.lit(p), F.lit(0))
    part = lambda x, k: F.element_at(F.split(F.regexp_replace(x, "^[A-Z]+:", ""), ",", 2), k)
    lines = F.transform(pairs(r"(?m)^DA:\d+,\d+"), lambda x: F.struct(part(x, 1).cast("bigint").alias("line"), part(x, 2).cast("bigint").alias("hits")))
    counts = F.transform(pairs(r"(?m)^FNDA:\d+,.+"), lambda x: F.struct(part(x, 2).alias("name"), part(x, 1).cast("bigint").alias("hits")))
    named = F.transform(pairs(r"(?m)^FN:\d+,.+"), lambda x: F.struct(part(x, 2).alias("name"), part(x, 1).cast("bigint").alias("line")))
    d = r.select(F.trim(F.regexp_extract("r", r"(?m)^SF:(.+)$", 1)).alias("file_path"), lines.alias("lines"), counts.alias("counts"), named.alias("named"))
    hits = lambda n: F.coalesce(F.try_element_at(F.transform(F.filter("counts", lambda c: c["name"] == n), lambda c: c["hits"]), F.lit(1)), F.lit(0))
    d = d.withColumn("functions", F.transform("named", lambda f: F.struct(f["name"].alias("name"), f["line"].alias("line"), hits(f["name"]).alias("hits"))))
    return _shares(d)


def _shares(d: DataFrame) -> DataFrame:
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.size(F.filter(c, lambda x: x["hits"] > 0)), F.size(c).cast("double")), F.lit(0.0))
    return d.select("file_path", "lines", "functions", share("lines").alias("line_share"), share("functions").alias("function_share"))


def read_istanbul(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """As read_lcov, from Istanbul JSON; several statements of a line add up."""
    place = "struct<start:struct<line:bigint>>"
    shape = f"map<string,struct<path:string,statementMap:map<string,{place}>,s:map<string,bigint>,fnMap:map<string,struct<name:string,line:bigint,loc:{place}>>,f:map<string,bigint>>>"
    d = texts.select(F.explode(F.from_json(text_col, shape)).alias("key", "v")).select(F.coalesce("v.path", "key").alias("file_path"), "v.*")
    got = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    lines = d.select("file_path", F.explode_outer("statementMap").alias("k", "p"), "s").groupBy("file_path", F.col("p.start.line").alias("line")).agg(F.sum(got(F.col("s"), F.col("k"))).alias("hits"))
    lines = lines.where("line is not null").groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("line", "hits"))).alias("lines"))
    fns = d.select("file_path", F.transform(F.map_entries("fnMap"), lambda e: F.struct(e["value"]["name"].alias("name"), F.coalesce(e["value"]["line"], e["value"]["loc"]["start"]["line"]).alias("line"), got(F.col("f"), e["key"]).alias("hits"))).alias("functions"))
    empty = F.array().cast("array<struct<line:bigint,hits:bigint>>")
    return _shares(fns.join(lines, "file_path", "left").select("file_path", F.coalesce("lines", empty).alias("lines"), "functions"))


def read_cobertura(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """As read_lcov, from Cobertura XML: classes with their lines and methods."""
    c = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(?s)<class\b.*?</class>"), F.lit(0))).alias("c"))
    attr = lambda x, a: F.regexp_extract(x, rf'\b{a}="([^"]*)"', 1)
    every = lambda x, p: F.regexp_extract_all(x, F.lit(p), F.lit(0))
    line = lambda x: F.struct(attr(x, "number").cast("bigint").alias("line"), attr(x, "hits").cast("bigint").alias("hits"))
    lines = F.transform(every(F.regexp_replace("c", r"(?s)<methods>.*?</methods>", ""), r"<line\b[^>]*>"), line)
    methods = F.transform(every(F.col("c"), r"(?s)<method\b.*?</method>"), lambda m: F.struct(attr(m, "name").alias("name"), line(m)["line"].alias("line"), attr(F.regexp_extract(m, r"<line\b[^>]*>", 0), "hits").cast("bigint").alias("hits")))
    return _shares(c.select(attr(F.col("c"), "filename").alias("file_path"), lines.alias("lines"), methods.alias("functions")))


def read_manifests(files: DataFrame) -> DataFrame:
    """file_path, name, version, ecosystem of the dependencies in package.json, requirements.txt, go.mod and Cargo.toml (content)."""
    base = F.element_at(F.split("file_path", "/"), -1)
    of = lambda name: files.where(base == name)
    deps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    npm = of("package.json").select("file_path", F.explode(F.map_concat(F.coalesce(deps["dependencies"], F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce(deps["devDependencies"], F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(deps["dependencies"], F.create_map().cast("map<string,string>"))), k)))).alias("name", "version"), F.lit("npm").alias("ecosystem"))
    lines = lambda name: of(name).select("file_path", F.explode(F.split("content", r"\r?\n")).alias("l"))
    pick = lambda df, p, eco: df.where(F.col("l").rlike(p)).select("file_path", F.regexp_extract("l", p, 1).alias("name"), F.regexp_extract("l", p, 2).alias("version"), F.lit(eco).alias("ecosystem"))
    pip = pick(lines("requirements.txt"), r"^\s*([A-Za-z0-9_.-]+)\s*(?:\[[^\]]*\])?\s*(?:[=<>~!]=?\s*([^\s;,#]+))?", "PyPI")
    go = pick(lines("go.mod"), r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v(\S+)", "Go")
    cargo = of("Cargo.toml").select("file_path", F.explode(F.split(F.regexp_extract("content", r"(?s)\[dependencies\](.*?)(?:\n\[|\z)", 1), r"\r?\n")).alias("l"))
    rust = pick(cargo, r"^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\{[^}]*version\s*=\s*)?\"([^\"]+)\"", "crates.io")
    return npm.unionByName(pip).unionByName(go).unionByName(rust)


def known_vulnerabilities(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies left joined with advisories (name, ecosystem, vulnerable_version, advisory, severity); no advisory is null."""
    a = advisories.withColumnRenamed("vulnerable_version", "version")
    return dependencies.join(a, ["name", "ecosystem", "version"], "left")


def read_contract_manifests(files: DataFrame) -> DataFrame:
    """file_path, kind (http, service, grpc), name, method of OpenAPI paths, compose services and proto rpcs."""
    api = files.where(F.endswith("file_path", F.lit(".json")) & F.contains("content", F.lit('"paths"')))
    paths = F.from_json(F.get_json_object("content", "$.paths"), "map<string,map<string,string>>")
    http = api.select("file_path", F.explode(paths).alias("name", "ops")).select("file_path", F.lit("http").alias("kind"), "name", F.explode(F.map_keys("ops")).alias("method")).withColumn("method", F.upper("method"))
    compose = files.where(F.col("file_path").rlike(r"(^|/)(docker-)?compose\.ya?ml$"))
    block = F.regexp_extract("content", r"(?s)(?:^|\n)services:\s*\n(.*?)(?:\n\S|\z)", 1)
    services = compose.select("file_path", F.lit("service").alias("kind"), F.explode(F.regexp_extract_all(block, F.lit(r"(?m)^  ([A-Za-z0-9_-]+):"), F.lit(1))).alias("name"), F.lit("").alias("method"))
    proto = files.where(F.endswith("file_path", F.lit(".proto"))).select("file_path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)service\s+\w+\s*\{.*?\n\}"), F.lit(0))).alias("s"))
    grpc = proto.select("file_path", F.lit("grpc").alias("kind"), F.regexp_extract("s", r"service\s+(\w+)", 1).alias("name"), F.explode(F.regexp_extract_all("s", F.lit(r"rpc\s+(\w+)"), F.lit(1))).alias("method"))
    return http.unionByName(services).unionByName(grpc)


def read_aliases(configs: DataFrame) -> DataFrame:
    """Import aliases of compiler configs (scope, content): scope, place, prefix, target, wildcard, in order of declaration.

    The first target of an alias counts, without a leading ./; a star cuts alias
    and target, an exact alias loses its target's extension. Broken JSON gives none.
    """
    paths = F.from_json(F.get_json_object("content", "$.compilerOptions.paths"), "map<string,array<string>>")
    rows = configs.select("scope", F.posexplode(F.map_entries(paths)).alias("place", "e")).select("scope", "place", F.col("e.key").alias("alias"), F.regexp_replace(F.try_element_at(F.col("e.value"), F.lit(1)), r"^\./", "").alias("to")).where("to is not null")
    star = F.contains("alias", F.lit("*"))
    before = lambda c: F.regexp_extract(c, r"^[^*]*", 0)
    target = F.when(star, before("to")).otherwise(F.regexp_replace("to", r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", ""))
    return rows.select("scope", "place", before("alias").alias("prefix"), target.alias("target"), star.alias("wildcard"))


def resolve_aliases(imports: DataFrame, aliases: DataFrame, spec: str = "spec") -> DataFrame:
    """imports (scope and a column of import paths) with ``resolved``: the first alias of the scope that fits replaces its prefix, else the path stays.

    Aliases of a scope are one array beside its imports; they are as long as the config that declares them.
    """
    listed = aliases.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("place", "prefix", "target", "wildcard"))).alias("_aliases"))
    s = F.col(spec)
    fits = F.try_element_at(F.filter("_aliases", lambda a: F.when(a["wildcard"], F.startswith(s, a["prefix"])).otherwise(s == a["prefix"])), F.lit(1))
    rest = F.regexp_replace(F.substring(s, F.length("_fit.prefix") + 1, F.length(s)), r"\.(?:ts|tsx|js|jsx|mjs|cjs)$", "")
    resolved = F.when(F.col("_fit").isNull(), s).when(F.col("_fit.wildcard"), F.concat("_fit.target", rest)).otherwise(F.col("_fit.target"))
    return imports.join(listed, "scope", "left").withColumn("_fit", fits).withColumn("resolved", resolved).drop("_aliases", "_fit")


def changed_paths(diffs: DataFrame, text_col: str = "text") -> DataFrame:
    """file_path of every file that diffs name, once: lists of names, or unified diffs (the new name, the old one of a deleted file)."""
    lines = diffs.select(F.col(text_col).alias("t"), F.contains(text_col, F.lit("diff --git ")).alias("unified"))
    named = F.regexp_extract_all("t", F.lit(r"(?m)^([^\r\n]+?)[ \t]*\r?$"), F.lit(1))
    new = F.regexp_extract_all("t", F.lit(r"(?m)^\+\+\+ b/([^\r\n\t]+)"), F.lit(1))
    gone = F.regexp_extract_all("t", F.lit(r"(?m)^--- a/([^\r\n\t]+)\r?\n\+\+\+ /dev/null"), F.lit(1))
    moved = F.regexp_extract_all("t", F.lit(r"(?m)^rename to ([^\r\n]+)"), F.lit(1))
    found = F.when(F.col("unified"), F.concat(new, gone, moved)).otherwise(F.transform(named, F.trim))
    return lines.select(F.explode(found).alias("file_path")).where("file_path <> ''").distinct()


# Labels and edge types that differ in CSV exports of another store; "" is skipped.
CSV_LABELS = {"method": "Function", "constructor": "Function"}
CSV_TYPES = {"DEFINES": "CONTAINS", "FETCHES": ""}


def load_csv_graph(spark: SparkSession, node_files: dict[str, str], edge_file: str) -> PropertyGraph:
    """A graph from one CSV per label (id, name, filePath) and one of edges (source, target, type, confidence)."""
    v = None
    for label, path in node_files.items():
        rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
        one = rows.select("id", F.lit(CSV_LABELS.get(label.lower(), label)).alias("label"), "name", F.col("filePath").alias("file_path"))
        v = one if v is None else v.unionByName(one)
    e = spark.read.csv(edge_file, header=True, quote='"', escape='"')
    table = F.create_map(*(F.lit(x) for kv in CSV_TYPES.items() for x in kv))
    kind = F.coalesce(F.element_at(table, F.col("type")), F.col("type"))
    e = e.select(F.col("source").alias("src"), F.col("target").alias("dst"), kind.alias("type"), F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)).alias("confidence"))
    return PropertyGraph(v, e.where("type <> ''"))


def matches_any(path: str, patterns: list[str]) -> bool:
    return any(re.match(glob_regex(p), path) or fnmatch.fnmatch(path, p) for p in patterns)


def parse_json_or_empty(text: str | None) -> dict:
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}
