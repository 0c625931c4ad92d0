"""Rule passes that build a graph from files (file_path, content).

Each pass is a scan with regular expressions inside the JVM, followed by joins;
it returns rows of vertices or edges. Python sources get a real parser in an
Arrow-batched function; other languages are matched by declaration patterns.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import SEVERITIES, basename, dirname, resolve_path, severity_rank, without_extension
from ..model import PropertyGraph


def vertex(id: Column, label: str, name: Column, path: Column, **more: Column) -> list[Column]:
    return [id.alias("id"), F.lit(label).alias("label"), name.alias("name"), path.alias("file_path"), *(c.alias(k) for k, c in more.items())]


def edges_of(rows: DataFrame, src: Column, dst: Column, kind: str, confidence: float) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")).where("src is not null and dst is not null").distinct()


def structure(files: DataFrame) -> PropertyGraph:
    """Files, all their folders, packages (folders with a manifest), and CONTAINS edges from each folder to what lies directly in it."""
    parts = F.split("file_path", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), k), "/")))).alias("p")).where("p is not null").distinct()
    v = files.select(*vertex(F.concat(F.lit("file:"), "file_path"), "File", basename(F.col("file_path")), F.col("file_path")))
    v = v.unionByName(folders.select(*vertex(F.concat(F.lit("folder:"), "p"), "Folder", basename(F.col("p")), F.col("p"))))
    manifest = files.where(basename(F.col("file_path")).isin("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml")).select(dirname(F.col("file_path")).alias("p")).where("p <> ''").distinct()
    v = v.unionByName(manifest.select(*vertex(F.concat(F.lit("pkg:"), "p"), "Package", basename(F.col("p")), F.col("p"))))
    up = lambda c: F.when(dirname(c) != "", F.concat(F.lit("folder:"), dirname(c)))
    e = edges_of(files, up(F.col("file_path")), F.concat(F.lit("file:"), "file_path"), "CONTAINS", 1.0)
    e = e.unionByName(edges_of(folders, up(F.col("p")), F.concat(F.lit("folder:"), "p"), "CONTAINS", 1.0))
    return PropertyGraph(v, e.unionByName(edges_of(manifest, F.concat(F.lit("folder:"), "p"), F.concat(F.lit("pkg:"), "p"), "CONTAINS", 1.0)))


SYMBOLS = "file_path string, kind string, label string, name string, start_line bigint, end_line bigint, exported boolean, owner string, detail string"


def _python_symbols(path: str, source: str) -> list[tuple]:
    """Symbols, imports and calls of one Python file; nothing for files that do not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: list[tuple] = []

    def walk(node: ast.AST, owner: str | None, inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            where, in_class = owner, False
            if isinstance(child, ast.ClassDef):
                rows.append((path, "symbol", "Class", child.name, child.lineno, child.end_lineno, not child.name.startswith("_"), owner, None))
                for b in child.bases:
                    rows.append((path, "extends", "Class", ast.unparse(b).split("[")[0], child.lineno, child.end_lineno, False, child.name, None))
                where, in_class = child.name, True
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                n = len(child.args.args) + len(child.args.kwonlyargs)
                returns = ast.unparse(child.returns) if child.returns else None
                rows.append((path, "symbol", "Method" if inside_class else "Function", child.name, child.lineno, child.end_lineno, not child.name.startswith("_"), owner, json.dumps({"parameters": n, "returns": returns, "async": isinstance(child, ast.AsyncFunctionDef)})))
                where = child.name
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                rows.extend([(path, "import", "Import", a.name, child.lineno, child.lineno, False, module, a.asname) for a in child.names])
            elif isinstance(child, ast.Import):
                rows.extend([(path, "import", "Import", "*", child.lineno, child.lineno, False, a.name, a.asname) for a in child.names])
            elif isinstance(child, ast.Call):
                f = child.func
                called = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if called:
                    rows.append((path, "call", "Call", called, child.lineno, child.lineno, False, owner, None))
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and inside_class:
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name):
                        kind = ast.unparse(child.annotation) if isinstance(child, ast.AnnAssign) else None
                        rows.append((path, "symbol", "Property", t.id, child.lineno, child.end_lineno, True, owner, json.dumps({"type": kind})))
            walk(child, where, in_class)

    walk(tree, None, False)
    return rows


def python_symbols(files: DataFrame) -> DataFrame:
    """Rows of SYMBOLS for the .py files: kind symbol, import (owner: module), extends (owner: class) or call (owner: function)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SYMBOLS.split(", ")]
        for part in parts:
            for path, source in zip(part["file_path"], part["content"]):
                yield pd.DataFrame(_python_symbols(path, source), columns=columns)

    return files.where(F.endswith("file_path", F.lit(".py"))).select("file_path", "content").mapInPandas(run, SYMBOLS)


# Declaration patterns of other languages as (extensions, label, pattern with the name in group 1).
DECLARATIONS = (
    (r"\.(ts|tsx|js|jsx|mjs|cjs)$", "Class", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    (r"\.(ts|tsx|js|jsx|mjs|cjs)$", "Function", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    (r"\.(ts|tsx|js|jsx|mjs|cjs)$", "Function", r"(?m)^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"),
    (r"\.(ts|tsx)$", "Interface", r"(?m)^\s*(?:export\s+)?interface\s+(\w+)"),
    (r"\.(ts|tsx)$", "TypeAlias", r"(?m)^\s*(?:export\s+)?type\s+(\w+)\s*="),
    (r"\.(ts|tsx)$", "Enum", r"(?m)^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
    (r"\.(java|cs|kt|scala|php)$", "Class", r"(?m)^\s*(?:(?:public|private|protected|internal|final|abstract|static|sealed|data|open|case)\s+)*class\s+(\w+)"),
    (r"\.(java|cs|kt|php)$", "Interface", r"(?m)^\s*(?:(?:public|private|protected|internal)\s+)*interface\s+(\w+)"),
    (r"\.go$", "Function", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("),
    (r"\.go$", "Struct", r"(?m)^type\s+(\w+)\s+struct\b"),
    (r"\.go$", "Interface", r"(?m)^type\s+(\w+)\s+interface\b"),
    (r"\.rs$", "Function", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    (r"\.rs$", "Struct", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
    (r"\.rs$", "Trait", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"),
    (r"\.rb$", "Class", r"(?m)^\s*class\s+(\w+)"),
    (r"\.rb$", "Method", r"(?m)^\s*def\s+(?:self\.)?(\w+[?!]?)"),
    (r"\.(c|h|cpp|hpp|cc)$", "Struct", r"(?m)^\s*(?:typedef\s+)?struct\s+(\w+)"),
    (r"\.sql$", "Class", r"(?i)create\s+(?:or\s+replace\s+)?(?:external\s+|temp\s+|temporary\s+|snapshot\s+|materialized\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.-]+)"),
    (r"\.sql$", "Function", r"(?i)create\s+(?:or\s+replace\s+)?(?:temp\s+|table\s+|aggregate\s+)?(?:function|procedure)\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.-]+)"),
    (r"\.sql$", "Namespace", r"(?i)create\s+schema\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.-]+)"),
    (r"\.sql$", "CodeElement", r"(?i)create\s+(?:or\s+replace\s+)?model\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.-]+)"),
    (r"\.vue$", "CodeElement", r"(?s)<script[^>]*>.*?name\s*:\s*['\"](\w+)['\"]"),
)


def _tagged(**fixed) -> object:
    """A function from a match to a struct of fixed fields and the match under the last, open name."""
    (open_name,) = (k for k, v in fixed.items() if v is ...)
    return lambda n: F.struct(*(n.alias(k) if k == open_name else F.lit(v).alias(k) for k, v in fixed.items()))


def declared_symbols(files: DataFrame) -> DataFrame:
    """file_path, label, name of every declaration pattern's match; one pass over the files for all patterns."""
    found = [F.when(F.col("file_path").rlike(ext), F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), _tagged(label=label, name=...))) for ext, label, p in DECLARATIONS]
    empty = F.array().cast("array<struct<label:string,name:string>>")
    return files.select("file_path", F.explode(F.concat(*(F.coalesce(f, empty) for f in found))).alias("s")).select("file_path", "s.*")


# Route patterns as (framework, pattern, group of the method or its fixed text, group of the path or its fixed text, whether the method is upper-cased).
ROUTES = (
    ("express", r"\b(app|router)\.(get|post|put|delete|patch|use)\s*\(\s*['\"]([^'\"]+)['\"]", 2, 3, False),
    ("fastapi", r"@\w+\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, False),
    ("flask", r"@\w+\.route\s*\(\s*['\"]([^'\"]+)['\"]", "GET", 1, False),
    ("laravel", r"\bRoute::(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, False),
    ("django", r"\bpath\s*\(\s*['\"]([^'\"]+)['\"]", "ANY", 1, False),
    ("nextjs", r"export\s+(?:async\s+)?(?:function\s+|const\s+)(GET|POST|PUT|DELETE|PATCH)\b", 1, "[inferred]", False),
    ("spring", r"@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:value\s*=\s*)?['\"]([^'\"]+)['\"]", 1, 2, True),
    ("spring", r"@RequestMapping\s*\(\s*(?:(?:value|path)\s*=\s*)?['\"]([^'\"]+)['\"][\s,]*(?:method\s*=\s*RequestMethod\.(GET|POST|PUT|DELETE|PATCH))?", 2, 1, False),
    ("nestjs", r"@(Get|Post|Put|Delete|Patch)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, True),
    ("nestjs", r"@(Get|Post|Put|Delete|Patch)\s*\(\s*\)", 1, "", True),
    ("django-rest", r"@api_view\s*\(\s*\[([^\]]+)\]", 1, "[inferred]", False),
    ("django-rest", r"@action\s*\([^)]*methods\s*=\s*\[([^\]]+)\]", 1, "[inferred]", False),
    ("html-template", r"(?i)<form[^>]*action\s*=\s*['\"]([^'\"]+)['\"][^>]*>", "GET", 1, False),
    ("pug-template", r"(?m)^[\s]*form\s*\([^)]*action\s*=\s*['\"]([^'\"]+)['\"]", "GET", 1, False),
    ("blade-template", r"\{\{\s*Form::open\s*\(\s*\[\s*['\"]url['\"]\s*=>\s*['\"]([^'\"]+)['\"]", "POST", 1, False),
    ("fastify", r"\bfastify\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]", 1, 2, True),
    ("hapi", r"(?s)(?:server|route)\s*\.\s*route\s*\(\s*\{[^}]*method\s*:\s*['\"](\w+)['\"][^}]*path\s*:\s*['\"]([^'\"]+)['\"]", 1, 2, True),
    ("koa", r"\b(router|koa)\.(get|post|put|delete|patch)\s*\(\s*['\"]([^'\"]+)['\"]", 2, 3, True),
    ("graphql", r"(?s)(?:Query|Mutation)\s*:\s*\{[^}]*?(\w+)\s*[:(]", "GRAPHQL", 1, False),
    ("nextjs-pages", r"export\s+default\s+(?:async\s+)?(?:function|const)\s+\w*(?:Page|Handler)", "GET", "[inferred]", False),
)
# Paths of files that are searched for routes.
ROUTE_FILES = (
    r"routes?[/\\]|api[/\\]|(?i:controller)|(?i:handler)|(?i:route\.(?:ts|js|py|php)$)|(?i:\b(?:app|main|server|index)\.(?:ts|js|py|php)$)|(?i:\.(?:html|ejs|blade\.php|hbs|pug|jsx|tsx)$)"
    r"|(?:^|[/\\])app[/\\]|(?:^|[/\\])pages[/\\]|(?i:resolv)|(?i:schema\.(?:ts|js|graphql|gql)$)"
)
_ROUTE_TYPE = "array<struct<framework:string,method:string,path:string>>"


def _route(name: str, pattern: str, of_method: int | str, of_path: int | str, upper: bool) -> object:
    """A function from a match to its route; a method that the match leaves open is ANY, quotes in a list of methods go."""
    get = lambda x, k: F.lit(k) if isinstance(k, str) else F.regexp_extract(x, pattern, k)

    def made(x: Column) -> Column:
        method = F.trim(F.regexp_replace(get(x, of_method), "['\"]", ""))
        method = F.when(method == "", "ANY").otherwise(F.upper(method) if upper else method)
        return F.struct(F.lit(name).alias("framework"), method.alias("method"), get(x, of_path).alias("path"))

    return made


def _below_app(path: Column) -> Column:
    """What follows the first app folder of a path; null without one."""
    at = F.instr(path, "/app/")
    return F.when(at > 0, F.substring(path, at + 5, F.length(path))).when(F.startswith(path, F.lit("app/")), F.substring(path, F.lit(5), F.length(path)))


def _as_url(path: Column) -> Column:
    """[x] as :x, one slash at the start, none at the end."""
    url = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"\[([^\]]+)\]", ":$1"), "^/", ""))
    return F.when(url == "/", url).otherwise(F.regexp_replace(url, "/$", ""))


def app_router_path(path: Column) -> Column:
    """The route of a route or page file below an app folder; route groups leave no segment; null for other files."""
    below = _below_app(F.replace(path, F.lit("\\"), F.lit("/")))
    is_route = below.rlike(r"route\.(?:ts|js)$") | below.rlike(r"/page\.(?:tsx|ts|jsx|js)$")
    bare = F.regexp_replace(F.regexp_replace(below, r"/(?:route\.(?:ts|js)|page\.(?:tsx|ts|jsx|js))$", ""), r"/\([^)]+\)", "")
    return F.when(is_route, _as_url(F.regexp_replace(bare, "/+", "/")))


def screen_path(path: Column) -> Column:
    """The route of a screen file below an app folder; index stands for its folder; null for other files."""
    below = _below_app(F.replace(path, F.lit("\\"), F.lit("/")))
    bare = F.regexp_replace(below, r"\.(?:tsx?|jsx?)$", "")
    return F.when(below.rlike(r"\.(?:tsx?|jsx?)$"), F.when(bare == "index", "/").otherwise(_as_url(F.regexp_replace(bare, "/index$", ""))))


def routes(files: DataFrame, every_file: bool = False) -> DataFrame:
    """id route:<file>:<framework>:<method>:<path>, file_path, framework, method, path.

    Files are those whose path speaks of routes, unless every_file. Methods keep
    the case that the framework's pattern gives them; a decorator's list of
    methods stays one text; forms and plain route decorators count as GET.
    Paths of a file with a controller prefix start with it. Files below an app
    folder are routes by their place.
    """
    f = files if every_file else files.where(F.col("file_path").rlike(ROUTE_FILES))
    path, content = F.col("file_path"), F.col("content")
    found = [F.coalesce(F.transform(F.regexp_extract_all("content", F.lit(rule[1]), F.lit(0)), _route(*rule)), F.array().cast(_ROUTE_TYPE)) for rule in ROUTES]
    prefix = F.regexp_extract("content", r"@Controller\s*\(\s*['\"]([^'\"]+)['\"]\)", 1)
    url, unix = app_router_path(path), F.replace(path, F.lit("\\"), F.lit("/"))
    by_place = lambda name, method, at: F.struct(F.lit(name).alias("framework"), method.alias("method"), at.alias("path"))
    exported = F.transform(F.regexp_extract_all("content", F.lit(r"export\s+(?:async\s+)?(?:function\s+|const\s+)(GET|POST|PUT|DELETE|PATCH)\b"), F.lit(1)), lambda m: by_place("nextjs-app", m, url))
    placed = F.when(url.isNotNull() & unix.rlike(r"/route\.(?:ts|js)$"), exported).when(url.isNotNull() & unix.rlike(r"/page\.(?:tsx|ts|jsx|js)$"), F.array(by_place("nextjs-app", F.lit("GET"), url)))
    screen = F.when(content.rlike(r"\bexpo-router\b") & screen_path(path).isNotNull(), F.array(by_place("expo", F.lit("GET"), screen_path(path))))
    none = F.array().cast(_ROUTE_TYPE)
    r = f.select("file_path", prefix.alias("prefix"), F.explode(F.concat(*found, F.coalesce(placed.cast(_ROUTE_TYPE), none), F.coalesce(screen.cast(_ROUTE_TYPE), none))).alias("r")).select("file_path", "prefix", "r.*")
    joined = F.regexp_replace(F.concat(F.lit("/"), "prefix", F.when(F.col("path").isin("/", ""), "").otherwise(F.concat(F.lit("/"), "path"))), "/+", "/")
    r = r.withColumn("path", F.when((F.col("framework") == "nestjs") & (F.col("prefix") != ""), joined).otherwise(F.col("path"))).drop("prefix").distinct()
    return r.select(F.concat_ws(":", F.lit("route"), "file_path", "framework", "method", "path").alias("id"), "file_path", "framework", "method", "path")


def fetches(files: DataFrame) -> DataFrame:
    """file_path, url of quoted absolute paths in files that call an HTTP client."""
    client = r"\bfetch\s*\(|\baxios\.(?:get|post|put|delete|patch|request)\s*\(|\bgot\.(?:get|post|put|delete|patch)\s*\(|\b(?:request|superagent)\s*\(|\b(?:httpClient|HttpClient|http\.request)\s*\("
    calls = files.where(F.col("content").rlike(client)).select("file_path", F.explode(F.split("content", "\n")).alias("l")).where(F.col("l").rlike(client))
    return calls.select("file_path", F.explode(F.regexp_extract_all("l", F.lit(r"['\"`](/[^'\"`\s]*)['\"`]"), F.lit(1))).alias("url")).distinct()


# Tool patterns as (kind, pattern, group of the name, only in .proto).
TOOLS = (
    ("mcp", r"server\.tool\s*\(\s*['\"]([^'\"]+)['\"]", 1, False),
    ("mcp-resource", r"server\.resource\s*\(\s*['\"]([^'\"]+)['\"]", 1, False),
    ("trpc", r"\.(query|mutation|procedure)\s*\(\s*['\"]([^'\"]+)['\"]?", 2, False),
    ("cli", r"\.command\s*\(\s*['\"]([^'\"]+)['\"]", 1, False),
    ("grpc", r"\brpc\s+(\w+)\s*\(", 1, True),
    ("graphql-resolver", r"(?s)(?:Query|Mutation)\s*:\s*\{[^}]*?(\w+)\s*[:(]", 1, False),
    ("fastify-plugin", r"fastify\.decorate\s*\(\s*['\"]([^'\"]+)['\"]", 1, False),
    ("slack-command", r"app\.command\s*\(\s*['\"]([^'\"]+)['\"]", 1, False),
)


def tools(files: DataFrame) -> DataFrame:
    """file_path, kind, name of declared tools and commands."""
    empty = F.array().cast("array<struct<kind:string,name:string>>")
    found = []
    for kind, pattern, group, proto in TOOLS:
        hits = F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(group)), _tagged(kind=kind, name=...))
        found.append(F.coalesce(F.when(F.endswith("file_path", F.lit(".proto")), hits) if proto else hits, empty))
    return files.select("file_path", F.explode(F.concat(*found)).alias("t")).select("file_path", "t.*").distinct()


# Data model patterns as (mapper, pattern with the model in group 1, whether it is a query).
MODELS = (
    ("prisma", r"(?m)^model\s+(\w+)\s*\{", False),
    ("prisma", r"\bprisma\.(\w+)\.\w+\s*\(", True),
    ("supabase", r"\.from\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", True),
    ("supabase", r"\.rpc\s*\(\s*['\"]([^'\"]+)['\"]\s*[,)]", True),
    ("sqlalchemy", r"class\s+(\w+)\s*\([^)]*(?:db\.Model|Base|DeclarativeBase)[^)]*\)", False),
    ("typeorm", r"@Entity\s*\(\s*['\"]?([^'\")\s]+)['\"]?\s*\)", False),
    ("typeorm", r"class\s+(\w+)\s+extends\s+BaseEntity", False),
    ("sequelize", r"sequelize\.define\s*\(\s*['\"]([^'\"]+)['\"]", False),
    ("mongoose", r"mongoose\.model\s*\(\s*['\"]([^'\"]+)['\"]", False),
    ("django", r"class\s+(\w+)\s*\(\s*models\.Model\s*\)", False),
)


def data_models(files: DataFrame) -> DataFrame:
    """file_path, mapper, model, is_query."""
    empty = F.array().cast("array<struct<mapper:string,model:string,is_query:boolean>>")
    found = [F.coalesce(F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), _tagged(mapper=m, model=..., is_query=q)), empty) for m, p, q in MODELS]
    return files.select("file_path", F.explode(F.concat(*found)).alias("m")).select("file_path", "m.*").distinct()


def query_edges(models: DataFrame, functions: DataFrame) -> DataFrame:
    """QUERIES edges from every function (id, file_path) to each model that its file queries."""
    q = models.where("is_query").select("file_path", F.concat(F.lit("model:"), "mapper", F.lit(":"), "model").alias("m"))
    return edges_of(functions.select("id", "file_path").join(q, "file_path"), F.col("id"), F.col("m"), "QUERIES", 0.7)


def markdown_sections(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headings (file_path, line, level, title, slug) and links (file_path, line, target, heading: the last one at or above the link)."""
    lines = files.where(F.col("file_path").rlike(r"(?i)\.mdx?$")).select("file_path", F.posexplode(F.split("content", "\n")).alias("at", "l")).withColumn("line", (F.col("at") + 1).cast("bigint"))
    head = r"^(#{1,6})\s+(.+)"
    title = F.regexp_replace(F.trim(F.regexp_extract("l", head, 2)), r"[#*`\[\]]", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    marked = lines.withColumn("title", F.when(F.col("l").rlike(head), title))
    headings = marked.where("title is not null").select("file_path", "line", F.length(F.regexp_extract("l", head, 1)).alias("level"), "title", slug.alias("slug"))
    w = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    links = marked.withColumn("heading", F.last("title", ignorenulls=True).over(w)).select("file_path", "line", "heading", F.explode(F.regexp_extract_all("l", F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))).alias("target"))
    return headings, links


def link_edges(links: DataFrame, files: DataFrame) -> DataFrame:
    """USES edges from a file to the file that a relative link names."""
    at = links.where(~F.col("target").rlike("^(?:[a-z]+:|#)")).select("file_path", resolve_path(dirname(F.col("file_path")), F.regexp_replace("target", "#.*$", "")).alias("t"))
    hit = at.join(files.select(F.col("file_path").alias("t")), "t", "left_semi")
    return edges_of(hit, F.concat(F.lit("file:"), "file_path"), F.concat(F.lit("file:"), "t"), "USES", 0.6)


# What identifies a framework, by ecosystem: dependency names, or words and parts of a manifest.
JS_FRAMEWORKS = {
    "next": "next", "express": "express", "fastify": "fastify", "koa": "koa", "@nestjs/core": "nest", "@remix-run/node": "remix", "nuxt": "nuxt", "@trpc/server": "trpc",
    "prisma": "prisma", "typeorm": "typeorm", "sequelize": "sequelize", "drizzle-orm": "drizzle", "knex": "knex", "mongoose": "mongoose",
}
REQUIRED = "flask fastapi django aiohttp sanic starlette sqlalchemy django.db peewee tortoise pony".split()
PROJECT = "flask fastapi django".split()
GO_MODULES = {"gin-gonic/gin": "gin", "labstack/echo": "echo", "gorilla/mux": "gorilla-mux", "go-chi/chi": "chi", "gofiber/fiber": "fiber"}
CRATES = "actix-web rocket axum warp tide tokio".split()
PACKAGE_MANIFESTS = ("package.json", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml")


def frameworks(files: DataFrame) -> DataFrame:
    """name, ecosystem, version (of npm packages), detected_from, scope: frameworks and mappers by manifest, once for each scope.

    scope is the manifest's folder, ``root`` at the top; deeper folders count if
    they are packages. Of several files of a scope the first of
    requirements.txt, pyproject.toml and manage.py is named.
    """
    path, content = F.col("file_path"), F.coalesce("content", F.lit(""))
    base = basename(path)
    word = lambda w: r"\b" + re.escape(w) + r"\b"
    row = lambda name, eco, at, rank, version=None: F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), F.lit(eco).alias("ecosystem"), (F.lit(None).cast("string") if version is None else version).alias("version"), F.lit(at).alias("detected_from"), F.lit(rank).alias("rank"))
    kind = "array<struct<name:string,ecosystem:string,version:string,detected_from:string,rank:int>>"
    some = lambda file, rows: F.when(base == file, F.array_compact(F.array(*rows)).cast(kind))
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    npm = lambda field: F.coalesce(F.map_entries(parsed[field]), F.array().cast("array<struct<key:string,value:string>>"))
    own = F.filter(npm("dependencies"), lambda d: ~F.exists(npm("devDependencies"), lambda e: e["key"] == d["key"]))
    table = F.create_map(*(F.lit(x) for kv in JS_FRAMEWORKS.items() for x in kv))
    listed = F.filter(F.concat(own, npm("devDependencies")), lambda d: d["key"].isin(*JS_FRAMEWORKS) & (d["value"] != ""))
    js = F.when(base == "package.json", F.transform(listed, lambda d: row(F.element_at(table, d["key"]), "javascript", "package.json", 0, d["value"])).cast(kind))
    lines = F.lower(content)
    found = [
        js,
        some("requirements.txt", [F.when(lines.rlike(rf"(?m)^(?![^\S\n]*#).*{word(w)}"), row(w, "python", "requirements.txt", 1)) for w in REQUIRED]),
        some("pyproject.toml", [F.when(content.rlike(word(w)), row(w, "python", "pyproject.toml", 2)) for w in PROJECT]),
        some("manage.py", [row("django", "python", "manage.py", 3)]),
        some("go.mod", [F.when(F.contains(content, F.lit(m)), row(n, "go", "go.mod", 4)) for m, n in GO_MODULES.items()]),
        some("Cargo.toml", [F.when(content.rlike(word(w)), row(w, "rust", "Cargo.toml", 5)) for w in CRATES]),
    ]
    hits = files.select(dirname(path).alias("dir"), F.explode(F.concat(*(F.coalesce(f, F.array().cast(kind)) for f in found))).alias("f"))
    packages = files.where(base.isin(*PACKAGE_MANIFESTS)).select(dirname(path).alias("dir")).distinct()
    inside = hits.where("dir = ''").unionByName(hits.where("dir <> ''").join(packages, "dir", "left_semi"))
    first = inside.groupBy("dir", F.col("f.name").alias("name"), F.col("f.ecosystem").alias("ecosystem")).agg(F.min_by("f", F.struct("f.rank", "f.version")).alias("f"))
    return first.select("name", "ecosystem", F.col("f.version").alias("version"), F.col("f.detected_from").alias("detected_from"), F.when(F.col("dir") == "", "root").otherwise(F.col("dir")).alias("scope"))


def framework_edges(found: DataFrame) -> DataFrame:
    """USES_FRAMEWORK edges (confidence 0.9) from packages and the root folder to framework:<ecosystem>:<name>:<scope>."""
    owner = F.when(F.col("scope") == "root", "folder:").otherwise(F.concat(F.lit("pkg:"), "scope"))
    return edges_of(found, owner, F.concat_ws(":", F.lit("framework"), "ecosystem", "name", "scope"), "USES_FRAMEWORK", 0.9)


# Secret patterns as (name, pattern, severity), and security-relevant code as (category, pattern, severity).
SECRETS = (
    ("AWS Access Key", r"AKIA[0-9A-Z]{16}", "critical"),
    ("AWS Secret Key", r"(?i)(?:aws_secret_access_key)\s*[=:]\s*['\"][A-Za-z0-9/+=]{40}['\"]", "critical"),
    ("GitHub Token", r"gh[pousr]_[A-Za-z0-9_]{36,}", "critical"),
    ("GitHub OAuth", r"gho_[A-Za-z0-9]{36}", "critical"),
    ("Slack Token", r"xox[baprs]-[0-9]{10,}-[A-Za-z0-9]+", "high"),
    ("Private Key", r"-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----", "critical"),
    ("JWT", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "medium"),
    ("Generic API Key", r"(?i)(?:api[_-]?key|apikey)\s*[=:]\s*['\"][A-Za-z0-9]{20,}['\"]", "high"),
    ("Generic Secret", r"(?i)(?:secret|password|token)\s*[=:]\s*['\"][A-Za-z0-9!@#$%^&*]{16,}['\"]", "high"),
    ("Google API Key", r"AIza[0-9A-Za-z_-]{35}", "high"),
    ("Stripe Key", r"(?:sk|pk)_(?:test|live)_[A-Za-z0-9]{24,}", "critical"),
)
SENSITIVE = (
    ("auth", r"(?i)\b(?:login|authenticate|authorize|logout|session)\b", "medium"),
    ("crypto", r"(?i)\b(?:encrypt|decrypt|hash|sign|verify|cipher|digest)\b", "medium"),
    ("sql", r"(?i)\b(?:executeQuery|rawQuery|sql.*\+|SELECT.*FROM|INSERT.*INTO)\b|\.query\(", "high"),
    ("file-io", r"(?i)\b(?:readFile|writeFile|unlink|rmdir|exec|spawn)\b", "low"),
    ("network", r"(?i)\b(?:fetch|axios|http\.request|XMLHttpRequest|websocket)\b", "info"),
)


def security_findings(texts: DataFrame, id_col: str, text_col: str, least: str = "info", rules: tuple = SECRETS) -> DataFrame:
    """id, rule, severity, line (of the first match): rules found in whole texts at least as severe as ``least``.

    A row is split into lines only if some rule matches it.
    """
    kept = [r for r in rules if SEVERITIES.index(r[2]) <= SEVERITIES.index(least)]
    any_of = F.array_compact(F.array(*(F.when(F.col("t").rlike(p), F.struct(F.lit(name).alias("rule"), F.lit(p).alias("p"), F.lit(s).alias("severity"))) for name, p, s in kept)))
    hit = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select("id", "t", F.explode(any_of).alias("r"))
    before = F.split("t", F.col("r.p"), 2)[0]
    return hit.select("id", F.col("r.rule").alias("rule"), F.col("r.severity").alias("severity"), F.size(F.split(before, "\n")).cast("bigint").alias("line"))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_files")).withColumn("rank", severity_rank(F.col("severity")))


#: Hints of design patterns as (pattern, category, positive hints, negative hints): text patterns of this library, for lack of syntax trees.
PATTERNS = (
    ("singleton", "creational", (r"getInstance", r"static\s+.*\binstance\b", r"private\s+constructor|private\s+\w+\s*\(\s*\)"), (r"\bnew\s+\w+\s*\(.*\bnew\b",)),
    ("factory-method", "creational", (r"\b(?:create|make|build)[A-Z]\w*\s*\(", r"Factory\b"), (r"Builder\b",)),
    ("builder", "creational", (r"Builder\b", r"\bbuild\s*\(\s*\)", r"return\s+(?:this|self)\b"), ()),
    ("abstract-factory", "creational", (r"Factory\b", r"(?:interface|abstract\s+class)\s+\w*Factory\b", r"(?s)\bcreate[A-Z]\w*\s*\(.*\bcreate[A-Z]\w*\s*\("), ()),
    ("prototype", "creational", (r"\bclone\s*\(",), ()),
    ("adapter", "structural", (r"Adapter\b", r"adaptee"), ()),
    ("decorator", "structural", (r"Decorator\b", r"wrapped|wrappee"), ()),
    ("facade", "structural", (r"Facade\b",), ()),
    ("proxy", "structural", (r"Proxy\b", r"\brealSubject\b|\btarget\b"), ()),
    ("composite", "structural", (r"\bchildren\b", r"\badd(?:Child)?\s*\(", r"Composite\b"), ()),
    ("strategy", "behavioral", (r"Strategy\b", r"setStrategy"), ()),
    ("observer", "behavioral", (r"\b(?:subscribe|addListener|addObserver|attach)\s*\(", r"\b(?:notify|emit|dispatch)\w*\s*\("), ()),
    ("command", "behavioral", (r"Command\b", r"\bexecute\s*\(", r"\bundo\s*\("), ()),
    ("template-method", "behavioral", (r"abstract\s+class", r"abstract\s+\w+|NotImplementedError"), ()),
    ("state", "behavioral", (r"State\b", r"setState|transition"), (r"useState",)),
    ("go-concurrency", "idiom", (r"\bgo\s+func\b", r"\bchan\s+\w+"), ()),
    ("rust-trait-impl", "idiom", (r"\bimpl\s+\w+\s+for\s+\w+",), ()),
    ("python-decorator", "idiom", (r"(?m)^\s*@\w+", r"functools\.wraps"), ()),
    ("csharp-async", "idiom", (r"\basync\s+Task\b", r"\bawait\b"), ()),
)


def design_patterns(files: DataFrame, least: float = 0.5) -> DataFrame:
    """file_path, pattern, category, confidence: share of positive hints found, less 0.2 for each negative one, at least 0.1."""
    rows = []
    for name, category, plus, minus in PATTERNS:
        found = sum((F.col("content").rlike(p).cast("int") for p in plus), F.lit(0)) / F.lit(float(len(plus)))
        bad = sum((F.col("content").rlike(p).cast("int") for p in minus), F.lit(0)) * 0.2
        rows.append(F.when(found > 0, F.struct(F.lit(name).alias("pattern"), F.lit(category).alias("category"), F.greatest(F.lit(0.1), found - bad).alias("confidence"))))
    return files.select("file_path", F.explode(F.array_compact(F.array(*rows))).alias("p")).select("file_path", "p.*").where(F.col("confidence") >= least)


def access_edges(files: DataFrame, properties: DataFrame) -> DataFrame:
    """ACCESSES edges from a file to properties (id, name, file_path): member accesses, of the same file first, else the smallest id."""
    seen = files.select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\.([A-Za-z_]\w*)\b(?!\s*\()"), F.lit(1)))).alias("name"))
    near = properties.groupBy("file_path", "name").agg(F.min("id").alias("near"))
    far = properties.groupBy("name").agg(F.min("id").alias("far"))
    hit = seen.join(near, ["file_path", "name"], "left").join(far, "name", "left")
    return edges_of(hit, F.concat(F.lit("file:"), "file_path"), F.coalesce("near", "far"), "ACCESSES", 0.7)


def cobol_programs(files: DataFrame) -> DataFrame:
    """file_path, kind (program, call, copy), name in COBOL sources."""
    cob = files.where(F.col("file_path").rlike(r"(?i)\.(cbl|cob|cobol|cpy)$"))
    hit = lambda kind, p: F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    found = F.concat(hit("program", r"(?i)PROGRAM-ID\s*\.\s*(\w[\w-]*)"), hit("call", r"(?i)\bCALL\s+['\"]([^'\"]+)['\"]"), hit("copy", r"(?i)\bCOPY\s+['\"]([^'\"]+)['\"]"))
    return cob.select("file_path", F.explode(found).alias("p")).select("file_path", "p.*").distinct()


# Files that mark a service, and its language.
MARKERS = {
    "package.json": "javascript", "go.mod": "go", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "pyproject.toml": "python", "setup.py": "python",
    "requirements.txt": "python", "Gemfile": "ruby", "global.json": "csharp", "composer.json": "php",
}


def service_boundaries(files: DataFrame, least: float = 0.5, max_depth: int = 4) -> DataFrame:
    """dir, score: 0.3 a marker file, 0.2 if sources lie below, 0.1 for a src or lib directory; at most 1."""
    d = files.select("file_path", dirname(F.col("file_path")).alias("dir"), basename(F.col("file_path")).alias("base"))
    marks = d.where(F.col("base").isin(*MARKERS) | F.endswith("base", F.lit(".csproj"))).where(F.size(F.split("dir", "/")) <= max_depth).groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("dir", "/")
    above = d.where(F.col("base").rlike(r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|java|rs|rb|cs|php)$")).select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up"), "dir")
    below = above.groupBy(F.col("up").alias("dir_")).agg(F.max(F.expr("substring(dir, length(up) + 1)").rlike("^/?(src|lib)(/|$)")).alias("src"))
    out = marks.join(below, F.col("dir") == F.col("dir_"), "left")
    score = F.least(F.lit(1.0), 0.3 * F.col("n") + F.when(F.col("dir_").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("src"), 0.1).otherwise(0.0))
    return out.select("dir", F.round(score, 6).alias("score")).where(F.col("score") >= least - 1e-9)


def raise_confidence(calls: DataFrame, same_file: str = "same_file", imported: str = "imported", parameters: str = "parameters") -> DataFrame:
    """Calls with confidence max(old, tier): same file .95, imported .9, else .5; a target without parameters loses .2 (least .3)."""
    tier = F.when(F.col(same_file), 0.95).when(F.col(imported), 0.9).otherwise(0.5)
    tier = F.when(F.col(parameters) == 0, F.greatest(F.lit(0.3), tier - 0.2)).otherwise(tier)
    return calls.withColumn("confidence", F.greatest("confidence", tier))


def _linearized(bases: dict[str, list[str]]) -> dict[str, list[str] | None]:
    """C3 of every class in order of inheritance, without recursion; None where the order contradicts itself or a cycle lies above."""
    names = {*bases, *(b for bs in bases.values() for b in bs)}
    waiting = {c: len(set(bases.get(c, ()))) for c in names}
    heirs: dict[str, set[str]] = {}
    for c, bs in bases.items():
        for b in bs:
            heirs.setdefault(b, set()).add(c)
    ready, known = sorted(c for c in names if not waiting[c]), {}
    for c in ready:
        lists = [known[b] for b in bases.get(c, ())]
        known[c] = None if any(x is None for x in lists) else _merged(c, [*lists, bases.get(c, [])])
        for h in sorted(heirs.get(c, ())):
            waiting[h] -= 1
            if not waiting[h]:
                ready.append(h)
    return known


def _merged(c: str, lists: list[list[str]]) -> list[str] | None:
    """The first head that is in no other list's rest, again and again; rests are counted, not searched."""
    at = [0] * len(lists)
    later: dict[str, int] = {}
    for x in lists:
        for name in x[1:]:
            later[name] = later.get(name, 0) + 1
    out = [c]
    while True:
        open_lists = [k for k, x in enumerate(lists) if at[k] < len(x)]
        if not open_lists:
            return out
        head = next((lists[k][at[k]] for k in open_lists if not later.get(lists[k][at[k]])), None)
        if head is None:
            return None
        out.append(head)
        for k in open_lists:
            if lists[k][at[k]] == head:
                at[k] += 1
                if at[k] < len(lists[k]):
                    later[lists[k][at[k]]] -= 1


def mro(extends: DataFrame, max_classes: int = 100_000) -> DataFrame:
    """class, mro, depth by C3 over (class, base, position); inconsistent or cyclic hierarchies fall back to first-seen breadth-first order.

    A hierarchy (weakly connected) is one task; max_classes bounds its classes and raises beyond.
    """
    from ..operators.components import star_components
    from ..storage import Workspace

    cc = star_components(extends.select(F.col("class").alias("a"), F.col("base").alias("b")), Workspace(extends.sparkSession, "mro"))
    e = extends.join(cc.toDF("class", "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        bases: dict[str, list[str]] = {}
        for c, b in pdf.sort_values(["class", "position", "base"])[["class", "base"]].itertuples(index=False):
            bases.setdefault(c, []).append(b)
        if len({*bases, *pdf["base"]}) > max_classes:
            raise ValueError(f"a hierarchy has more than {max_classes} classes")

        def breadth(c: str) -> list[str]:
            out = {c: None}
            todo = [c]
            for x in todo:
                fresh = [b for b in dict.fromkeys(bases.get(x, [])) if b not in out]
                out.update(dict.fromkeys(fresh))
                todo += fresh
            return list(out)

        known = _linearized(bases)
        rows = [(c, known.get(c) or breadth(c)) for c in sorted(bases)]
        return pd.DataFrame({"class": [c for c, _ in rows], "mro": [m for _, m in rows], "depth": [len(m) - 1 for _, m in rows]})

    return e.groupBy("component").applyInPandas(order, "class string, mro array<string>, depth long")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "without_extension")]
