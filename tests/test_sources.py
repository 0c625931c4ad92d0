"""Readers, construction passes and streams on files written here."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from arbora.functions.text import porter_stem, stem
from arbora.operators import construct as N
from arbora.operators import joins as J
from arbora.sources import readers as R
from arbora.sources import writers as O
from arbora.streaming.incremental import anchored_counts, file_changes, watch


def files(spark, tree):
    return spark.createDataFrame(list(tree.items()), "file_path string, content string")


def texts(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "text string")


def test_ignore_globs():
    hit = lambda g, p: R.matches_any(p, [g])
    assert hit("*.log", "a/b.log") and hit("build/", "x/build/y") and hit("src/**/t?.py", "src/a/b/t1.py") and not hit("build/", "rebuild/y")
    assert R.parse_ignore("# c\n\n!keep\nout/\n") == ["out/"]


def test_scan_files(spark, tmp_path):
    for p, t in {"a.py": "x = 1\n", "node_modules/m.js": "no", "img.png": "no", "sub/b.md": "# t", "big.txt": "x" * 2000}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    got = R.scan_files(spark, str(tmp_path), max_bytes=1000)
    assert sorted(r.file_path for r in got.collect()) == ["a.py", "sub/b.md"]


def test_coverage_readers(spark):
    lcov = "TN:\nSF:src/a.ts\nFN:1,f\nFN:9,g\nFNDA:3,f\nFNDA:0,g\nDA:1,3\nDA:2,0\nend_of_record\nSF:b.ts\nDA:1,1\nend_of_record\n"
    rows = {r.file_path: r for r in R.read_lcov(texts(spark, lcov)).collect()}
    assert rows["src/a.ts"].line_share == 50 and [(f.name, f.line, f.hits) for f in rows["src/a.ts"].functions] == [("f", 1, 3), ("g", 9, 0)] and rows["b.ts"].line_share == 100
    ist = json.dumps({"a.ts": {"path": "a.ts", "statementMap": {"0": {"start": {"line": 1}}, "1": {"start": {"line": 2}}}, "s": {"0": 2, "1": 0}, "fnMap": {"0": {"name": "f", "line": 1}}, "f": {"0": 2}}})
    one = R.read_istanbul(texts(spark, ist)).first()
    assert (one.file_path, one.line_share, one.function_share) == ("a.ts", 50, 100)
    cob = '<coverage><class name="A" filename="A.java"><methods><method name="m"><lines><line number="3" hits="1"/></lines></method></methods><lines><line number="3" hits="1"/><line number="4" hits="0"/></lines></class></coverage>'
    one = R.read_cobertura(texts(spark, cob)).first()
    assert (one.file_path, one.line_share, one.functions[0].name) == ("A.java", 50, "m")
    kinds = texts(spark, lcov, ist, cob, "?").select(R.coverage_format(F.col("text")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["lcov", "istanbul", "cobertura", "unknown"]


def test_manifests(spark):
    tree = {
        "package.json": '{"dependencies": {"react": "^18.2.0"}, "devDependencies": {"jest": "29"}}',
        "py/requirements.txt": "flask==2.0\n# c\nnumpy>=1.2\n",
        "go.mod": "module x\nrequire github.com/gin-gonic/gin v1.9.0\n",
        "Cargo.toml": '[package]\nname = "x"\n[dependencies]\ntokio = { version = "1.0" }\nserde = "1"\n',
        "broken/package.json": "{",
    }
    got = {(r.name, r.version, r.ecosystem) for r in R.read_manifests(files(spark, tree)).collect()}
    assert got == {("react", "^18.2.0", "npm"), ("jest", "29", "npm"), ("flask", "2.0", "PyPI"), ("numpy", "1.2", "PyPI"), ("github.com/gin-gonic/gin", "1.9.0", "Go"), ("tokio", "1.0", "crates.io"), ("serde", "1", "crates.io")}
    tree |= {"web/package.json": '{"dependencies": {"express": "4", "next": "13"}, "devDependencies": {"express": "5"}}', "lib/requirements.txt": "django\n", "api/pyproject.toml": "flask = 1", "api/requirements.txt": "Flask\n# django\n"}
    got = {(r["name"], r.ecosystem, r.version, r.detected_from, r.scope) for r in N.frameworks(files(spark, tree)).collect()}
    assert got == {
        ("gin", "go", None, "go.mod", "root"), ("tokio", "rust", None, "Cargo.toml", "root"), ("express", "javascript", "5", "package.json", "web"), ("next", "javascript", "13", "package.json", "web"),
        ("flask", "python", None, "requirements.txt", "api"),
    }
    assert {(r.src, r.dst) for r in N.framework_edges(N.frameworks(files(spark, tree))).collect()} >= {("folder:", "framework:go:gin:root"), ("pkg:api", "framework:python:flask:api")}
    adv = spark.createDataFrame([("flask", "PyPI", "2.0", "A-1", "high")], "name string, ecosystem string, vulnerable_version string, advisory string, severity string")
    assert R.known_vulnerabilities(R.read_manifests(files(spark, tree)), adv).where("advisory is not null").count() == 1


def test_contract_manifests(spark):
    tree = {"api.json": '{"paths": {"/u": {"get": {}, "post": {}}}}', "docker-compose.yml": "services:\n  web:\n    image: x\n  db:\n    image: y\nvolumes:\n  v:\n", "s.proto": "service Users {\n  rpc Get (A) returns (B);\n}\n"}
    got = {(r.kind, r["name"], r.method) for r in R.read_contract_manifests(files(spark, tree)).collect()}
    assert got == {("http", "/u", "GET"), ("http", "/u", "POST"), ("service", "web", ""), ("service", "db", ""), ("grpc", "Users", "Get")}


def test_sqlite_graph(spark, tmp_path):
    path = str(tmp_path / "g.db")
    con = sqlite3.connect(path)
    con.execute("create table nodes (id text, label text, properties text)")
    con.execute("create table relationships (id text, source_id text, target_id text, type text, confidence real)")
    con.executemany("insert into nodes values (?, ?, ?)", [("a", "Class", '{"name": "A", "startLine": 3}'), ("b", "Method", "{broken")])
    con.execute("insert into relationships values ('e', 'a', 'b', 'HAS_METHOD', 0.95)")
    con.commit()
    g = R.load_sqlite(spark, path)
    v = {r.id: r for r in g.vertices.collect()}
    assert v["a"]["name"] == "A" and v["a"].start_line == 3 and v["b"]["name"] is None
    assert g.edges.first().confidence == 0.95


def test_csv_graph(spark, tmp_path):
    (tmp_path / "method.csv").write_text('id,name,filePath\nm1,"a ""q"", b",x.ts\n')
    (tmp_path / "rel.csv").write_text("source,target,type,confidence\nm1,m1,DEFINES,0.5\nm1,m1,FETCHES,1\n")
    g = R.load_csv_graph(spark, {"method": str(tmp_path / "method.csv")}, str(tmp_path / "rel.csv"))
    assert g.vertices.first().label == "Function" and g.vertices.first()["name"] == 'a "q", b'
    assert [(r.type, r.confidence) for r in g.edges.collect()] == [("CONTAINS", 0.5)]


def test_exports(spark, tmp_path):
    from arbora.features.matrices import vertex_features
    from test_graphs import graph

    g = graph(spark, [("A", "B"), ("B", "C")])
    O.write_csv(g, str(tmp_path / "csv"))
    O.write_ndjson(g, str(tmp_path / "nd"))
    O.write_npz(g, vertex_features(g), str(tmp_path / "x.npz"))
    import numpy as np

    z = np.load(str(tmp_path / "x.npz"))
    assert z["edge_index"].tolist() == [[0, 1], [1, 2]] and len(z["node_feat"]) == 3
    assert spark.read.text(str(tmp_path / "nd")).count() == 5 and spark.read.csv(str(tmp_path / "csv/nodes"), header=True).count() == 3
    lines = [r.line for r in O.mermaid_lines(g.edges).orderBy("src").collect()]
    assert lines[0] == 'A["A"] -->|CALLS| B["B"]'


def test_structure(spark):
    g = N.structure(files(spark, {"a/b/c.py": "", "a/package.json": "", "top.md": ""}))
    ids = {r.id for r in g.vertices.collect()}
    assert ids == {"file:a/b/c.py", "file:a/package.json", "file:top.md", "folder:a", "folder:a/b", "pkg:a"}
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("folder:a/b", "file:a/b/c.py"), ("folder:a", "file:a/package.json"), ("folder:a", "folder:a/b"), ("folder:a", "pkg:a")}


def test_python_symbols(spark):
    src = "import os\nfrom .m import f as g\nclass A(Base):\n    x: int = 1\n    def run(self, a):\n        return g(a)\ndef _top():\n    A().run(1)\n"
    got = N.python_symbols(files(spark, {"p.py": src, "bad.py": "def ("})).collect()
    seen = {(r.kind, r.label, r.name, r.owner) for r in got}
    assert seen >= {("symbol", "Class", "A", None), ("extends", "Class", "Base", "A"), ("symbol", "Property", "x", "A"), ("symbol", "Method", "run", "A"), ("symbol", "Function", "_top", None), ("import", "Import", "f", ".m"), ("call", "Call", "g", "run"), ("call", "Call", "run", "_top")}
    assert {r.name: r.exported for r in got if r.kind == "symbol"}["_top"] is False


def test_declared_symbols(spark):
    tree = {"a.ts": "export class C {}\nexport async function f() {}\nconst g = (x) => x\ninterface I {}\ntype T = 1\nenum E {}\n", "b.go": "func (r R) Do() {}\ntype S struct {}\n", "c.rs": "pub fn x() {}\ntrait T {}\n", "d.sql": "CREATE OR REPLACE TABLE `p.t` (x int);\ncreate function f() as 1;\ncreate schema s;\n"}
    got = {(r.file_path, r.label, r.name) for r in N.declared_symbols(files(spark, tree)).collect()}
    assert got == {("a.ts", "Class", "C"), ("a.ts", "Function", "f"), ("a.ts", "Function", "g"), ("a.ts", "Interface", "I"), ("a.ts", "TypeAlias", "T"), ("a.ts", "Enum", "E"), ("b.go", "Function", "Do"), ("b.go", "Struct", "S"), ("c.rs", "Function", "x"), ("c.rs", "Trait", "T"), ("d.sql", "Class", "p.t"), ("d.sql", "Function", "f"), ("d.sql", "Namespace", "s")}


def test_routes_tools_models(spark):
    tree = {"a.js": "router.get('/u/:id', h)\nfetch('/u/1')\nserver.tool('t1', x)\nprisma.user.findMany()\n", "b.py": "@app.post('/p')\nclass U(db.Model): pass\n", "c.java": '@GetMapping("/j")\n', "s.proto": "rpc Get (A)"}
    f = files(spark, tree)
    found = N.routes(f, every_file=True)
    assert {(r.framework, r.method, r.path) for r in found.collect()} >= {("express", "get", "/u/:id"), ("koa", "GET", "/u/:id"), ("fastapi", "post", "/p"), ("spring", "GET", "/j")}
    assert N.routes(f).count() == 0
    assert {(r.kind, r.name) for r in N.tools(f).collect()} == {("mcp", "t1"), ("grpc", "Get")}
    assert {(r.mapper, r.model, r.is_query) for r in N.data_models(f).collect()} == {("prisma", "user", True), ("sqlalchemy", "U", False)}
    urls = N.fetches(f).select(F.col("file_path").alias("url_id"), F.col("url").alias("path"))
    assert J.match_routes(urls, found.select(F.col("id").alias("route_id"), F.col("path").alias("pattern"))).count() == 2  # express and koa
    fns = spark.createDataFrame([("fn:1", "a.js")], "id string, file_path string")
    assert N.query_edges(N.data_models(f), fns).first().dst == "model:prisma:user"


def test_markdown(spark):
    f = files(spark, {"d/a.md": "# One\ntext [x](../b.md#s) [y](http://z)\n## `Two`\n[z](c.md)\n", "b.md": "", "d/c.md": ""})
    heads, links = N.markdown_sections(f)
    assert [(r.level, r.title, r.slug) for r in heads.orderBy("line").collect()] == [(1, "One", "one"), (2, "Two", "two")]
    assert {(r.target, r.heading) for r in links.collect()} == {("../b.md#s", "One"), ("http://z", "One"), ("c.md", "Two")}
    assert {r.dst for r in N.link_edges(links, f).collect()} == {"file:b.md", "file:d/c.md"}


def test_security_patterns_services(spark):
    f = files(spark, {"svc/package.json": "{}", "svc/src/a.ts": "const k = 'x'\nkey = 'AKIA" + "A1" * 8 + "'\nlogin()", "lib.rs": "impl A for B {}", "s.cbl": "PROGRAM-ID. MAIN.\nCALL 'SUB'\nCOPY 'BOOK'"})
    found = N.security_findings(f, "file_path", "content").collect()
    assert [(r.rule, r.line) for r in found] == [("AWS Access Key", 2)]
    assert {r.rule for r in N.security_findings(f, "file_path", "content", "medium", N.SENSITIVE).collect()} == {"auth"}
    assert {r.pattern for r in N.design_patterns(f).collect()} == {"rust-trait-impl"}
    assert [(r.dir, r.score) for r in N.service_boundaries(f).collect()] == [("svc", 0.6)]
    assert {(r.kind, r.name) for r in N.cobol_programs(f).collect()} == {("program", "MAIN"), ("call", "SUB"), ("copy", "BOOK")}


def test_accesses_and_mro(spark):
    f = files(spark, {"a.ts": "this.count = 1; x.size; call.me()"})
    props = spark.createDataFrame([("p1", "count", "a.ts"), ("p2", "count", "b.ts"), ("p3", "size", "b.ts"), ("p4", "me", "a.ts")], "id string, name string, file_path string")
    assert {r.dst for r in N.access_edges(f, props).collect()} == {"p1", "p3"}
    e = spark.createDataFrame([("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0), ("X", "Y", 0), ("Y", "X", 0)], "class string, base string, position int")
    got = {r["class"]: r.mro for r in N.mro(e).collect()}
    assert got["D"] == ["D", "B", "C", "A"] and got["X"] == ["X", "Y"]
    methods = spark.createDataFrame([("A", "m"), ("B", "m"), ("A", "n")], "class string, name string")
    inherited = {(r["class"], r["name"]): r.defined_in for r in J.inherited_methods(N.mro(e), methods).collect()}
    assert inherited["D", "m"] == "B" and inherited["D", "n"] == "A"


def test_file_changes_with_nothing_known(spark):
    now = spark.createDataFrame([("a", "1")], "file_path string, hash string")
    assert file_changes(now.limit(0), now).first().status == "added"


def test_watch_applies_the_last_event_per_path(spark, tmp_path):
    rows = [("a", 1, "add"), ("a", 2, "unlink"), ("b", 1, "add")]
    spark.createDataFrame(rows, "path string, at int, event string").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    src = spark.readStream.schema("path string, at int, event string").parquet(str(tmp_path / "in"))
    q = watch(src, "path", "at", "event", lambda df, n: seen.extend((r.path, r.event) for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert sorted(seen) == [("a", "unlink"), ("b", "add")]


def test_anchored_rate_limit(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:{s:02}") for s in (10, 20, 30)] + [("k", "2024-01-01 00:01:15")]
    spark.createDataFrame(rows, "key string, t string").select("key", F.to_timestamp("t").alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in"))
    q = anchored_counts(src, "key", "at", seconds=60, limit=2).writeStream.format("memory").queryName("anchored").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.n, r.allowed) for r in spark.sql("select n, allowed from anchored order by at").collect()] == [(1, True), (2, True), (3, False), (1, True)]


def test_porter_stemmer(spark):
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt", "controlling": "control", "rate": "rate", "be": "be"}
    assert {w: porter_stem(w) for w in want} == want
    words = spark.createDataFrame([("running",), (None,)], "w string")
    assert [r[0] for r in words.select(stem("w")).collect()] == ["run", None]


def test_routes_by_place_and_prefix(spark):
    tree = {
        "src/app/api/users/[id]/route.ts": "export async function GET() {}\nexport const POST = 1",
        "app/(shop)/cart/page.tsx": "",
        "app/users/[id].tsx": "import 'expo-router'",
        "app/index.js": "from 'expo-router'",
        "cats.controller.ts": "@Controller('cats')\n@Get()\n@Post('/new')\n@Put(':id')",
        "api/views.py": "@api_view(['GET', 'POST'])\n@action(detail=True, methods=['put'])",
        "x.pug": "  form(action='/go' method='post')",
        "routes/a.js": "@RequestMapping(value = '/m', method = RequestMethod.PUT) @RequestMapping('/n')",
    }
    got = {(r.file_path, r.framework, r.method, r.path) for r in N.routes(files(spark, tree)).collect()}
    assert got == {
        ("src/app/api/users/[id]/route.ts", "nextjs", "GET", "[inferred]"), ("src/app/api/users/[id]/route.ts", "nextjs", "POST", "[inferred]"),
        ("src/app/api/users/[id]/route.ts", "nextjs-app", "GET", "/api/users/:id"), ("src/app/api/users/[id]/route.ts", "nextjs-app", "POST", "/api/users/:id"),
        ("app/(shop)/cart/page.tsx", "nextjs-app", "GET", "/(shop)/cart"), ("app/users/[id].tsx", "expo", "GET", "/users/:id"), ("app/index.js", "expo", "GET", "/"),
        ("cats.controller.ts", "nestjs", "GET", "/cats"), ("cats.controller.ts", "nestjs", "POST", "/cats/new"), ("cats.controller.ts", "nestjs", "PUT", "/cats/:id"),
        ("api/views.py", "django-rest", "GET, POST", "[inferred]"), ("api/views.py", "django-rest", "put", "[inferred]"), ("x.pug", "pug-template", "GET", "/go"),
        ("routes/a.js", "spring", "PUT", "/m"), ("routes/a.js", "spring", "ANY", "/n"),
    }


def test_code_shapes(spark):
    from arbora.operators.shapes import code_shapes

    code = """
    app.get('/x', auth, limit(3), (req, res) => { res.status(404).json({ error: 'a:b', code: { deep: 1 } }); })
    router.use(cors); export default withAuth(async (req) => { return { id: 1, 'quoted': 2, list: [1, { no: 2 }], last: f({ a: 1 }) } })
    x = Depends(get_db)
    @login_required
    Route::get('/y')->middleware('throttle:60');
    const { name, age: years, data } = await response; use(data?.total, result['key'], res.body, other.field, 3.14)
    """
    r = code_shapes(files(spark, {"a.js": code, "none.js": None, "open.js": "return { a: 1, b: ["})).collect()
    a = {x.file_path: x for x in r}
    assert a["a.js"].response_keys == ["id", "list", "last"] and a["a.js"].error_keys == ["error", "code"]
    assert a["a.js"].middleware == ["auth", "withAuth", "cors", "get_db", "login_required", "throttle"]
    assert sorted(a["a.js"].accessed) == ["age", "body", "key", "name", "status", "total"]
    assert a["none.js"].response_keys == [] and a["open.js"].response_keys == ["a", "b"]


def test_aliases(spark):
    config = '{"compilerOptions": {"paths": {"@/*": ["./src/*"], "@lib": ["src/lib/index.ts", "x"], "none": []}}}'
    configs = spark.createDataFrame([("r", config), ("broken", "{")], "scope string, content string")
    imports = spark.createDataFrame([("r", s) for s in ("@/a/b.tsx", "@lib", "@lib/x", "react")] + [("other", "@/a")], "scope string, spec string")
    got = {(r.scope, r.spec): r.resolved for r in R.resolve_aliases(imports, R.read_aliases(configs)).collect()}
    assert got == {("r", "@/a/b.tsx"): "src/a/b", ("r", "@lib"): "src/lib/index", ("r", "@lib/x"): "@lib/x", ("r", "react"): "react", ("other", "@/a"): "@/a"}


def test_changed_paths(spark):
    unified = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\ndiff --git a/o b/n\nrename from o\nrename to n\n"
    got = R.changed_paths(texts(spark, unified, "a b.txt\nc.md\r\n\n", "", None)).collect()
    assert sorted(r.file_path for r in got) == ["a b.txt", "c.md", "gone", "n", "x.py"]


def test_hash_table(spark, tmp_path):
    from arbora.streaming.incremental import load_hashes, save_hashes

    path = str(tmp_path / "hashes")
    assert load_hashes(spark, path) is None
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "file_path string, hash string")
    save_hashes(now, path, "abc")
    assert {tuple(r) for r in load_hashes(spark, path).collect()} == {("a", "1", "abc"), ("b", "2", "abc")}
    now.write.mode("overwrite").parquet(path)
    assert load_hashes(spark, path) is None


def test_snapshots(spark, tmp_path):
    from arbora.streaming.incremental import append_snapshot, load_snapshots

    path = str(tmp_path / "snaps")
    for k in range(4):
        append_snapshot(spark.createDataFrame([(k, float(k))], "n int, health double"), path, f"2024-01-0{k + 1}T00:00:00Z", branch="main")
    assert [r.n for r in load_snapshots(spark, path).collect()] == [0, 1, 2, 3]
    assert [r.n for r in load_snapshots(spark, path, since="2024-01-02T00:00:00Z", until="2024-01-03T00:00:00Z").collect()] == [1, 2]
    assert [r.n for r in load_snapshots(spark, path, limit=2).collect()] == [2, 3]


@pytest.mark.parametrize("backend", ["parquet", "orc", "json", "csv"])
def test_graph_store(spark, tmp_path, backend):
    from arbora.sources.store import GraphStore
    from test_graphs import graph

    store = GraphStore(spark, str(tmp_path / "g"), backend)
    g = graph(spark, [("A", "B"), ("B", "C")])
    store.save(g)
    fresh = g.vertices.where("id = 'A'").withColumn("name", F.lit("new"))
    store.merge(fresh.unionByName(fresh.withColumn("id", F.lit("Z"))), g.edges.where("src = 'A'").withColumn("confidence", F.lit(0.25)))
    got = store.load()
    assert {r.id: r["name"] for r in got.vertices.collect()}["A"] == "new" and got.vertices.count() == 4
    assert {(r.src, r.dst): r.confidence for r in got.edges.collect()}["A", "B"] == 0.25 and got.edges.count() == 2
    with pytest.raises(ValueError):
        GraphStore(spark, "x", "nothing")


def test_node_link_round_trip(spark):
    from test_graphs import graph

    g = graph(spark, [("A", "B"), ("A", "C"), ("C", "A")])
    back = O.read_node_link(O.node_link_rows(g))
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    assert key(back.vertices, "id", "label", "name") == key(g.vertices, "id", "label", "name")
    assert key(back.edges, "src", "dst", "type", "confidence") == key(g.edges, "src", "dst", "type", "confidence")
    assert {r.id: r.neighbours for r in O.adjacency_lists(g).collect()} == {"A": ["B", "C"], "B": [], "C": ["A"]}


def test_deep_inheritance(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 0) for i in range(1500)], "class string, base string, position int")
    got = {r["class"]: r.depth for r in N.mro(chain).collect()}
    assert got["c0"] == 1500 and got["c1499"] == 1
