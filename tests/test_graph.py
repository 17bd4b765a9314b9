"""The graph engine: resolution end to end, maintenance, streams, tools, and parity with SQL."""

import math

import duckdb
import fixtures as X
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codeatlas import demo
from codeatlas import functions as fn
from codeatlas.extract import extract
from codeatlas.graph import PropertyGraph, load, query, register, save
from codeatlas.incremental import Store, assign_ids, classify_status, classify_watched, detach_delete
from codeatlas.operators import aggregates, closure, joins, text
from codeatlas.plans import library as q
from codeatlas.plans.render import Xml, tree
from codeatlas.plans.tools import ToolError, Tools
from codeatlas.resolve import build_graph
from codeatlas.schema import DEFINITION, DIRECTORY, FILE, IMPORT, NODES, RELS
from codeatlas.sources import files as src
from codeatlas.sources.manifest import Manifest, project_hash
from codeatlas.streaming import sessions

TREE = X.PYTHON | X.JAVA | X.KOTLIN | X.TYPESCRIPT | X.RUBY


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, len(t), t, "ok", None) for p, t in TREE.items()]
    return src.with_language(spark.createDataFrame(rows, "path string, size long, text string, status string, reason string"))


@pytest.fixture(scope="module")
def graph(files, tmp_path_factory):
    g = build_graph(files, extract(files), "demo", "/w")
    at = str(tmp_path_factory.mktemp("graph"))
    save(g, at)
    return load(files.sparkSession, at)


def calls(g, rel, types=("CALLS", "AMBIGUOUSLY_CALLS")):
    name = {FILE: "path", DEFINITION: "fqn", IMPORT: "import_path"}
    x = g.expand(rel, F.col("type").isin(*types))
    return {tuple(r) for r in x.select(F.col(f"s.{name[rel.source]}"), F.col(f"t.{name[rel.target]}")).collect()}


def test_calls_resolve(graph):
    got = calls(graph, q.DEF_DEF)
    assert {
        ("User.label", "User.format"), ("User.format", "User.format.inner"), ("make", "User"), ("run", "User"), ("run", "Base.save"), ("run", "make"), ("run", "helper"), ("helper", "make"),
        ("com.x.Foo.run", "com.x.Bar.greet"), ("com.x.Foo.run", "com.x.Helper"), ("com.x.Foo.run", "com.x.Helper.assist"), ("k.Runner.go", "k.lib.greet"), ("k.Runner.go", "k.Base.step"), ("k.Base.step", "k.make"),
        ("Store::get", "load"), ("Auth::Session::open", "User"), ("Auth::Session::open", "User#greet"), ("Auth::Session#close", "Auth::Session#helper"),
    } <= got
    assert calls(graph, q.FILE_DEF) >= {("app/deep/chain.py", "make")} and calls(graph, q.DEF_IMP) == {("run", "json")}


def test_nesting_containment_and_endpoints(graph):
    kinds = {r["type"]: r["n"] for r in aggregates.count_by_type(graph, "DEFINITION_RELATIONSHIPS").collect()}
    assert kinds["CLASS_TO_METHOD"] == 4 + 4 + 1 + 4 + 2 and kinds["MODULE_TO_CLASS"] == 1
    for rel in RELS:
        assert graph.expand(rel).count() == graph.rel(rel).count()
    assert {r.path for r in graph.scan(DIRECTORY).collect()} == {"app", "app/deep", "src", "src/com", "src/com/x", "k", "k/lib", "web", "lib"}
    row = aggregates.node_counts(graph).first()
    assert row.files == len(TREE) and row.definitions == graph.scan(DEFINITION).count()


def test_sql_over_views(spark, graph):
    register(graph)
    assert query(spark, "SELECT count(*) AS n FROM FileNode WHERE array_contains(:xs, language)", xs=["Ruby", "Java"]).first().n == 5


def test_detach_delete_and_ids(spark, graph):
    gone = graph.scan(DEFINITION).where("fqn = 'User'").select("id")
    g = detach_delete(graph, DEFINITION, gone)
    assert g.scan(DEFINITION).count() == graph.scan(DEFINITION).count() - gone.count()
    ids = [r.id for r in gone.collect()]
    assert not g.table("DEFINITION_RELATIONSHIPS").where(F.col("source_id").isin(ids) & (F.col("from_label") == DEFINITION)).count()
    assert detach_delete(graph, DEFINITION, gone.limit(0)).scan(DEFINITION).count() == graph.scan(DEFINITION).count()
    old = spark.createDataFrame([(7, "a"), (9, "b")], "id long, path string")
    new = spark.createDataFrame([(p,) for p in ("b", "c", "d")], "path string")
    assert {r.path: r.id for r in assign_ids(new, old, DIRECTORY).collect()} == {"b": 9, "c": 10, "d": 11}


def test_change_classes(spark):
    s = classify_status(spark.createDataFrame([("a.py", " D"), ("b/", "??"), ("c.rb", " M")], "path string, code string"))
    assert {tuple(r) for r in s.collect()} == {("a.py", "deleted", "file"), ("b/", "added", "dir"), ("c.rb", "modified", "file")}
    w = classify_watched(spark.createDataFrame([("a.py",), ("lib",)], "path string"), spark.createDataFrame([("lib", True)], "path string, is_dir boolean"))
    assert {tuple(r) for r in w.collect()} == {("a.py", "deleted", "file"), ("lib", "changed", "dir")}


def test_store_swaps_versions(spark, graph, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    assert store.current() is None
    one = store.commit(PropertyGraph(spark, {FILE: graph.scan(FILE)}))
    two = store.commit(PropertyGraph(spark, {FILE: graph.scan(FILE).limit(2)}))
    assert one != two == store.current() and store.read().scan(FILE).count() == 2
    store.clean()
    assert not (tmp_path / "g" / one).exists()


def test_debounced_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", p, f"f{s % 3}") for p in (1, 2) for s in (0, 1, 2, 10, 11, 30)] + [("2024-01-01 01:00:00", 1, ".git/x"), ("2024-01-01 02:00:00", 9, "end")]
    e = spark.createDataFrame(rows, "ts string, project long, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    got = []
    stream = sessions.debounce(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    sessions.apply_changes(stream, lambda df, _: got.extend(map(tuple, df.select("project", "start", "n").collect())), str(tmp_path / "cp")).awaitTermination(120)
    want = {tuple(r) for r in sessions.debounce(e).where("project <> 9").select("project", "start", "n").collect()}
    assert set(got) == want and len(want) == 6


def test_tools_render(spark, graph, files):
    tools = Tools(graph, files.select("path", "text"))
    first, second = tools.search_definitions(["user"], 1, 1), tools.search_definitions(["user"], 2, 1)
    assert "<next-page>2</next-page>" in first and 'fqn="User"' in first + second
    refs = tools.get_references("greet", "src/com/x/Bar.java")
    assert 'fqn="com.x.Foo.run"' in refs and "other.greet();" in refs and "<next-page></next-page>" in refs
    assert "def helper" in tools.get_definition("app/api.py", "helper()", "helper")
    assert "return build" in tools.read_definitions([("helper", "app/util.py")])
    shown = tools.repo_map("app")
    assert "models.py" in shown and "Class User L6-17" in shown
    assert 'path="app/api.py"' in tools.import_usage([{"import_path": "json"}])
    with pytest.raises(ToolError):
        tools.search_definitions([" "])
    with pytest.raises(ValueError, match="invalid_node_type"):
        q.neighbours(graph, "Nope", 1)


def test_render():
    assert tree(["a/b.py", "c.py"]).splitlines() == [".", "├── a/", "│   └── b.py", "└── c.py"]
    assert str(Xml().start("x", a='"').text("y", "1]]>2", cdata=True).end()).count("<![CDATA[") == 2


def test_reading_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("é = 1\n")
    (tmp_path / "a" / "bad.rb").write_bytes(b"\xff\xfe")
    (tmp_path / "empty.java").write_text("")
    (tmp_path / "note.txt").write_text("no")
    (tmp_path / "big.py").write_text("#" * 200)
    (tmp_path / "w.min.js").write_text("x")
    got = {r.path: (r.status, r.text) for r in src.with_language(src.read_tree(spark, str(tmp_path), 100)).collect()}
    assert got == {"a/x.py": ("ok", "é = 1\n"), "a/bad.rb": ("skipped", None), "empty.java": ("ok", ""), "big.py": ("skipped", None), "w.min.js": ("skipped", "x")}


def test_text_tables(spark):
    f = spark.createDataFrame([("p", "a\n b \nc\n"), ("e", "")], "path string, text string")
    asked = spark.createDataFrame([("p", 1, 2), ("p", 0, 1), ("p", 3, 2), ("p", 9, 9), ("p", 2, 9), ("x", 1, 1)], "path string, start int, end int")
    assert [(r.chunk, r.error) for r in sorted(text.read_ranges(f, asked).collect(), key=lambda r: (r.path, r.start, r.end))] == [
        (None, "start_is_zero"), ("a\n b \n", None), (None, "end_beyond_end"), (None, "end_before_start"), (None, "start_beyond_end"), (None, "file_not_found"),
    ]
    assert [tuple(r) for r in text.match_lines(f, "b").collect()] == [("p", 2)]
    o = spark.createDataFrame([("é foo(foo)",)], "t string").select(fn.occurrences(F.col("t"), "foo").alias("o")).first().o
    assert [(x.start, x.end) for x in o] == [(3, 5), (7, 9)]


def test_hierarchy_lookups(spark):
    parents = spark.createDataFrame([("c", "m", 0), ("c", "b", 1), ("b", "a", 0), ("a", "c", 0)], "src string, dst string, rank int")
    members = spark.createDataFrame([("a", "f", "a.f"), ("b", "f", "b.f"), ("a", "g", "a.g")], "type string, name string, member string")
    asked = spark.createDataFrame([("c", "f"), ("c", "g"), ("c", "h")], "type string, name string")
    assert {(r.name, r.member) for r in closure.member_lookup(asked, parents, members).collect()} == {("f", "b.f"), ("g", "a.g")}
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(5, 0)], "src long, dst long")
    assert closure.closure(edges).count() == 36
    p = spark.createDataFrame([(1, 12)], "k int, offset int")
    r = spark.createDataFrame([(1, 0, 20), (1, 10, 15), (1, 12, 12), (2, 12, 12)], "k int, start int, end int")
    assert joins.innermost(p, r, "k").first().range.start == 12


def test_manifest(tmp_path):
    (tmp_path / "w" / "p" / ".git").mkdir(parents=True)
    m = Manifest(str(tmp_path / "data"))
    (project,) = m.register(str(tmp_path / "w"))
    assert m.status(str(tmp_path / "w")) == "pending" and len(project_hash(project)) == 16
    m.set_status(str(tmp_path / "w"), project, "indexed")
    assert m.status(str(tmp_path / "w")) == "indexed" and m.owner(project + "/a/b.py") == project and m.owner(project + "x") is None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["references_by_directory", "optional_match", "initial_graph", "neighbors_definition", "import_usage", "get_references", "chunk_read_status", "common_ancestor", "priority_preemption"])
def test_parity(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, rel = demo.queries()[name](spark, sf), c.sql(demo.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    key = lambda v: str(round(v, 4)) if isinstance(v, float) and not math.isnan(v) else str(v)
    got = sorted(tuple(key(r[k]) for k in columns) for r in df.collect())
    at = [rel.columns.index(k) for k in columns]
    assert got == sorted(tuple(key(r[i]) for i in at) for r in rel.fetchall())


def test_every_query_is_named_once():
    assert set(demo.oracle_sql()) <= set(demo.queries()) and len(NODES) == 4


def test_endpoints(graph):
    from codeatlas.plans.endpoints import Endpoints

    e = Endpoints({"p": graph}.get)
    assert e.initial("") == (400, {"error": "empty_project_path"}) and e.stats("x") == (404, {"error": "project_not_found"})
    assert e.search("p", " ")[1] == {"error": "empty_search_term"} and e.neighbours("p", "Nope", 1) == (400, {"error": "invalid_node_type"})
    status, body = e.initial("p", 5)
    ids = {n["id"] for n in body["nodes"]}
    assert status == 200 and body["relationships"] and all(r["source"] in ids and r["target"] in ids for r in body["relationships"])
    assert any(n["label"] == "Foo" for n in e.search("p", "FOO")[1]["nodes"])
    total = e.stats("p")[1]
    assert total["total_nodes"] == sum(total["nodes"].values()) and total["total_relationships"] == sum(total["relationships"].values())


def test_event_log(spark, tmp_path):
    from codeatlas.streaming.events import EventLog

    log = EventLog(spark, str(tmp_path / "events"))
    with log.record("project_indexing", "w", "p"):
        pass
    with pytest.raises(RuntimeError), log.record("project_indexing", "w", "q"):
        raise RuntimeError("no")
    assert {(r.project, r.phase, r.message) for r in log.latest().collect()} == {("p", "completed", ""), ("q", "failed", "no")}


def test_innermost_equals_brute_force(spark):
    points = [(k, at) for k in range(3) for at in range(0, 60, 3)]
    ranges = [(k, s, s + n) for k in range(2) for s, n in ((0, 50), (5, 10), (7, 10), (7, 3), (30, 4), (31, 2), (58, 9))]
    got = joins.innermost(spark.createDataFrame(points, "k int, offset int"), spark.createDataFrame(ranges, "k int, start int, end int"), "k").collect()
    want = {}
    for k, at in points:
        held = [(e - s, s) for q_, s, e in ranges if q_ == k and s <= at <= e]
        if held:
            want[k, at] = min(held)
    assert {(r.k, r.offset): (r.range.end - r.range.start, r.range.start) for r in got} == want and len(got) == len(want)


def test_closure_reaches_any_depth(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    got = {(r.src, r.dst): r.depth for r in closure.closure(chain).collect()}
    assert got == {(i, j): j - i for i in range(201) for j in range(i + 1, 201)}
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)] + [(0, 3)], "src long, dst long")
    want = {}
    for i in range(5):
        seen, level = {}, {i}
        for depth in range(1, 7):
            level = {y for x in level for y in ({(x + 1) % 5} | ({3} if x == 0 else set()))}
            for y in level:
                seen.setdefault(y, depth)
        want |= {(i, y): d for y, d in seen.items()}
    assert {(r.src, r.dst): r.depth for r in closure.closure(ring).collect()} == want
    assert {(r.src, r.dst): r.depth for r in closure.closure(ring, ring.select("src").where("src = 2")).collect()} == {k: d for k, d in want.items() if k[0] == 2}
    far = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long")
    assert [tuple(r) for r in closure.terminals(far, far.where("src = 0").select("src")).collect()] == [(0, 70, 70)]
    assert closure.closure(chain.limit(0)).count() == 0


def test_store_keeps_the_old_version_until_the_new_one_is_whole(spark, graph, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.current() is None and store.read().scan(FILE).count() == 0
    first = store.commit(graph)
    (tmp_path / "s" / "v-000000000009-dead").mkdir()  # a write that never ended
    assert store.current() == first and store.read().scan(FILE).count() == graph.scan(FILE).count()
    second = store.commit(detach_delete(graph, FILE, graph.scan(FILE).select("id")))
    assert store.current() == second and store.read().scan(FILE).count() == 0
    store.clean()
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == sorted([f"done-{second}", second])


def test_rule_tables_name_known_relationships(spark):
    from codeatlas.resolve.rules import RULES, rule_table

    assert {lang: len(r.strip().split("\n")) for lang, r in RULES.items()} == {"Ruby": 9, "Python": 12, "TypeScript": 8, "Java": 17, "Kotlin": 22, "CSharp": 15, "Rust": 7}
    rules = [tuple(r) for r in rule_table(spark).collect()]
    assert len(set(rules)) == 90 and ("Kotlin", "Function", "Function", "METHOD_TO_METHOD") in rules and ("Rust", "Module", "*", "MODULE_TO_SINGLETON_METHOD") in rules


def test_from_folder_to_stored_graph(spark, tmp_path):
    import subprocess

    from codeatlas.workspaces import Followers, Workspaces

    root = tmp_path / "ws" / "proj"
    for path, t in X.PYTHON.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(t)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    w = Workspaces(spark, str(tmp_path / "data"))
    assert w.index(str(tmp_path / "none")) == (400, {"status": "invalid_workspace_path"})
    (tmp_path / "empty").mkdir()
    assert w.index(str(tmp_path / "empty"))[1] == {"status": "no_projects_found_in_workspace"}
    status, body = w.index(str(tmp_path / "ws"))
    assert status == 200 and body["status"] == "indexed" and body["project_count"] == 1
    g = w.graph(str(root))
    assert ("run", "make") in calls(g, q.DEF_DEF) and {r.path for r in g.scan(FILE).collect()} == set(X.PYTHON)
    assert f"<project_path>{root}</project_path>" in w.list_projects() and w.manifest.watched() == [str(root)]
    assert w.events.latest().select("phase").first()[0] == "completed" and w.health() == (200, {"status": "ok"}) and w.info()[1]["name"] == "codeatlas"
    started = []

    class Query:
        isActive = True

        def stop(self):
            started.append("stopped")

    f = Followers(w.manifest, lambda p: started.append(p) or Query())
    assert f.reconcile() == ([str(root)], []) and f.reconcile() == ([], [])
    w.manifest.set_status(str(tmp_path / "ws"), str(root), "error", "x")
    assert f.reconcile() == ([], [str(root)]) and started == [str(root), "stopped"] and w.manifest.projects("indexed") == []
    assert w.delete(str(tmp_path / "ws"))[0] == 200 and w.graph(str(root)) is None and w.delete(str(tmp_path / "ws"))[0] == 404


def test_python_imports_start_at_package_roots(spark):
    tree = {"top/pkg/__init__.py": "", "top/pkg/json.py": "def dumps():\n    pass\n", "top/main.py": "import json\nfrom pkg.json import dumps\n\n\ndef go():\n    dumps()\n", "top/other/json.py": ""}
    files = src.with_language(spark.createDataFrame([(p, len(t), t, "ok", None) for p, t in tree.items()], "path string, size long, text string, status string, reason string"))
    g = build_graph(files, extract(files))
    assert calls(g, q.DEF_DEF) == {("go", "dumps")}
    to_file = next(r for r in RELS if (r.source, r.target) == (IMPORT, FILE))
    assert g.expand(to_file).count() == 0  # neither json.py stands at a root or beside main.py
