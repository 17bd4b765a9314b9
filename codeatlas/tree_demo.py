"""Extraction and resolution over a generated source tree, with SQL for what must come out.

Every supplier gives a file in each of seven languages, whose text holds the supplier's number {k} and its
nation's {n}. The facts are written by hand beside the texts; SQL multiplies them with the table ``supplier``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import extract
from .functions import parent_path
from .graph import PropertyGraph, load, save
from .plans import library as q
from .resolve import build_graph
from .schema import DEFINITION, DIRECTORY, FILE, IMPORT, RELS
from .session import shared_dir
from .sources import files as src

L = F.lit
TEXTS = {
    "py/n{n}/m{k}.py": "import os\n\nclass Base{k}:\n    def save(self):\n        return helper{k}()\n\nclass Item{k}(Base{k}):\n    @property\n    def label(self):\n        return self.save()\n\ndef helper{k}():\n    def inner():\n        return 1\n    return inner()\n",
    "py/n{n}/use{k}.py": "from .m{k} import Item{k}, helper{k} as h{k}\nimport json\n\ndef run{k}():\n    h{k}()\n    x = Item{k}()\n    x.save()\n    json.dumps(x)\n",
    "py/n{n}/again{k}.py": "from .use{k} import h{k} as most\n\nmost()\n",
    "java/C{k}.java": "package s{k};\n\nimport java.util.List;\n\npublic class C{k} {\n    enum Kind { LOW, HIGH }\n\n    public C{k}() {\n    }\n\n    void run(D{k} d) {\n        d.greet();\n        step();\n    }\n\n    void step() {\n    }\n}\n",
    "java/D{k}.java": "package s{k};\n\ninterface D{k} {\n    void greet();\n}\n",
    "kt/K{k}.kt": "package t{k}\n\ndata class Point{k}(val x: Int)\n\nopen class Base{k} {\n    fun step() {\n    }\n}\n\nclass Runner{k} : Base{k}() {\n    val size = 1\n\n    fun go() {\n        step()\n        make{k}()\n    }\n}\n\nfun make{k}(): Point{k} = Point{k}(1)\n\nclass Vec{k}(val n: Int) {\n    operator fun plus(o: Vec{k}): Vec{k} {\n        return o\n    }\n}\n\nfun Vec{k}.twice(): Vec{k} {\n    return this\n}\n\nfun sum{k}(a: Vec{k}, b: Vec{k}) {\n    a + b\n    a.twice()\n}\n",
    "cs/App{k}.cs": "using System;\n\nnamespace App{k} {\n    public class Program {\n        public int Size { get; set; }\n        public static void Main(string[] args) {\n        }\n        void Run() { }\n    }\n}\n",
    "rs/l{k}.rs": "use std::fmt;\n\npub struct P{k} { x: i32 }\n\nenum E{k} { One, Two }\n\nimpl P{k} {\n    pub fn new() -> Self { P{k} { x: 0 } }\n    fn len(&self) -> i32 { 1 }\n}\n\nmod inner {\n    pub fn f() {}\n}\n",
    "ts/w{k}.ts": "import { readFile as rf } from 'fs';\n\nexport class Store{k} {\n  get(key: string): string {\n    return load{k}(key);\n  }\n}\n\nfunction load{k}(key: string) {\n  return key;\n}\n",
    "rb/a{k}.rb": "require 'json'\n\nmodule Auth{k}\n  class User{k}\n    def greet\n      1\n    end\n  end\n\n  class Session{k}\n    def self.open\n      user = User{k}.new\n      user.greet\n      user.present?\n    end\n  end\nend\n",
    "ts/skip{k}.min.js": "function hidden() {}\n",
    "notes/n{k}.md": "no code\n",
}
# Facts of the texts, by hand: file | definition type | fqn | first line | last line (from 0).
DEFINITIONS = """
py/n{n}/m{k}.py|Class|Base{k}|2|4
py/n{n}/m{k}.py|Method|Base{k}.save|3|4
py/n{n}/m{k}.py|Class|Item{k}|6|9
py/n{n}/m{k}.py|DecoratedMethod|Item{k}.label|8|9
py/n{n}/m{k}.py|Function|helper{k}|11|14
py/n{n}/m{k}.py|Function|helper{k}.inner|12|13
py/n{n}/use{k}.py|Function|run{k}|3|7
java/C{k}.java|Class|s{k}.C{k}|4|17
java/C{k}.java|Enum|s{k}.C{k}.Kind|5|5
java/C{k}.java|EnumConstant|s{k}.C{k}.Kind.LOW|5|5
java/C{k}.java|EnumConstant|s{k}.C{k}.Kind.HIGH|5|5
java/C{k}.java|Constructor|s{k}.C{k}.C{k}|7|8
java/C{k}.java|Method|s{k}.C{k}.run|10|13
java/C{k}.java|Method|s{k}.C{k}.step|15|16
java/D{k}.java|Interface|s{k}.D{k}|2|4
java/D{k}.java|Method|s{k}.D{k}.greet|3|3
kt/K{k}.kt|DataClass|t{k}.Point{k}|2|2
kt/K{k}.kt|Property|t{k}.Point{k}.x|2|2
kt/K{k}.kt|Class|t{k}.Base{k}|4|7
kt/K{k}.kt|Function|t{k}.Base{k}.step|5|6
kt/K{k}.kt|Class|t{k}.Runner{k}|9|16
kt/K{k}.kt|Property|t{k}.Runner{k}.size|10|10
kt/K{k}.kt|Function|t{k}.Runner{k}.go|12|15
kt/K{k}.kt|Function|t{k}.make{k}|18|18
kt/K{k}.kt|Class|t{k}.Vec{k}|20|24
kt/K{k}.kt|Property|t{k}.Vec{k}.n|20|20
kt/K{k}.kt|Function|t{k}.Vec{k}.plus|21|23
kt/K{k}.kt|Function|t{k}.twice|26|28
kt/K{k}.kt|Function|t{k}.sum{k}|30|33
cs/App{k}.cs|Namespace|App{k}|2|9
cs/App{k}.cs|Class|App{k}.Program|3|8
cs/App{k}.cs|Property|App{k}.Program.Size|4|4
cs/App{k}.cs|StaticMethod|App{k}.Program.Main|5|6
cs/App{k}.cs|InstanceMethod|App{k}.Program.Run|7|7
rs/l{k}.rs|Struct|P{k}|2|2
rs/l{k}.rs|Field|P{k}::x|2|2
rs/l{k}.rs|Enum|E{k}|4|4
rs/l{k}.rs|Variant|E{k}::One|4|4
rs/l{k}.rs|Variant|E{k}::Two|4|4
rs/l{k}.rs|Impl|impl P{k}|6|9
rs/l{k}.rs|AssociatedFunction|P{k}::new|7|7
rs/l{k}.rs|Method|P{k}::len|8|8
rs/l{k}.rs|Module|inner|11|13
rs/l{k}.rs|Function|inner::f|12|12
ts/w{k}.ts|Class|Store{k}|2|6
ts/w{k}.ts|Method|Store{k}::get|3|5
ts/w{k}.ts|Function|load{k}|8|10
rb/a{k}.rb|Module|Auth{k}|2|16
rb/a{k}.rb|Class|Auth{k}::User{k}|3|7
rb/a{k}.rb|Method|Auth{k}::User{k}#greet|4|6
rb/a{k}.rb|Class|Auth{k}::Session{k}|9|15
rb/a{k}.rb|SingletonMethod|Auth{k}::Session{k}::open|10|14
"""
# file | import type | path | name | alias
IMPORTS = """
py/n{n}/m{k}.py|Import|os|os|
py/n{n}/use{k}.py|FromImport|.m{k}|Item{k}|
py/n{n}/use{k}.py|AliasedFromImport|.m{k}|helper{k}|h{k}
py/n{n}/use{k}.py|Import|json|json|
py/n{n}/again{k}.py|AliasedFromImport|.use{k}|h{k}|most
java/C{k}.java|Import|java.util|List|
cs/App{k}.cs|Using|System|System|
rs/l{k}.rs|Use|std|fmt|
ts/w{k}.ts|AliasedImport|fs|readFile|rf
rb/a{k}.rb|Require|json|json|
"""
# parent | child | relationship
RELATIONS = """
Base{k}|Base{k}.save|CLASS_TO_METHOD
Item{k}|Item{k}.label|CLASS_TO_METHOD
helper{k}|helper{k}.inner|FUNCTION_TO_FUNCTION
s{k}.C{k}|s{k}.C{k}.Kind|CLASS_TO_CLASS
s{k}.C{k}.Kind|s{k}.C{k}.Kind.LOW|CLASS_TO_ENUM_ENTRY
s{k}.C{k}.Kind|s{k}.C{k}.Kind.HIGH|CLASS_TO_ENUM_ENTRY
s{k}.C{k}|s{k}.C{k}.C{k}|CLASS_TO_METHOD
s{k}.C{k}|s{k}.C{k}.run|CLASS_TO_METHOD
s{k}.C{k}|s{k}.C{k}.step|CLASS_TO_METHOD
s{k}.D{k}|s{k}.D{k}.greet|INTERFACE_TO_METHOD
t{k}.Point{k}|t{k}.Point{k}.x|CLASS_TO_PROPERTY
t{k}.Base{k}|t{k}.Base{k}.step|CLASS_TO_METHOD
t{k}.Runner{k}|t{k}.Runner{k}.size|CLASS_TO_PROPERTY
t{k}.Runner{k}|t{k}.Runner{k}.go|CLASS_TO_METHOD
t{k}.Vec{k}|t{k}.Vec{k}.n|CLASS_TO_PROPERTY
t{k}.Vec{k}|t{k}.Vec{k}.plus|CLASS_TO_METHOD
App{k}.Program|App{k}.Program.Size|CLASS_TO_PROPERTY
App{k}.Program|App{k}.Program.Main|CLASS_TO_METHOD
App{k}.Program|App{k}.Program.Run|CLASS_TO_METHOD
P{k}|P{k}::x|CLASS_TO_METHOD
E{k}|E{k}::One|CLASS_TO_METHOD
E{k}|E{k}::Two|CLASS_TO_METHOD
impl P{k}|P{k}::new|CLASS_TO_METHOD
impl P{k}|P{k}::len|CLASS_TO_METHOD
inner|inner::f|MODULE_TO_SINGLETON_METHOD
Store{k}|Store{k}::get|CLASS_TO_METHOD
Auth{k}|Auth{k}::User{k}|MODULE_TO_CLASS
Auth{k}|Auth{k}::Session{k}|MODULE_TO_CLASS
Auth{k}::User{k}|Auth{k}::User{k}#greet|CLASS_TO_METHOD
Auth{k}::Session{k}|Auth{k}::Session{k}::open|CLASS_TO_SINGLETON_METHOD
"""
# caller (a file's path at the top level) | callee (an import's path in brackets) | relationship
CALLS = """
Base{k}.save|helper{k}|CALLS
Item{k}.label|Base{k}.save|CALLS
helper{k}|helper{k}.inner|CALLS
run{k}|helper{k}|CALLS
run{k}|Item{k}|CALLS
run{k}|Base{k}.save|CALLS
run{k}|[json]|CALLS
py/n{n}/again{k}.py|helper{k}|CALLS
s{k}.C{k}.run|s{k}.D{k}.greet|CALLS
s{k}.C{k}.run|s{k}.C{k}.step|CALLS
t{k}.Runner{k}|t{k}.Base{k}|CALLS
t{k}.Runner{k}.go|t{k}.Base{k}.step|CALLS
t{k}.Runner{k}.go|t{k}.make{k}|CALLS
kt/K{k}.kt|t{k}.Point{k}|CALLS
t{k}.sum{k}|t{k}.Vec{k}.plus|CALLS
t{k}.sum{k}|t{k}.twice|CALLS
Store{k}::get|load{k}|CALLS
Auth{k}::Session{k}::open|Auth{k}::User{k}|CALLS
Auth{k}::Session{k}::open|Auth{k}::User{k}#greet|CALLS
"""
# importing file | name or alias | relationship | what it names
TARGETS = """
py/n{n}/use{k}.py|Item{k}|IMPORTED_SYMBOL_TO_DEFINITION|Item{k}
py/n{n}/use{k}.py|h{k}|IMPORTED_SYMBOL_TO_DEFINITION|helper{k}
py/n{n}/again{k}.py|most|IMPORTED_SYMBOL_TO_IMPORTED_SYMBOL|h{k}
py/n{n}/again{k}.py|most|IMPORTED_SYMBOL_TO_DEFINITION|helper{k}
"""


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's files as the file source would list them."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"))
    s = s.repartition(max(32, 4 * spark.sparkContext.defaultParallelism), "k")  # texts are made and parsed where their suppliers lie, and one small file is one task
    texts = F.broadcast(spark.createDataFrame(list(TEXTS.items()), "path string, text string"))  # a row a template
    fill = lambda c: F.replace(F.replace(F.col(c), L("{k}"), F.col("k")), L("{n}"), F.col("n")).alias(c)
    rows = s.join(texts).select(fill("path"), fill("text"), L("ok").alias("status"), L(None).cast("string").alias("reason"))
    return src.with_language(rows.where(src.supported(F.col("path"))))


_BUILT: dict[tuple[str, str], str] = {}


def graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The tree's graph, built and saved once for each application and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        files = source_rows(spark, sf_dir)
        path = f"{shared_dir(spark)}/tree-{abs(hash(key))}"
        save(build_graph(files.where("status = 'ok'"), extract(files.where("status = 'ok'")), "tree", "/tree"), path)
        _BUILT[key] = path
    return load(spark, _BUILT[key])


def _expected(facts: str, columns: str) -> str:
    """SQL for the facts of all suppliers."""
    names = columns.split()
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in line.split("|")) + ")" for line in facts.strip("\n").split("\n"))
    fill = lambda c: f"replace(replace({c}, '{{k}}', CAST(s_suppkey AS VARCHAR)), '{{n}}', CAST(s_nationkey AS VARCHAR))"
    shown = ", ".join(f"CAST({c} AS INTEGER) AS {c}" if c.endswith("_line") else f"{fill(c)} AS {c}" for c in names)
    return f"SELECT {shown} FROM supplier, (VALUES {rows}) AS f({', '.join(names)})"


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(name: str, sql: str):
    def add(f):
        _QUERIES[name] = (f, sql)
        return f

    return add


_FILES = "SELECT DISTINCT path FROM (" + _expected("\n".join(p for p in TEXTS if "min.js" not in p and ".md" not in p), "path") + ")"


@_query("tree_definitions", _expected(DEFINITIONS, "path definition_type fqn start_line end_line"))
def tree_definitions(spark, sf_dir):
    return graph(spark, sf_dir).scan(DEFINITION).select(F.col("primary_file_path").alias("path"), "definition_type", "fqn", "start_line", "end_line")


@_query("tree_imports", _expected(IMPORTS, "path import_type import_path name alias"))
def tree_imports(spark, sf_dir):
    return graph(spark, sf_dir).scan(IMPORT).select(F.col("file_path").alias("path"), "import_type", "import_path", "name", "alias")


@_query("tree_files", f"SELECT path, split_part(path, '/', 1) AS folder, CASE split_part(path, '/', 1) WHEN 'py' THEN 'Python' WHEN 'java' THEN 'Java' WHEN 'kt' THEN 'Kotlin' WHEN 'cs' THEN 'CSharp' WHEN 'rs' THEN 'Rust' WHEN 'ts' THEN 'TypeScript' ELSE 'Ruby' END AS language FROM ({_FILES})")
def tree_files(spark, sf_dir):
    return graph(spark, sf_dir).scan(FILE).select("path", F.substring_index("path", "/", 1).alias("folder"), "language")


@_query("tree_directories", f"WITH f AS ({_FILES}), d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path FROM f) SELECT DISTINCT path FROM (SELECT path FROM d UNION ALL SELECT split_part(path, '/', 1) FROM d)")
def tree_directories(spark, sf_dir):
    return graph(spark, sf_dir).scan(DIRECTORY).select("path")


@_query("tree_containment", f"WITH f AS ({_FILES}) SELECT regexp_replace(path, '/[^/]*$', '') AS parent, path AS child FROM f")
def tree_containment(spark, sf_dir):
    g = graph(spark, sf_dir)
    rel = next(r for r in RELS if (r.source, r.target) == (DIRECTORY, FILE))
    return g.expand(rel).select(F.col("s.path").alias("parent"), F.col("t.path").alias("child"))


@_query("tree_relations", _expected(RELATIONS, "parent child relationship"))
def tree_relations(spark, sf_dir):
    x = graph(spark, sf_dir).expand(q.DEF_DEF, ~F.col("type").isin(*q.REFERENCE_TYPES))
    return x.select(F.col("s.fqn").alias("parent"), F.col("t.fqn").alias("child"), F.col("r.type").alias("relationship"))


@_query("tree_calls", _expected(CALLS, "caller callee relationship"))
def tree_calls(spark, sf_dir):
    g = graph(spark, sf_dir)
    out = None
    for rel, caller, callee in ((q.DEF_DEF, F.col("s.fqn"), F.col("t.fqn")), (q.FILE_DEF, F.col("s.path"), F.col("t.fqn")), (q.DEF_IMP, F.col("s.fqn"), F.concat(L("["), F.col("t.import_path"), L("]")))):
        one = g.expand(rel, F.col("type").isin(*q.REFERENCE_TYPES)).select(caller.alias("caller"), callee.alias("callee"), F.col("r.type").alias("relationship"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("tree_import_targets", _expected(TARGETS, "path name relationship target"))
def tree_import_targets(spark, sf_dir):
    g = graph(spark, sf_dir)
    shown = lambda p: F.when(F.col(f"{p}.alias") != "", F.col(f"{p}.alias")).otherwise(F.col(f"{p}.name"))
    imp_imp = next(r for r in RELS if (r.source, r.target) == (IMPORT, IMPORT))
    one = lambda rel, target: g.expand(rel).select(F.col("s.file_path").alias("path"), shown("s").alias("name"), F.col("r.type").alias("relationship"), target.alias("target"))
    return one(q.IMP_DEF, F.col("t.fqn")).unionByName(one(imp_imp, shown("t")))


@_query("tree_file_definitions", "SELECT fqn FROM (" + _expected(DEFINITIONS, "path definition_type fqn start_line end_line") + ") WHERE path = (SELECT 'py/n' || s_nationkey || '/m' || s_suppkey || '.py' FROM supplier ORDER BY s_suppkey LIMIT 1) AND NOT contains(fqn, '.')")
def tree_file_definitions(spark, sf_dir):
    return q.file_definitions(graph(spark, sf_dir), _first(spark, sf_dir, "py/n{n}/m{k}.py")).select("fqn")


@_query("tree_file_imports", "SELECT name, import_path, alias, CAST(CASE WHEN name = 'json' THEN 1 ELSE 0 END AS INTEGER) AS line_number FROM (" + _expected(IMPORTS, "path import_type import_path name alias") + ") WHERE path = (SELECT 'py/n' || s_nationkey || '/use' || s_suppkey || '.py' FROM supplier ORDER BY s_suppkey LIMIT 1)")
def tree_file_imports(spark, sf_dir):
    return q.file_imports(graph(spark, sf_dir), _first(spark, sf_dir, "py/n{n}/use{k}.py"))


@_query("tree_get_definition", "SELECT 'helper' || min(s_suppkey) AS fqn, 'DefinitionNode' AS node_type, 'CALLS' AS relationship_type, 'definition' AS found_by FROM supplier")
def tree_get_definition(spark, sf_dir):
    """What the call on the fifth line of the first ``use`` file refers to."""
    found = q.get_definition(graph(spark, sf_dir), _first(spark, sf_dir, "py/n{n}/use{k}.py"), 4, 4, 5)
    return q.best_definition(found).select("fqn", "node_type", "relationship_type", "found_by")


@_query("tree_language_counts", "SELECT language, count(*) FILTER (WHERE kind = 'f') AS files, count(*) FILTER (WHERE kind = 'd') AS definitions FROM (SELECT split_part(path, '/', 1) AS language, 'f' AS kind FROM (" + _FILES + ") UNION ALL SELECT split_part(path, '/', 1), 'd' FROM (" + _expected(DEFINITIONS, "path definition_type fqn start_line end_line") + ")) GROUP BY 1")
def tree_language_counts(spark, sf_dir):
    from .operators.aggregates import language_breakdown

    folder = F.create_map(*[L(x) for kv in (("Python", "py"), ("Java", "java"), ("Kotlin", "kt"), ("CSharp", "cs"), ("Rust", "rs"), ("TypeScript", "ts"), ("Ruby", "rb")) for x in kv])
    return language_breakdown(graph(spark, sf_dir)).select(folder[F.col("language")].alias("language"), "files", "definitions")


@_query("tree_parents", "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS parent FROM (" + _FILES + ")")
def tree_parents(spark, sf_dir):
    return source_rows(spark, sf_dir).where("status = 'ok'").select(parent_path(F.col("path")).alias("parent")).distinct()


def _first(spark: SparkSession, sf_dir: str, template: str) -> str:
    r = spark.read.parquet(f"{sf_dir}/supplier.parquet").orderBy("s_suppkey").select("s_suppkey", "s_nationkey").first()
    return template.replace("{k}", str(r[0])).replace("{n}", str(r[1])) if r else ""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
