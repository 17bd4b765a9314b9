"""From extracted rows to a property graph.

Names are resolved by joins on (project-wide) names with a precedence of candidates: the caller's own
scope, its file, its imports, its package, then its type's ancestors. Candidates are kept in one table with
a rank, and the least rank of each reference wins; equal ranks are ambiguous.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import camel, parent_path
from ..graph import PropertyGraph
from ..operators.closure import cut, closure
from ..operators.joins import first_by
from ..schema import DEFINITION, DIR_REL, DIRECTORY, EDGE, FILE, IMP_REL, IMPORT, NODES, Rel, conform
from ..sources import files as src
from .rules import framework_call, hidden, ruled, simple_type

DIR_DIR, DIR_FILE = Rel(DIR_REL, DIRECTORY, DIRECTORY), Rel(DIR_REL, DIRECTORY, FILE)


def _id(*columns) -> "F.Column":
    """A stable id from a natural key (62 bits of a hash)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def _edge(df: DataFrame, source: str, target: str, type_, range_: bool = False) -> DataFrame:
    where = {"source_start_byte": "start_byte", "source_end_byte": "end_byte", "source_start_line": "start_line", "source_end_line": "end_line", "source_start_col": "start_col", "source_end_col": "end_col", "call_line": "start_line"}
    place = [(F.col(c) if range_ else F.lit(None)).cast(EDGE[n].dataType).alias(n) for n, c in where.items()]
    key = F.concat_ws(":", F.col(source), F.col(target), type_, F.col("start_byte") if range_ else F.lit(""))
    return df.select(F.col(source).alias("source_id"), F.col(target).alias("target_id"), type_.alias("type"), *place, key.alias("edge_id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def package_roots(files: DataFrame) -> DataFrame:
    """(root): where absolute imports start: the folder with the shortest path, and the folders that hold packages."""
    dirs = files.select(parent_path(F.col("path")).alias("d"))
    shortest = dirs.agg(F.min_by("d", F.struct(F.length("d"), F.col("d"))).alias("root"))
    packages = files.where(F.lower("path").rlike(r"(^|/)__init__\.py$")).select(parent_path(F.col("path")).alias("d"))
    return shortest.where("root IS NOT NULL").unionByName(packages.where("d <> ''").select(parent_path(F.col("d")).alias("root"))).distinct()


def python_modules(files: DataFrame) -> DataFrame:
    """(module, target_file, root): the dotted names, lower-cased, of Python files below each folder they lie in."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", "")
    parts = F.split(stem, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("root"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("module")))
    return files.where("language = 'Python'").select(F.col("path").alias("target_file"), F.explode(tails).alias("t")).select(F.lower("t.module").alias("module"), "target_file", "t.root")


def python_import_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, target_file, rank): the files an import may mean, nearest first.

    Relative dots climb from the importing file's folder; other names are looked for beside the importing file, then
    below the package roots; ``from package import module`` may mean the module. Case doesn't count.
    """
    own = imports.where("language = 'Python' AND type <> 'FutureImport'")
    dots = F.length(F.regexp_extract("import_path", r"^(\.*)", 1))
    folder = F.split("file_path", "/")
    up = F.array_join(F.slice(folder, 1, F.greatest(F.size(folder) - F.greatest(dots, F.lit(1)), F.lit(0))), "/")
    name = F.lower(F.regexp_replace("import_path", r"^\.+", ""))
    sub = F.concat_ws(".", F.when(name != "", name), F.lower("name"))
    asked = own.select("id", (dots > 0).alias("relative"), up.alias("here"), F.explode(F.array(F.struct(F.lit(0).alias("rank"), name.alias("module")), F.struct(F.lit(2).alias("rank"), sub.alias("module")))).alias("c"))
    asked = asked.select("id", "relative", "here", "c.*").where("module <> ''")
    modules = python_modules(files)
    beside = asked.join(modules, "module").where(F.col("root") == F.col("here")).select("id", "target_file", "rank")
    below = asked.where("NOT relative").join(modules.join(package_roots(files), "root"), "module").select("id", "target_file", (F.col("rank") + 1).alias("rank"))
    # a package's own names: from . import name
    package = own.where((dots > 0) & (name == "")).select("id", F.concat_ws("/", F.when(up != "", up), F.lit("__init__.py")).alias("target_file"), F.lit(0).alias("rank"))
    package = package.join(files.select(F.col("path").alias("target_file")), "target_file", "left_semi").select("id", "target_file", "rank")
    return _union([beside, below, package]).groupBy("id", "target_file").agg(F.min("rank").alias("rank"))


def build_graph(files: DataFrame, rows: DataFrame, repository: str = "", root: str = "") -> PropertyGraph:
    """The graph of ``files`` (path, language, extension, ...) and the rows that ``extract`` made of them."""
    spark: SparkSession = files.sparkSession
    files = cut(files.select("path", "language", "extension"))
    fnodes = src.file_nodes(files, repository, root).withColumn("id", _id(F.lit("f"), F.col("path")))
    dnodes = src.directory_nodes(files, repository, root).withColumn("id", _id(F.lit("d"), F.col("path")))
    inside, held = src.containment(files)
    dir_dir = inside.select(_id(F.lit("d"), F.col("parent")).alias("s"), _id(F.lit("d"), F.col("child")).alias("t"))
    dir_file = held.select(_id(F.lit("d"), F.col("dir")).alias("s"), _id(F.lit("f"), F.col("path")).alias("t"))

    ok = cut(rows.where("status = 'ok' AND kind <> 'file'"))  # once, since definitions, imports and references all read it
    defs = ok.where("kind = 'definition'").withColumn("simple", simple_type(F.col("language"), F.col("type")))
    last = F.col("language").isin("TypeScript", "Java", "Kotlin")  # of definitions with one fqn the last stands there, the first elsewhere
    defs = first_by(defs, ["file_path", "fqn"], [F.when(last, -F.col("ordinal")).otherwise(F.col("ordinal"))]).withColumn("id", _id(F.lit("m"), F.col("file_path"), F.col("fqn")))
    defs = cut(defs)
    shown = defs.where(~hidden(F.col("language"), F.col("type")))
    nodes_d = shown.select("id", "fqn", "name", F.col("type").alias("definition_type"), F.col("file_path").alias("primary_file_path"), F.col("start_byte").alias("primary_start_byte"), F.col("end_byte").alias("primary_end_byte"), "start_line", "end_line", "start_col", "end_col", F.lit(1).alias("total_locations"))
    imps = ok.where("kind = 'import'").withColumn("id", _id(F.lit("i"), F.col("file_path"), F.col("start_byte"), F.col("name"), F.col("alias"), F.col("import_path")))
    imps = cut(imps.dropDuplicates(["id"]))
    nodes_i = imps.select("id", F.col("type").alias("import_type"), "import_path", "name", "alias", "file_path", "start_byte", "end_byte", "start_line", "end_line", "start_col", "end_col")

    of_file = _id(F.lit("f"), F.col("file_path"))
    packages = defs.where("type = 'Package'").select("file_path", F.col("fqn").alias("package")).dropDuplicates(["file_path"])
    top = shown.join(packages, "file_path", "left").where(F.col("language").isin("Ruby", "Rust") | (F.col("scope") == "") | (F.col("scope") == F.col("package")))
    file_def = _edge(top.withColumn("f", of_file), "f", "id", F.lit("FILE_DEFINES"))
    file_imp = _edge(imps.withColumn("f", of_file), "f", "id", F.lit("FILE_IMPORTS"))
    owner = defs.select("file_path", F.col("fqn").alias("scope"), F.col("id").alias("owner"), F.col("simple").alias("parent_type"))
    nested = shown.withColumn("child_type", F.col("simple")).join(owner, ["file_path", "scope"])
    def_def = _edge(ruled(nested), "owner", "id", F.col("rel_type"))
    scoped = imps.where("scope <> ''").join(owner, ["file_path", "scope"])
    def_imp = _edge(scoped, "owner", "id", F.lit("DEFINES_IMPORTED_SYMBOL"))

    # imports to what they name
    links = cut(import_links(imps, defs, files))
    to_def = links.where("target_kind = 'definition'")
    imp_def = _edge(to_def.withColumnRenamed("id", "i"), "i", "target", F.lit("IMPORTED_SYMBOL_TO_DEFINITION"))
    imp_imp = _edge(links.where("target_kind = 'import'").withColumnRenamed("id", "i"), "i", "target", F.lit("IMPORTED_SYMBOL_TO_IMPORTED_SYMBOL"))
    imp_file = _edge(links.where("target_kind = 'file'").withColumnRenamed("id", "i"), "i", "target", F.lit("IMPORTED_SYMBOL_TO_FILE"))

    calls, external = resolve_calls(ok.where("kind = 'reference'"), defs, imps, links, packages)
    caller = defs.select("file_path", F.col("fqn").alias("scope"), F.col("id").alias("caller"))
    made = calls.join(caller, ["file_path", "scope"], "left").withColumn("f", of_file)
    kind = F.when(F.col("n") > 1, "AMBIGUOUSLY_CALLS").otherwise("CALLS")
    def_def = def_def.unionByName(_edge(made.where("caller IS NOT NULL"), "caller", "target", kind, True))
    file_def = file_def.unionByName(_edge(made.where("caller IS NULL"), "f", "target", kind, True))
    outside = external.join(caller, ["file_path", "scope"], "left").withColumn("f", of_file)
    def_imp = def_imp.unionByName(_edge(outside.where("caller IS NOT NULL"), "caller", "target", F.lit("CALLS"), True))
    file_imp = file_imp.unionByName(_edge(outside.where("caller IS NULL"), "f", "target", F.lit("CALLS"), True))

    nodes = {DIRECTORY: dnodes, FILE: fnodes, DEFINITION: nodes_d, IMPORT: nodes_i}
    from ..plans.library import DEF_DEF, DEF_IMP, FILE_DEF, FILE_IMP, IMP_DEF

    edges = {
        DIR_DIR: _edge(dir_dir, "s", "t", F.lit("DIR_CONTAINS_DIR")), DIR_FILE: _edge(dir_file, "s", "t", F.lit("DIR_CONTAINS_FILE")), FILE_DEF: file_def, FILE_IMP: file_imp,
        DEF_DEF: def_def, DEF_IMP: def_imp, Rel(IMP_REL, IMPORT, IMPORT): imp_imp, IMP_DEF: imp_def, Rel(IMP_REL, IMPORT, FILE): imp_file,
    }
    return PropertyGraph(spark, {n: conform(d, NODES[n]) for n, d in nodes.items()}, edges)


def import_links(imps: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, target_kind, target, fqn): what an import names, following re-exports to their end."""
    where = cut(python_import_files(imps, files))
    py = imps.where("language = 'Python'").join(where, "id")
    whole = F.col("type").isin("Import", "AliasedImport", "WildcardImport")
    # an import of a whole module is its first candidate file; a name is matched in all of them, and may be a module itself
    one = first_by(py.where(whole & (F.col("rank") < 2)), ["id"], [F.col("rank"), F.col("target_file")])
    named = py.where(~whole & (F.col("rank") < 2)).select("id", "name", "target_file")
    d = defs.where("scope = ''").select(F.col("file_path").alias("target_file"), "name", F.col("id").alias("target"), "fqn", "start_byte", F.lit("definition").alias("target_kind"))
    i = imps.where("scope = ''").select(F.col("file_path").alias("target_file"), F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("name")).alias("name"), F.col("id").alias("target"), F.lit("").alias("fqn"), "start_byte", F.lit("import").alias("target_kind"))
    hit = first_by(named.join(d.unionByName(i), ["name", "target_file"]), ["id", "target_file"], [F.col("start_byte").desc(), F.col("target_kind")])
    direct = hit.select("id", "target_kind", "target", "fqn", "target_file")
    module = first_by(py.where(~whole & (F.col("rank") >= 2)).join(direct.select("id").distinct(), "id", "left_anti"), ["id"], [F.col("rank"), F.col("target_file")])
    to_file = one.unionByName(module).select("id", F.lit("file").alias("target_kind"), _id(F.lit("f"), F.col("target_file")).alias("target"), F.lit("").alias("fqn"), "target_file")
    # chains of re-exports end at a definition or a file
    chain = direct.where("target_kind = 'import'").select(F.col("id").alias("src"), F.col("target").alias("dst"))
    ends = direct.where("target_kind = 'definition'").unionByName(to_file)
    far = closure(chain).join(ends.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "target_kind", "target", "fqn", "target_file")
    # JVM languages, by full name
    named = imps.where(F.col("language").isin("Java", "Kotlin") & (F.col("name") != "*")).select("id", F.concat_ws(".", "import_path", "name").alias("fqn"))
    jvm = named.join(defs.where(F.col("language").isin("Java", "Kotlin") & (F.col("type") != "Package")).select("fqn", F.col("id").alias("target"), F.col("file_path").alias("target_file")), "fqn")
    jvm = jvm.select("id", F.lit("definition").alias("target_kind"), "target", "fqn", "target_file")
    return _union([direct, far, to_file, jvm]).dropDuplicates(["id", "target_kind", "target"])


def _ancestors(defs: DataFrame) -> DataFrame:
    """(src, dst, depth) over type names: superclasses, interfaces and mixins."""
    bases = F.filter(F.split(F.concat_ws(",", "mixins", "bases"), ","), lambda b: b != "")
    return closure(defs.select(F.col("name").alias("src"), F.explode(bases).alias("b")).select("src", F.element_at(F.split("b", r"\.|::"), -1).alias("dst")))


def resolve_calls(refs: DataFrame, defs: DataFrame, imps: DataFrame, links: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((reference, target, n), (reference, import)): calls of known definitions, and of imports that stay unresolved."""
    refs = cut(refs.where(~framework_call(F.col("language"), F.col("name"), F.col("type_hint")))).withColumn("ref", F.xxhash64("file_path", "ordinal", "start_byte"))
    callable_ = defs.where(~F.col("type").isin("Package", "Namespace"))
    d = callable_.select(F.col("language"), F.col("name"), F.col("file_path").alias("d_file"), F.col("scope").alias("d_scope"), F.col("fqn").alias("d_fqn"), F.col("id").alias("target"), F.col("simple"))
    keep = ["ref", "target"]
    plain = refs.where("receiver = ''")
    # 1. the same file: the innermost enclosing scope that defines the name (Python classes are no scope of their methods' calls)
    parts = F.when(F.col("scope") == "", F.array().cast("array<string>")).otherwise(F.split("scope", r"::|#|\."))
    scopes = plain.select("ref", "language", "name", "file_path", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("k"), F.col("scope"), parts.alias("p"))
    near = scopes.select("ref", "language", "name", F.col("file_path").alias("d_file"), "k", F.array_join(F.slice("p", 1, F.col("k")), ".").alias("dotted"))
    in_file = near.join(d.withColumn("dotted", F.regexp_replace("d_scope", r"::|#", ".")), ["language", "name", "d_file", "dotted"])
    in_file = in_file.where(~((F.col("language") == "Python") & (F.col("simple") == "Method")))
    found = [in_file.select(*keep, F.lit(0).alias("rank"), (-F.col("k")).alias("far"))]
    # 2. through an import of the name
    used = imps.select("file_path", F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("name")).alias("name"), F.col("id").alias("imp"))
    by_import = plain.join(used, ["file_path", "name"]).join(links.where("target_kind = 'definition'").select(F.col("id").alias("imp"), "target"), "imp")
    found.append(by_import.select(*keep, F.lit(1).alias("rank"), F.lit(0).alias("far")))
    # ... and by wildcard: all top-level names of the file
    star = imps.where("type = 'WildcardImport' AND language = 'Python'").select("file_path", F.col("id").alias("imp")).join(links.where("target_kind = 'file'").select(F.col("id").alias("imp"), F.col("target_file").alias("d_file")), "imp")
    found.append(plain.join(star, "file_path").join(d.where("d_scope = ''").drop("language"), ["name", "d_file"]).select(*keep, F.lit(2).alias("rank"), F.lit(0).alias("far")))
    # 3. the same package (JVM languages)
    own = plain.where(F.col("language").isin("Java", "Kotlin")).join(packages, "file_path")
    found.append(own.join(d.withColumnRenamed("d_scope", "package"), ["language", "name", "package"]).select(*keep, F.lit(3).alias("rank"), F.lit(0).alias("far")))
    # 4. module.function through an import of the module
    mod = refs.where("language = 'Python' AND receiver <> ''").join(used.withColumnRenamed("name", "receiver"), ["file_path", "receiver"]).join(links.where("target_kind = 'file'").select(F.col("id").alias("imp"), F.col("target_file").alias("d_file")), "imp")
    found.append(mod.join(d.where("d_scope = ''"), ["language", "name", "d_file"]).select(*keep, F.lit(1).alias("rank"), F.lit(0).alias("far")))
    # 5. members of the receiver's type: its own, then its ancestors'
    types = callable_.where(F.col("simple").isin("Class", "Interface", "Module", "Struct", "Enum")).select("language", F.col("name").alias("type_name"), F.col("fqn").alias("type_fqn"), F.col("file_path").alias("type_file"))
    inside = F.element_at(F.split(F.regexp_replace("scope", r"[.#][^.#]*$", ""), r"::|\."), -1)
    hint = (
        F.when(F.col("type_hint") != "", F.element_at(F.split("type_hint", r"::|\."), -1))
        .when(F.col("receiver").isin("self", "this", "super", "cls", "super()") | (F.col("receiver") == "") & F.col("language").isin("Ruby", "Java", "Kotlin"), inside)
        .when((F.col("language") == "Ruby") & F.startswith("receiver", F.lit("@")), camel(F.col("receiver")))
        .when(F.col("receiver").rlike(r"^[A-Z][\w.:]*$"), F.element_at(F.split("receiver", r"::|\."), -1))
    )
    typed = refs.withColumn("own_type", hint).where("own_type IS NOT NULL AND own_type <> ''")
    alias = imps.where("alias <> ''").groupBy("file_path", F.col("alias").alias("own_type")).agg(F.max("name").alias("real"))  # a type known by another name here
    typed = typed.join(alias, ["file_path", "own_type"], "left").withColumn("own_type", F.coalesce("real", "own_type")).drop("real")
    self_ = typed.select(F.col("own_type").alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("depth"))
    up = self_.unionByName(_ancestors(callable_))
    members = d.where(F.col("simple").isin("Method", "Function", "SingletonMethod", "InstanceMethod", "StaticMethod")).select("language", "name", "target", "d_file", F.element_at(F.split("d_scope", r"::|\."), -1).alias("dst"))
    member = typed.join(up, F.col("own_type") == F.col("src")).where((F.col("receiver") != "super()") & (F.col("receiver") != "super") | (F.col("depth") > 0)).join(members, ["language", "name", "dst"])
    found.append(member.select(*keep, F.lit(2).alias("rank"), F.col("depth").alias("far")))
    # 6. constructors: a call of the type itself
    made = refs.where("type = 'New' OR (language = 'Ruby' AND name = 'new')").withColumn("type_name", F.when(F.col("language") == "Ruby", F.element_at(F.split("receiver", "::"), -1)).otherwise(F.col("name")))
    ctor = made.join(callable_.where("type IN ('Constructor')").select("language", F.col("name").alias("type_name"), F.col("id").alias("target")), ["language", "type_name"])
    found.append(ctor.select(*keep, F.lit(0).alias("rank"), F.lit(-1000).alias("far")))
    whole = made.join(types, ["language", "type_name"]).join(callable_.select("language", F.col("fqn").alias("type_fqn"), F.col("file_path").alias("type_file"), F.col("id").alias("target")), ["language", "type_fqn", "type_file"])
    found.append(whole.select(*keep, F.lit(1).alias("rank"), F.lit(1).alias("far")))
    # 7. Kotlin extensions: functions of the receiver's type, in the same package or imported
    ext = callable_.where("language = 'Kotlin' AND receiver <> ''").select("language", "name", F.col("receiver").alias("type_hint"), F.col("id").alias("target"), F.col("scope").alias("package"))
    asks = refs.where("language = 'Kotlin' AND receiver <> '' AND type_hint <> ''").join(ext, ["language", "name", "type_hint"]).drop("scope")
    found.append(asks.join(packages, ["file_path", "package"]).select(*keep, F.lit(4).alias("rank"), F.lit(0).alias("far")))
    found.append(asks.join(used, ["file_path", "name"], "left_semi").select(*keep, F.lit(3).alias("rank"), F.lit(0).alias("far")))
    w = Window.partitionBy("ref").orderBy("rank", "far")
    best = _union(found).distinct().withColumn("r", F.rank().over(w)).where("r = 1").select("ref", "target").distinct()
    best = cut(best.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ref"))))
    place = refs.select("ref", "file_path", "scope", "start_byte", "end_byte", "start_line", "end_line", "start_col", "end_col")
    open_ = refs.join(best.select("ref").distinct(), "ref", "left_anti")
    head = F.when(F.col("receiver") == "", F.col("name")).otherwise(F.element_at(F.split("receiver", r"\.|::"), 1))
    external = open_.withColumn("name", head).join(used, ["file_path", "name"]).select("ref", F.col("imp").alias("target")).dropDuplicates(["ref"])
    return best.join(place, "ref"), external.join(place, "ref")
