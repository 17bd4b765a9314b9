"""The graph operators over the driver's tables: a property graph of views, the queries, and their SQL.

Regions and nations are directories, customers are files, orders and parts are definitions, suppliers are
imports, and line items are references from orders to parts and suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from . import incremental as inc
from . import tree_demo
from .graph import PropertyGraph
from .operators import aggregates as agg
from .operators import closure as clo
from .operators import joins, text
from .plans import library as q
from .sources import files
from .schema import DEFINITION, DIR_REL, DIRECTORY, FILE, IMPORT, NODES, RELS, Rel, conform
from .streaming import sessions

PART = 10_000_000_000
DIR_DIR, DIR_FILE = Rel(DIR_REL, DIRECTORY, DIRECTORY), Rel(DIR_REL, DIRECTORY, FILE)
L = F.lit

GRAPH_SQL = f"""
dirs AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS path, r_name AS name FROM region
  UNION ALL SELECT 1000 + n_nationkey, r_name || '/' || n_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
), files AS (
  SELECT c_custkey AS id, d.path || '/' || c_name AS path, c_mktsegment AS language, c_name AS name FROM customer JOIN dirs d ON d.id = 1000 + c_nationkey
), orderdefs AS (
  SELECT o_orderkey AS id, f.name || '#' || o_orderkey AS fqn, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS definition_type, f.path AS primary_file_path,
         CAST(day(o_orderdate) AS INTEGER) AS start_line, CAST(day(o_orderdate) + 5 AS INTEGER) AS end_line
  FROM orders JOIN files f ON f.id = o_custkey
), partdefs AS (
  SELECT {PART} + p_partkey AS id, p_brand || '::' || p_name AS fqn, p_name AS name, p_type AS definition_type, 'lib/' || p_brand AS primary_file_path,
         CAST(p_size AS INTEGER) AS start_line, CAST(p_size + 3 AS INTEGER) AS end_line FROM part
), defs AS (SELECT * FROM orderdefs UNION ALL SELECT * FROM partdefs),
imps AS (
  SELECT s_suppkey AS id, s_name AS import_path, s_name AS name, '' AS alias, 'supply/' || n_name AS file_path, CAST(s_suppkey % 40 AS INTEGER) AS start_line
  FROM supplier JOIN nation ON n_nationkey = s_nationkey
), refs AS (
  SELECT l_orderkey AS source_id, {PART} + l_partkey AS target_id, l_suppkey AS import_id, CAST(l_linenumber AS INTEGER) AS line,
         CASE l_returnflag WHEN 'N' THEN 'CALLS' WHEN 'A' THEN 'AMBIGUOUSLY_CALLS' ELSE 'PROPERTY_REFERENCE' END AS type
  FROM lineitem
)"""


class Demo:
    """The tables of one folder and the graph over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.graph = self._graph()

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _graph(self) -> PropertyGraph:
        region, nation, customer, supplier, part, orders, lines = (self.t(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"))
        nd = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        top = region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("path"), F.col("r_name").alias("name"))
        low = nd.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.concat("r_name", L("/"), "n_name").alias("path"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent"))
        at = low.select(F.col("id").alias("d_id"), F.col("path").alias("d_path"))
        files = customer.join(at, F.col("d_id") == F.col("c_nationkey") + 1000).select(F.col("c_custkey").alias("id"), F.concat("d_path", L("/"), "c_name").alias("path"), F.col("c_mktsegment").alias("language"), F.col("c_name").alias("name"), "d_id")
        of = files.select(F.col("id").alias("f_id"), F.col("path").alias("f_path"), F.col("name").alias("f_name"))
        day = F.dayofmonth("o_orderdate")
        od = orders.join(of, F.col("f_id") == F.col("o_custkey")).select(
            F.col("o_orderkey").alias("id"), F.concat("f_name", L("#"), F.col("o_orderkey").cast("string")).alias("fqn"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("definition_type"),
            F.col("f_path").alias("primary_file_path"), day.alias("start_line"), (day + 5).alias("end_line"), L(1).alias("total_locations"), "f_id",
        )
        pd = part.select(
            (F.col("p_partkey") + PART).alias("id"), F.concat("p_brand", L("::"), "p_name").alias("fqn"), F.col("p_name").alias("name"), F.col("p_type").alias("definition_type"), F.concat(L("lib/"), "p_brand").alias("primary_file_path"),
            F.col("p_size").alias("start_line"), (F.col("p_size") + 3).alias("end_line"), L(1).alias("total_locations"),
        )
        imps = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("id"), L("ImportFrom").alias("import_type"), F.col("s_name").alias("import_path"), F.col("s_name").alias("name"), F.concat(L("supply/"), "n_name").alias("file_path"), (F.col("s_suppkey") % 40).cast("int").alias("start_line")
        )
        kind = F.when(F.col("l_returnflag") == "N", "CALLS").when(F.col("l_returnflag") == "A", "AMBIGUOUSLY_CALLS").otherwise("PROPERTY_REFERENCE")
        ref = lines.select(
            F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") + PART).alias("target_id"), F.col("l_suppkey"), kind.alias("type"), F.col("l_linenumber").alias("source_start_line"), F.col("l_linenumber").alias("call_line"),
            F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("edge_id"),
        )
        edge = lambda d, s, t, kind: d.select(F.col(s).cast("long").alias("source_id"), F.col(t).cast("long").alias("target_id"), L(kind).alias("type"), F.concat_ws(":", L(kind), s, t).alias("edge_id"))
        wide = lambda d: d.select(*[c for c in (*ref.columns,) if c in d.columns], *[L(None).cast(k).alias(c) for c, k in (("source_start_byte", "long"), ("source_end_byte", "long"), ("source_start_line", "int"), ("source_end_line", "int"), ("source_start_col", "int"), ("source_end_col", "int"), ("call_line", "int")) if c not in d.columns])
        nodes = {DIRECTORY: top.unionByName(low.drop("parent")), FILE: files.drop("d_id"), DEFINITION: od.drop("f_id").unionByName(pd), IMPORT: imps}
        edges = {
            DIR_DIR: wide(edge(low, "parent", "id", "DIR_CONTAINS_DIR")), DIR_FILE: wide(edge(files, "d_id", "id", "DIR_CONTAINS_FILE")), q.FILE_DEF: wide(edge(od, "f_id", "id", "FILE_DEFINES")),
            q.DEF_DEF: wide(ref.drop("l_suppkey")), q.DEF_IMP: wide(ref.where(F.col("type") == "CALLS").withColumn("target_id", F.col("l_suppkey")).drop("l_suppkey")),
        }
        return PropertyGraph(self.spark, {n: conform(d, NODES[n]) for n, d in nodes.items()}, edges)


_QUERIES: dict[str, tuple[Callable[[Demo], DataFrame], str | None]] = {}


def _query(name: str, sql: str | None, graph: bool = True):
    """Register a query with its SQL; ``graph`` puts the graph's views before it."""

    def add(f: Callable[[Demo], DataFrame]):
        _QUERIES[name] = (f, None if sql is None else f"WITH {'RECURSIVE ' if 'RECURSION' in sql else ''}{GRAPH_SQL}{sql.replace('RECURSION', '')}" if graph else sql)
        return f

    return add


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count(L(1)).alias("n"))


# -- flagship -------------------------------------------------------------------------------------


@_query("references_by_directory", """
SELECT split_part(s.primary_file_path, '/', 1) AS directory, split_part(t.fqn, '::', 1) AS brand, count(*) AS calls, count(DISTINCT (source_id, target_id)) AS pairs
FROM refs JOIN orderdefs s ON s.id = source_id JOIN partdefs t ON t.id = target_id WHERE type IN ('AMBIGUOUSLY_CALLS', 'PROPERTY_REFERENCE') GROUP BY 1, 2""")
def references_by_directory(d: Demo) -> DataFrame:
    x = d.graph.expand(q.DEF_DEF, F.col("type").isin("AMBIGUOUSLY_CALLS", "PROPERTY_REFERENCE"))
    x = x.select(F.substring_index("s.primary_file_path", "/", 1).alias("directory"), F.substring_index("t.fqn", "::", 1).alias("brand"), "r.source_id", "r.target_id")
    # two levels: pairs are pre-aggregated, so the distinct count shuffles each pair once
    pairs = x.groupBy("directory", "brand", "source_id", "target_id").agg(F.count(L(1)).alias("n"))
    return pairs.groupBy("directory", "brand").agg(F.sum("n").alias("calls"), F.count(L(1)).alias("pairs"))


# -- scans and filters ----------------------------------------------------------------------------


@_query("label_scan", ", x AS (SELECT id, path, name FROM dirs) SELECT * FROM x")
def label_scan(d):
    return d.graph.scan(DIRECTORY).select("id", "path", "name")


@_query("get_by_in", " SELECT id, path, language FROM files WHERE language IN ('BUILDING', 'MACHINERY')")
def get_by_in(d):
    return d.graph.get_by(FILE, "language", ["BUILDING", "MACHINERY"]).select("id", "path", "language")


@_query("get_by_empty", " SELECT id, path FROM files WHERE false")
def get_by_empty(d):
    return d.graph.get_by(FILE, "path", []).select("id", "path")


@_query("equality_conj", " SELECT id, fqn FROM defs WHERE definition_type = '1-URGENT' AND start_line = 7")
def equality_conj(d):
    return d.graph.scan(DEFINITION).where((F.col("definition_type") == "1-URGENT") & (F.col("start_line") == 7)).select("id", "fqn")


@_query("or_filter", " SELECT id, path FROM dirs WHERE path LIKE 'A%' OR name LIKE '%A'")
def or_filter(d):
    return d.graph.scan(DIRECTORY).where(F.startswith("path", L("A")) | F.endswith("name", L("A"))).select("id", "path")


@_query("ci_contains", " SELECT id, name FROM partdefs WHERE contains(lower(name), lower('RED'))")
def ci_contains(d):
    return d.graph.scan(DEFINITION).where((F.col("id") >= PART) & fn.contains_ci(F.col("name"), "RED")).select("id", "name")


@_query("any_term_search", " SELECT id, fqn FROM defs WHERE contains(lower(fqn), 'brand#1') OR contains(lower(fqn), '77')")
def any_term_search(d):
    return d.graph.scan(DEFINITION).where(fn.any_term(F.col("fqn"), ["Brand#1", "77"])).select("id", "fqn")


@_query("range_containment", " SELECT id, start_line, end_line FROM defs WHERE start_line <= 10 AND end_line >= 12")
def range_containment(d):
    return d.graph.scan(DEFINITION).where((F.col("start_line") <= 10) & (F.col("end_line") >= 12)).select("id", "start_line", "end_line")


@_query("extension_filter", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'Python' WHEN source = 'src2' THEN 'TypeScript' ELSE 'Kotlin' END AS language FROM documents WHERE source IN ('src1', 'src2', 'src4')", graph=False)
def extension_filter(d):
    ext = F.when(F.col("source") == "src1", "py").when(F.col("source") == "src2", "tsx").when(F.col("source") == "src3", "min.js").when(F.col("source") == "src4", "kts").otherwise("md")
    rows = d.t("documents").select("doc_id", F.concat_ws(".", "doc_id", ext).alias("path"), L("ok").alias("status"), L(None).cast("string").alias("reason"))
    return files.with_language(rows.where(files.supported(F.col("path")))).where("status = 'ok'").select("doc_id", "language")


@_query("null_safe_default", "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS kind FROM events", graph=False)
def null_safe_default(d):
    return d.t("events").select("event_id", F.coalesce(F.nullif(F.col("event_type"), L("click")), L("none")).alias("kind"))


# -- expansion ------------------------------------------------------------------------------------


@_query("expand_directed", " SELECT d.path AS dir, f.language, count(*) AS n FROM dirs d JOIN files f ON f.path = d.path || '/' || f.name GROUP BY 1, 2")
def expand_directed(d):
    return _count(d.graph.expand(DIR_FILE).select(F.col("s.path").alias("dir"), F.col("t.language").alias("language")), "dir", "language")


@_query("expand_reverse", " SELECT t.fqn, count(*) AS n, count(DISTINCT s.id) AS callers FROM refs JOIN partdefs t ON t.id = target_id JOIN orderdefs s ON s.id = source_id WHERE type = 'CALLS' GROUP BY 1")
def expand_reverse(d):
    x = d.graph.expand_back(q.DEF_DEF, F.col("type") == "CALLS").select(F.col("s.fqn").alias("fqn"), F.col("t.id").alias("c"))
    return x.groupBy("fqn").agg(F.count(L(1)).alias("n"), F.count_distinct("c").alias("callers"))


@_query("expand_undirected_same_label", " , p AS (SELECT c.id AS a, p.id AS b FROM dirs c JOIN dirs p ON c.path = p.path || '/' || c.name) SELECT a AS source_id, b AS target_id FROM p UNION ALL SELECT b, a FROM p")
def expand_undirected_same_label(d):
    return d.graph.undirected(DIR_DIR).select("source_id", "target_id")


@_query("expand_undirected_cross_label", " , p AS (SELECT d.id AS a, f.id AS b FROM dirs d JOIN files f ON f.path = d.path || '/' || f.name) SELECT a AS source_id, b AS target_id, true AS forward FROM p UNION ALL SELECT b, a, false FROM p")
def expand_undirected_cross_label(d):
    return d.graph.undirected(DIR_FILE).select("source_id", "target_id", "forward")


@_query("expand_any_rel", " , e AS (SELECT source_id, target_id FROM refs) , u AS (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e) SELECT id, count(*) AS degree FROM u GROUP BY 1")
def expand_any_rel(d):
    return d.graph.undirected(q.DEF_DEF).groupBy(F.col("source_id").alias("id")).agg(F.count(L(1)).alias("degree"))


@_query("optional_match", " SELECT i.id, count(r.source_id) AS uses FROM imps i LEFT JOIN refs r ON r.import_id = i.id AND r.type = 'CALLS' AND r.line > 6 GROUP BY 1")
def optional_match(d):
    x = d.graph.optional(q.DEF_IMP, "target", (F.col("type") == "CALLS") & (F.col("source_start_line") > 6))
    return x.groupBy(F.col("n.id").alias("id")).agg(F.count("r.source_id").alias("uses"))


@_query("two_hop_callers", " SELECT f.path, t.definition_type, count(*) AS n FROM files f JOIN orderdefs s ON s.primary_file_path = f.path JOIN refs ON source_id = s.id JOIN partdefs t ON t.id = target_id WHERE t.start_line = 1 GROUP BY 1, 2")
def two_hop_callers(d):
    x = d.graph.expand(q.DEF_DEF, target=d.graph.scan(DEFINITION).where((F.col("id") >= PART) & (F.col("start_line") == 1)))
    return _count(x.select(F.col("s.primary_file_path").alias("path"), F.col("t.definition_type").alias("definition_type")), "path", "definition_type")


@_query("anonymous_pattern", " SELECT type, count(*) AS n FROM refs GROUP BY 1")
def anonymous_pattern(d):
    return _count(d.graph.rel(q.DEF_DEF), "type")


# -- joins ----------------------------------------------------------------------------------------


@_query("parent_child_self_join", """, x AS (SELECT path, id FROM dirs UNION ALL SELECT path, id FROM files)
SELECT p.id AS source_id, c.id AS target_id, 'CONTAINS' AS type FROM x c JOIN x p ON p.path = regexp_replace(c.path, '/[^/]*$', '') AND c.path LIKE '%/%'""")
def parent_child_self_join(d):
    nodes = d.graph.scan(DIRECTORY).select("id", F.col("path").alias("fqn"), L("D").alias("definition_type")).unionByName(d.graph.scan(FILE).select("id", F.col("path").alias("fqn"), L("F").alias("definition_type"))).withColumn("primary_file_path", L(""))
    rules = d.spark.createDataFrame([("D", "D", "CONTAINS"), ("D", "F", "CONTAINS")], "parent_type string, child_type string, rel_type string")
    return joins.parent_child(nodes, rules, "/")


@_query("nearest_ancestor", """, x AS (SELECT id, path, 'D' AS k FROM dirs UNION ALL SELECT id + 100000, path, 'F' FROM files)
SELECT source_id, target_id, type, depth FROM (SELECT p.id AS source_id, c.id AS target_id, CASE WHEN c.k = 'F' THEN 'HOLDS' ELSE 'CONTAINS' END AS type, CAST(len(string_split(p.path, '/')) AS INTEGER) AS depth,
row_number() OVER (PARTITION BY c.id ORDER BY length(p.path) DESC) AS r FROM x c JOIN x p ON p.k = 'D' AND starts_with(c.path, p.path || '/')) WHERE r = 1""")
def nearest_ancestor(d):
    """Regions and nations are both candidates; the longer path wins."""
    one = lambda label, kind, by: d.graph.scan(label).select((F.col("id") + by).alias("id"), F.col("path").alias("fqn"), L(kind).alias("definition_type"), L("").alias("primary_file_path"))
    rules = d.spark.createDataFrame([("D", "F", "HOLDS"), ("D", "D", "CONTAINS")], "parent_type string, child_type string, rel_type string")
    return joins.nearest_ancestor(one(DIRECTORY, "D", 0).unionByName(one(FILE, "F", 100000)), rules, "/")


@_query("id_resolution", " SELECT d.id AS source_id, f.id AS target_id FROM dirs d JOIN files f ON d.path = regexp_replace(f.path, '/[^/]*$', '')")
def id_resolution(d):
    edges = d.graph.scan(FILE).select(fn.parent_path(F.col("path")).alias("s_path"), F.col("path").alias("t_path"))
    return joins.resolve_ids(edges, d.graph.scan(DIRECTORY), d.graph.scan(FILE), ["path"], ["path"]).select("source_id", "target_id")


@_query("anti_deleted", " SELECT f.id, f.path FROM files f WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = f.id AND o_orderpriority = '1-URGENT')")
def anti_deleted(d):
    there = d.t("orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("id"))
    return d.graph.scan(FILE).join(there, "id", "left_anti").select("id", "path")


@_query("semi_changed", " SELECT f.id, f.path FROM files f WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = f.id AND o_orderpriority = '5-LOW')")
def semi_changed(d):
    there = d.t("orders").where(F.col("o_orderpriority") == "5-LOW").select(F.col("o_custkey").alias("id"))
    return d.graph.scan(FILE).join(there, "id", "left_semi").select("id", "path")


@_query("innermost_interval", """SELECT e.event_id, arg_min(p.p_partkey, (p.p_size * 10, p.p_partkey % 50, p.p_partkey)) AS part FROM events e JOIN part p ON e.user_id % 25 = p.p_partkey % 25
AND p.p_partkey % 50 <= e.event_id % 50 AND e.event_id % 50 <= p.p_partkey % 50 + p.p_size * 10 GROUP BY 1""", graph=False)
def innermost_interval(d):
    points = d.t("events").select("event_id", (F.col("user_id") % 25).alias("k"), (F.col("event_id") % 50).alias("offset"))
    ranges = d.t("part").select((F.col("p_partkey") % 25).alias("k"), (F.col("p_partkey") % 50).alias("start"), (F.col("p_partkey") % 50 + F.col("p_size") * 10).alias("end"), "p_partkey")
    return joins.innermost(points, ranges, "k").select("event_id", F.col("range.p_partkey").alias("part"))


@_query("most_specific_prefix", " SELECT f.path, (SELECT d.path FROM dirs d WHERE starts_with(f.path, d.path || '/') ORDER BY length(d.path) DESC LIMIT 1) AS root FROM files f")
def most_specific_prefix(d):
    return joins.most_specific(d.graph.scan(FILE).select("path"), d.graph.scan(DIRECTORY).select(F.col("path").alias("root"))).select("path", "root")


@_query("symbol_match_latest", """, x AS (SELECT definition_type AS k, start_line AS b, id, 'definition' AS kind FROM partdefs UNION ALL SELECT definition_type, start_line, id, 'import' FROM orderdefs)
SELECT k AS name, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b DESC, kind, id) AS r FROM x) WHERE r = 1""")
def symbol_match_latest(d):
    x = d.graph.scan(DEFINITION).select(F.col("definition_type").alias("name"), L("").alias("file"), F.col("start_line").alias("start_byte"), "id")
    return joins.latest(x.where(F.col("id") >= PART), x.where(F.col("id") < PART)).select("name", "id", "kind")


@_query("precedence_join", """, c AS (SELECT c_custkey AS k, 0 AS precedence, min(o_orderkey) AS v FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1
UNION ALL SELECT c_custkey, 1, min(o_orderkey) FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT k, precedence, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY precedence, v) AS r FROM c) WHERE r = 1""")
def precedence_join(d):
    o = d.t("orders").join(d.t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderpriority")
    one = o.where(F.col("o_orderpriority") == "1-URGENT").groupBy("k").agg(F.min("v").alias("v"))
    return joins.by_precedence(["k"], [one, o.groupBy("k").agg(F.min("v").alias("v"))], [F.col("v")]).select("k", "precedence", "v")


# -- aggregates -----------------------------------------------------------------------------------


@_query("node_counts_row", " SELECT (SELECT count(*) FROM dirs) AS directories, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM defs) AS definitions, (SELECT count(*) FROM imps) AS imported_symbols")
def node_counts_row(d):
    return agg.node_counts(d.graph)


@_query("rel_counts_row", """ , c AS (SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM dirs WHERE id >= 1000) AS directory, (SELECT count(*) FROM orderdefs) AS file,
(SELECT count(*) FROM refs) + (SELECT count(*) FROM refs WHERE type = 'CALLS') AS definition, CAST(0 AS BIGINT) AS imported_symbol) SELECT *, directory + file + definition + imported_symbol AS total FROM c""")
def rel_counts_row(d):
    return agg.relationship_counts(d.graph)


@_query("count_by_type", " SELECT type, count(*) AS n FROM (SELECT type FROM refs UNION ALL SELECT type FROM refs WHERE type = 'CALLS') GROUP BY 1")
def count_by_type(d):
    return agg.count_by_type(d.graph, "DEFINITION_RELATIONSHIPS")


@_query("count_distinct_pairs", " SELECT type, count(DISTINCT (source_id, target_id)) AS pairs FROM refs GROUP BY 1")
def count_distinct_pairs(d):
    e = d.graph.rel(q.DEF_DEF).select("type", "source_id", "target_id", L("D").alias("from_label"), L("D").alias("to_label"))
    return agg.distinct_pairs(e, ["type"])


@_query("scalar_max_id", " SELECT max(id) AS value FROM defs")
def scalar_max_id(d):
    return agg.scalar(d.graph.scan(DEFINITION), "max", "id")


@_query("filtered_count", " SELECT count(*) AS n FROM files WHERE language IN ('BUILDING', 'FURNITURE')")
def filtered_count(d):
    return _count(d.graph.get_by(FILE, "language", ["BUILDING", "FURNITURE"]))


@_query("lang_breakdown", """, f AS (SELECT language, count(*) AS files FROM files GROUP BY 1), x AS (SELECT language, definition_type, count(*) AS n FROM orderdefs JOIN files ON path = primary_file_path GROUP BY 1, 2)
SELECT f.language, f.files, CAST(sum(n) AS BIGINT) AS definitions, string_agg(definition_type || '=' || n, ',' ORDER BY definition_type) AS types FROM f JOIN x USING (language) GROUP BY 1, 2""")
def lang_breakdown(d):
    pairs = F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], L("="), e["value"].cast("string")))
    return agg.language_breakdown(d.graph).select("language", "files", "definitions", F.array_join(pairs, ",").alias("types"))


@_query("workspace_rollup", ", x AS (SELECT split_part(f.path, '/', 1) AS workspace, definition_type AS k, count(*) AS n FROM orderdefs o JOIN files f ON f.path = o.primary_file_path GROUP BY f.path, 1, 2) SELECT workspace, k, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1, 2")
def workspace_rollup(d):
    x = d.graph.scan(DEFINITION).where(F.col("id") < PART).groupBy(F.col("primary_file_path").alias("p"), F.col("definition_type").alias("k")).agg(F.count(L(1)).alias("n"))
    return agg.roll_up(x.withColumn("workspace", F.substring_index("p", "/", 1)), ["workspace", "k"])


@_query("status_rollup", """SELECT user_id AS workspace, CASE WHEN bool_or(event_type = 'error') THEN 'error' WHEN bool_or(event_type = 'click') THEN 'indexing' WHEN bool_or(event_type = 'view') THEN 'reindexing' ELSE 'pending' END AS status, max(ts) AS last_indexed_at FROM events GROUP BY 1""", graph=False)
def status_rollup(d):
    s = F.when(F.col("event_type") == "click", "indexing").when(F.col("event_type") == "view", "reindexing").when(F.col("event_type") == "error", "error").otherwise("other")
    return agg.status_roll_up(d.t("events").select(F.col("user_id").alias("workspace"), s.alias("status"), F.col("ts").alias("last_indexed_at")), "workspace")


@_query("group_refs", """ SELECT s.fqn || ':L' || (s.start_line + 1) || '-' || (s.end_line + 1) AS reference, count(*) AS n, string_agg(DISTINCT CAST(line AS VARCHAR), ',' ORDER BY CAST(line AS VARCHAR)) AS lines
FROM refs JOIN orderdefs s ON s.id = source_id WHERE type = 'CALLS' GROUP BY 1""")
def group_refs(d):
    x = d.graph.expand(q.DEF_DEF, F.col("type") == "CALLS").select("s.fqn", "s.start_line", "s.end_line", "r.call_line")
    return agg.group_references(x).withColumn("lines", F.array_join(F.sort_array(F.col("lines").cast("array<string>")), ","))


@_query("token_sums", "SELECT role, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS tokens, max(turn) AS last FROM conversations GROUP BY 1", graph=False)
def token_sums(d):
    return d.t("conversations").groupBy("role").agg(F.count(L(1)).alias("turns"), F.sum(F.length("text")).alias("tokens"), F.max("turn").alias("last"))


@_query("tool_share_log10", """WITH c AS (SELECT role, count(*) AS n FROM conversations GROUP BY 1), p AS (SELECT *, n * 100.0 / sum(n) OVER () AS percent FROM c), l AS (SELECT *, log10(percent + 1) AS lg FROM p)
SELECT role, n, round(CAST(percent AS DOUBLE), 6) AS percent, round(CAST(lg / sum(lg) OVER () AS DOUBLE), 6) AS log_share FROM l""", graph=False)
def tool_share_log10(d):
    s = agg.shares(_count(d.t("conversations"), "role"), "role")
    return s.select("role", "n", F.round("percent", 6).alias("percent"), F.round("log_share", 6).alias("log_share"))


@_query("mean_missing_zero", "SELECT role AS key, round(count(*) * 1.0 / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS mean FROM conversations GROUP BY 1", graph=False)
def mean_missing_zero(d):
    c = d.t("conversations")
    x = c.groupBy("conv_id", F.col("role").alias("key")).agg(F.count(L(1)).alias("n"))
    return agg.mean_over(x, "key", "n", c.agg(F.count_distinct("conv_id")).first()[0]).select("key", F.round("mean", 6).alias("mean"))


@_query("event_rates", "SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) * 100.0 / count(*), 1) AS click_rate FROM events GROUP BY 1", graph=False)
def event_rates(d):
    return agg.rates(d.t("events").withColumn("click", F.col("event_type") == "click"), ["click"], "user_id").withColumn("click_rate", F.col("click_rate").cast("double"))


@_query("latency_quantiles", """WITH b AS (SELECT event_type, le FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([10.0, 25.0, 50.0, 75.0, 100.0, 1000.0, 1e9]) AS le)),
c AS (SELECT b.event_type, CAST(b.le AS DOUBLE) AS le, count(e.value) AS n FROM b LEFT JOIN events e ON e.event_type = b.event_type AND e.value <= b.le GROUP BY 1, 2),
w AS (SELECT *, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0.0) AS low, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS before, max(n) OVER (PARTITION BY event_type) * 0.5 AS want FROM c)
SELECT event_type, round(low + (le - low) * (want - before) / (n - before), 4) AS value FROM w WHERE n >= want AND before < want""", graph=False)
def latency_quantiles(d):
    les = [10.0, 25.0, 50.0, 75.0, 100.0, 1000.0, 1e9]
    e = d.t("events")
    wide = e.groupBy("event_type").agg(*[F.sum((F.col("value") <= le).cast("long")).alias(f"b{i}") for i, le in enumerate(les)])
    b = wide.select("event_type", F.explode(F.array(*[F.struct(L(le).alias("le"), F.col(f"b{i}").alias("n")) for i, le in enumerate(les)])).alias("x")).select("event_type", "x.*")
    return agg.bucket_quantile(b, ["event_type"], 0.5).select("event_type", F.round("value", 4).alias("value"))


@_query("safe_ratio", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'click') / nullif(CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE), 0), 6) AS ratio FROM events GROUP BY 1", graph=False)
def safe_ratio(d):
    c = d.t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    return c.select("user_id", F.round(agg.safe_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


# -- order and limit ------------------------------------------------------------------------------


@_query("file_definitions", """ SELECT fqn, name, definition_type, start_line AS line_number, primary_file_path AS file_path FROM orderdefs WHERE primary_file_path = (SELECT path FROM files WHERE id = 7) ORDER BY start_line, id LIMIT 100""")
def file_definitions(d):
    path = d.graph.scan(FILE).where("id = 7").select("path").first()
    return q.file_definitions(d.graph, path["path"] if path else "")


@_query("list_matches", " SELECT fqn, name, definition_type, primary_file_path AS file_path, start_line AS line_number FROM defs WHERE contains(lower(fqn), 'brand#2') ORDER BY fqn, id LIMIT 50")
def list_matches(d):
    return q.list_matches(d.graph, "Brand#2")


@_query("search_definitions_page2", " SELECT name, fqn, definition_type, primary_file_path AS file_path, start_line, end_line FROM defs WHERE contains(lower(fqn), 'brand#1') OR contains(lower(name), 'brand#1') OR contains(lower(fqn), 'red') OR contains(lower(name), 'red') ORDER BY primary_file_path, start_line, id LIMIT 50 OFFSET 50")
def search_definitions_page2(d):
    return q.search_definitions(d.graph, ["brand#1", "red"], 2)


@_query("repo_map_page", " SELECT primary_file_path AS file_path, fqn, definition_type, start_line, end_line FROM defs WHERE primary_file_path IN ('lib/Brand#11', 'lib/Brand#12', 'lib/Brand#21') ORDER BY primary_file_path, start_line, id LIMIT 20 OFFSET 20")
def repo_map_page(d):
    return q.repo_map(d.graph, ["lib/Brand#11", "lib/Brand#12", "lib/Brand#21"], 2, 20)


@_query("per_branch_limit_union", " (SELECT 'file' AS kind, id, name FROM files ORDER BY id LIMIT 8) UNION ALL (SELECT 'import', id, name FROM imps ORDER BY id LIMIT 8)")
def per_branch_limit_union(d):
    part = lambda label, kind: d.graph.scan(label).orderBy("id").limit(8).select(L(kind).alias("kind"), "id", "name")
    return part(FILE, "file").unionByName(part(IMPORT, "import"))


@_query("top_languages", " SELECT language, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, language LIMIT 3")
def top_languages(d):
    return _count(d.graph.scan(FILE), "language").orderBy(F.col("n").desc(), "language").limit(3)


# -- sets and drawn graphs ------------------------------------------------------------------------

_EDGES_SQL = """, drawn AS (
  SELECT p.id AS source_id, c.id AS target_id, 'DIR_CONTAINS_DIR' AS relationship_type, 'DirectoryNode' AS st, 'DirectoryNode' AS tt, 0 AS order_priority, p.path AS sp, c.path AS tp FROM dirs p JOIN dirs c ON c.path = p.path || '/' || c.name
  UNION ALL SELECT d.id, f.id, 'DIR_CONTAINS_FILE', 'DirectoryNode', 'FileNode', 1, d.path, f.path FROM dirs d JOIN files f ON f.path = d.path || '/' || f.name
  UNION ALL SELECT f.id, o.id, 'FILE_DEFINES', 'FileNode', 'DefinitionNode', 2, f.path, '' FROM files f JOIN orderdefs o ON o.primary_file_path = f.path)"""


@_query("initial_graph", _EDGES_SQL + """, more AS (SELECT * FROM drawn UNION ALL SELECT source_id, target_id, type, 'DefinitionNode', 'DefinitionNode', 4, '', '' FROM refs UNION ALL SELECT source_id, import_id, type, 'DefinitionNode', 'ImportedSymbolNode', 5, '', '' FROM refs WHERE type = 'CALLS'),
r AS (SELECT st AS source_type, tt AS target_type, source_id, target_id, row_number() OVER (PARTITION BY order_priority ORDER BY source_id, target_id) AS k FROM more)
SELECT source_type, target_type, count(*) AS n, CAST(sum(source_id) AS BIGINT) AS sources, CAST(sum(target_id) AS BIGINT) AS targets FROM r WHERE k <= 100 GROUP BY 1, 2""")
def initial_graph(d):
    x = q.initial_graph(d.graph)
    return x.groupBy("source_type", "target_type").agg(F.count(L(1)).alias("n"), F.sum("source_id").alias("sources"), F.sum("target_id").alias("targets"))


def _neighbours(label: str, node: int):
    return lambda d: q.neighbours(d.graph, label, node).select("source_id", "source_type", "target_id", "target_type", "relationship_type")


for _name, _label, _node, _cond in (
    ("neighbors_directory", DIRECTORY, 1003, "st = 'DirectoryNode' AND source_id = 1003 OR tt = 'DirectoryNode' AND target_id = 1003"),
    ("neighbors_file", FILE, 11, "st = 'FileNode' AND source_id = 11 OR tt = 'FileNode' AND target_id = 11"),
):
    _query(_name, _EDGES_SQL + f" SELECT source_id, st AS source_type, target_id, tt AS target_type, relationship_type FROM drawn WHERE {_cond} ORDER BY order_priority, source_id, target_id LIMIT 100")(_neighbours(_label, _node))

_query("neighbors_definition", _EDGES_SQL + """, x AS (SELECT DISTINCT source_id, st, target_id, tt, relationship_type, order_priority FROM drawn WHERE tt = 'DefinitionNode' AND target_id = 33
UNION ALL SELECT source_id, 'DefinitionNode', target_id, 'DefinitionNode', type, 3 FROM refs WHERE source_id = 33 UNION ALL SELECT source_id, 'DefinitionNode', import_id, 'ImportedSymbolNode', type, 4 FROM refs WHERE source_id = 33 AND type = 'CALLS')
SELECT source_id, st AS source_type, target_id, tt AS target_type, relationship_type FROM x""")(_neighbours(DEFINITION, 33))


@_query("search_nodes", """, x AS (SELECT id, 'DirectoryNode' AS type, path, name, '' AS fqn, '' AS import_path FROM dirs WHERE contains(lower(name), 'an') OR contains(lower(path), 'an')
UNION ALL SELECT id, 'FileNode', path, name, '', '' FROM files WHERE contains(lower(name), 'an') OR contains(lower(path), 'an')
UNION ALL SELECT id, 'DefinitionNode', '', name, fqn, '' FROM defs WHERE contains(lower(name), 'an') OR contains(lower(fqn), 'an')
UNION ALL SELECT id, 'ImportedSymbolNode', '', name, '', import_path FROM imps WHERE contains(lower(name), 'an') OR contains(lower(import_path), 'an')) SELECT * FROM x ORDER BY type, name, id LIMIT 100""")
def search_nodes(d):
    return q.search_nodes(d.graph, "aN").select("id", "type", "path", "name", "fqn", "import_path")


@_query("dedup_nodes", _EDGES_SQL + """ SELECT DISTINCT type, id FROM (SELECT st AS type, source_id AS id FROM drawn UNION ALL SELECT tt, target_id FROM drawn UNION ALL SELECT 'DefinitionNode', source_id FROM refs
UNION ALL SELECT 'DefinitionNode', target_id FROM refs UNION ALL SELECT 'ImportedSymbolNode', import_id FROM refs WHERE type = 'CALLS')""")
def dedup_nodes(d):
    return q.unique_nodes(d.graph.sections(RELS, once=False), ["type", "id"])


@_query("path_union", " SELECT DISTINCT path FROM (SELECT primary_file_path AS path FROM defs UNION ALL SELECT file_path FROM imps)")
def path_union(d):
    return d.graph.scan(DEFINITION).select(F.col("primary_file_path").alias("path")).union(d.graph.scan(IMPORT).select("file_path")).distinct()


@_query("watcher_difference", "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150", graph=False)
def watcher_difference(d):
    e = d.t("events")
    return e.where("event_type = 'view'").select("user_id").subtract(e.where("event_type = 'purchase' AND value > 150").select("user_id"))


# -- library queries ------------------------------------------------------------------------------


@_query("import_usage", """ SELECT i.file_path, i.import_path, i.name, i.alias, i.start_line AS import_start_line, s.primary_file_path AS ref_file, r.line AS ref_start_line, s.fqn AS ref_fqn, s.start_line AS def_start_line
FROM imps i LEFT JOIN refs r ON r.import_id = i.id AND r.type = 'CALLS' LEFT JOIN orderdefs s ON s.id = r.source_id WHERE lower(i.import_path) = lower((SELECT s_name FROM supplier WHERE s_suppkey = 5))""")
def import_usage(d):
    name = d.t("supplier").where("s_suppkey = 5").first()
    x = q.import_usage(d.graph, name["s_name"] if name else "")
    return x.select("file_path", "import_path", "name", "alias", "import_start_line", "ref_file", "ref_start_line", "ref_fqn", "def_start_line")


@_query("import_paths", " SELECT file_path, import_path, name, alias, start_line, 0 AS end_line FROM imps WHERE contains(lower(import_path), '1') ORDER BY import_path, file_path, id LIMIT 50")
def import_paths(d):
    return q.import_paths(d.graph, "1")


@_query("definition_relations", """ SELECT t.fqn, type AS relationship_type, t.name, t.definition_type, t.primary_file_path AS file_path, t.start_line AS line_number FROM refs JOIN partdefs t ON t.id = target_id WHERE source_id = 33""")
def definition_relations(d):
    return q.definition_relations(d.graph, 33)


@_query("definitions_in_file", " SELECT id, name, fqn, primary_file_path AS file_path, start_line AS line_number FROM defs WHERE primary_file_path = 'lib/Brand#11' AND (contains(lower(fqn), 'e') OR contains(lower(name), 'e'))")
def definitions_in_file(d):
    return q.definitions_in_file(d.graph, "E", "lib/Brand#11")


@_query("call_relationships", " SELECT s.fqn AS source_fqn, t.fqn AS target_fqn, type FROM refs JOIN orderdefs s ON s.id = source_id JOIN partdefs t ON t.id = target_id WHERE t.fqn = (SELECT fqn FROM partdefs ORDER BY fqn LIMIT 1)")
def call_relationships(d):
    first = d.graph.scan(DEFINITION).where(F.col("id") >= PART).orderBy("fqn").first()
    return q.call_relationships(d.graph, target=first["fqn"])


@_query("callers_first_n", " SELECT DISTINCT s.fqn FROM refs JOIN orderdefs s ON s.id = source_id JOIN partdefs t ON t.id = target_id WHERE t.fqn = (SELECT fqn FROM partdefs ORDER BY fqn LIMIT 1) ORDER BY 1 LIMIT 20")
def callers_first_n(d):
    first = d.graph.scan(DEFINITION).where(F.col("id") >= PART).orderBy("fqn").first()
    return q.callers(d.graph, first["fqn"], 20)


@_query("callees", " SELECT DISTINCT t.fqn FROM refs JOIN orderdefs s ON s.id = source_id JOIN partdefs t ON t.id = target_id WHERE s.id = 66")
def callees(d):
    one = d.graph.scan(DEFINITION).where("id = 66").first()
    return q.callees(d.graph, one["fqn"] if one else "")


@_query("callers_of_import", " SELECT DISTINCT s.fqn FROM refs r JOIN orderdefs s ON s.id = r.source_id JOIN imps i ON i.id = r.import_id WHERE r.type = 'CALLS' AND i.import_path = (SELECT s_name FROM supplier WHERE s_suppkey = 3)")
def callers_of_import(d):
    name = d.t("supplier").where("s_suppkey = 3").first()
    return q.callers_of_import(d.graph, name["s_name"] if name else "")


@_query("get_references", """ SELECT s.fqn, s.name, s.definition_type, s.primary_file_path AS file_path, s.start_line, s.end_line, r.line AS call_line, r.type AS relationship_type, t.fqn AS target_fqn
FROM refs r JOIN orderdefs s ON s.id = source_id JOIN partdefs t ON t.id = target_id WHERE t.name = (SELECT min(p_name) FROM part) ORDER BY file_path, s.start_line, s.fqn, call_line, target_fqn LIMIT 50""")
def get_references(d):
    name = d.t("part").agg(F.min("p_name").alias("m")).first()["m"]
    return q.references(d.graph, name)


@_query("read_definitions", """ , a AS (SELECT DISTINCT p_name AS name, 'lib/' || p_brand AS file_path FROM part WHERE p_partkey < 40) SELECT d.name, d.primary_file_path AS file_path, d.fqn, d.definition_type, d.start_line, d.end_line FROM defs d JOIN a ON a.name = d.name AND a.file_path = d.primary_file_path""")
def read_definitions(d):
    asked = d.t("part").where("p_partkey < 40").select(F.col("p_name").alias("name"), F.concat(L("lib/"), "p_brand").alias("file_path"))
    return q.read_definitions(d.graph, asked)


# -- text and paths -------------------------------------------------------------------------------


def _texts(d: Demo) -> DataFrame:
    return d.t("documents").select(F.col("doc_id").alias("path"), "text")


@_query("line_explode", "SELECT doc_id AS path, i AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) t(i)", graph=False)
def line_explode(d):
    return text.lines(_texts(d)).withColumn("line", F.col("line").cast("long"))


@_query("line_match", "SELECT doc_id AS path, i AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) t(i) WHERE trim(ls[i]) = 'Released under the MIT License.'", graph=False)
def line_match(d):
    return text.match_lines(_texts(d), "  Released under the MIT License. ").withColumn("line", F.col("line").cast("long"))


@_query("chunk_read_status", """WITH x AS (SELECT doc_id AS path, CAST(doc_id % 4 AS INTEGER) AS s, CAST(doc_id % 7 AS INTEGER) AS e, regexp_replace(text, chr(10) || '$', '') AS t, text FROM documents),
y AS (SELECT *, string_split(t, chr(10)) AS ls, CASE WHEN text = '' THEN 0 ELSE len(string_split(t, chr(10))) END AS n FROM x),
z AS (SELECT *, CASE WHEN s < 1 THEN 'start_is_zero' WHEN e < s THEN 'end_before_start' WHEN s > n THEN 'start_beyond_end' WHEN e > n THEN 'end_beyond_end' END AS error FROM y)
SELECT path, s AS "start", e AS "end", CASE WHEN error IS NULL THEN array_to_string(ls[s:e], chr(10)) || chr(10) END AS chunk, error FROM z""", graph=False)
def chunk_read_status(d):
    asked = _texts(d).select("path", (F.col("path") % 4).cast("int").alias("start"), (F.col("path") % 7).cast("int").alias("end"))
    return text.read_ranges(_texts(d), asked)


@_query("symbol_col_ranges", """SELECT doc_id, len(regexp_extract_all(text, 'the ')) AS n, strlen(string_split(text, 'the ')[1]) AS first_start FROM documents WHERE contains(text, 'the ')""", graph=False)
def symbol_col_ranges(d):
    spans = fn.occurrences(F.col("text"), "the ")
    return d.t("documents").where(F.contains("text", L("the "))).select("doc_id", F.size(spans).cast("long").alias("n"), F.element_at(spans, 1)["start"].alias("first_start"))


_SEGMENTS = "regexp_replace(url, '^[a-z]+://', '')"


@_query("path_hierarchy", f"SELECT DISTINCT array_to_string(list_slice(string_split(u, '/'), 1, i), '/') AS dir FROM (SELECT {_SEGMENTS} AS u FROM pages) , range(1, len(string_split(u, '/'))) t(i)", graph=False)
def path_hierarchy(d):
    return text.directories(d.t("pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


@_query("path_depth_parts", f"SELECT page_id, len(u) - len(replace(u, '/', '')) AS depth, CASE WHEN contains(u, '/') THEN regexp_replace(u, '/[^/]*$', '') ELSE '' END AS parent, string_split(u, '/')[-1] AS name FROM (SELECT page_id, {_SEGMENTS} AS u FROM pages)", graph=False)
def path_depth_parts(d):
    u = d.t("pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("u"))
    return u.select("page_id", fn.depth(F.col("u")).cast("long").alias("depth"), fn.parent_path(F.col("u")).alias("parent"), fn.base_name(F.col("u")).alias("name"))


@_query("path_hash16", "SELECT page_id, substr(sha256(url), 1, 16) AS h FROM pages", graph=False)
def path_hash16(d):
    return d.t("pages").select("page_id", fn.path_hash16(F.col("url")).alias("h"))


@_query("ws_collapse", "SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents", graph=False)
def ws_collapse(d):
    return d.t("documents").select("doc_id", F.length(fn.collapse_space(F.col("text"))).cast("long").alias("n"))


@_query("first_prints", "SELECT doc_id AS path, ls[i] AS line, min(i) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) t(i) GROUP BY 1, 2", graph=False)
def first_prints(d):
    rows = text.lines(d.t("documents").select(F.col("doc_id").alias("path"), "text"))
    return text.first_prints(rows.select("path", F.col("line").cast("long").alias("place"), F.col("text").alias("line"))).select("path", "line", "place")


# -- closures -------------------------------------------------------------------------------------


@_query("dir_descendants", """RECURSION, e AS (SELECT 'd' || p.id AS src, 'd' || c.id AS dst FROM dirs p JOIN dirs c ON c.path = p.path || '/' || c.name UNION ALL SELECT 'd' || d.id, 'f' || f.id FROM dirs d JOIN files f ON f.path = d.path || '/' || f.name),
c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.dst) SELECT src, dst, depth FROM c""")
def dir_descendants(d):
    e = d.graph.rel(DIR_DIR).select(F.concat(L("d"), "source_id").alias("src"), F.concat(L("d"), "target_id").alias("dst"))
    f = d.graph.rel(DIR_FILE).select(F.concat(L("d"), "source_id").alias("src"), F.concat(L("f"), "target_id").alias("dst"))
    return clo.closure(e.unionByName(f))


@_query("import_chain", """WITH RECURSIVE e AS (SELECT DISTINCT doc_id AS src, CAST(doc_id / 3 AS BIGINT) AS dst FROM (SELECT doc_id - doc_id % 3 AS doc_id FROM documents) WHERE doc_id >= 3),
c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.dst)
SELECT src, dst, depth FROM c WHERE dst NOT IN (SELECT src FROM e)""", graph=False)
def import_chain(d):
    e = d.t("documents").select((F.col("doc_id") - F.col("doc_id") % 3).alias("src")).where("src >= 3").select("src", (F.col("src") / 3).cast("long").alias("dst")).distinct()
    return clo.terminals(e, e.select("src"))


@_query("common_ancestor", """WITH RECURSIVE up AS (SELECT DISTINCT p_size AS src, p_size AS dst, 0 AS depth FROM part UNION SELECT src, dst // 2, depth + 1 FROM up WHERE dst > 1),
g AS (SELECT DISTINCT p_brand AS "group", p_size AS src FROM part), s AS (SELECT "group", count(DISTINCT src) AS n FROM g GROUP BY 1),
c AS (SELECT g."group", up.dst, count(DISTINCT g.src) AS k, sum(depth) AS far FROM g JOIN up ON up.src = g.src GROUP BY 1, 2)
SELECT "group", dst AS ancestor FROM (SELECT c.*, row_number() OVER (PARTITION BY c."group" ORDER BY far, dst) AS r FROM c JOIN s ON s."group" = c."group" AND s.n = c.k) WHERE r = 1""", graph=False)
def common_ancestor(d):
    part = d.t("part")
    groups = part.select(F.col("p_brand").alias("group"), F.col("p_size").alias("type")).distinct()
    top = part.agg(F.max("p_size").alias("m"))
    parents = top.select(F.explode(F.sequence(L(2), F.greatest("m", L(2)))).alias("src")).select("src", F.floor(F.col("src") / 2).cast("int").alias("dst"))
    return clo.common_ancestor(groups, parents)


@_query("long_chain", """WITH RECURSIVE e AS (SELECT p_partkey AS src, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS dst FROM part),
c AS (SELECT src, dst, 1 AS depth FROM e WHERE dst IS NOT NULL UNION ALL SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.dst WHERE e.dst IS NOT NULL) SELECT src, dst, depth FROM c""", graph=False)
def long_chain(d):
    """The closure of one chain a brand, as long as the brand has parts."""
    e = d.t("part").select(F.col("p_partkey").alias("src"), F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("dst"))
    return clo.closure(e.where("dst IS NOT NULL"))


@_query("member_lookup", """WITH RECURSIVE up AS (SELECT DISTINCT p_size AS src, p_size AS dst, 0 AS depth FROM part UNION SELECT src, dst // 2, depth + 1 FROM up WHERE dst > 1),
m AS (SELECT p_size AS t, p_type AS name, min(p_partkey) AS member FROM part GROUP BY 1, 2), asked AS (SELECT DISTINCT a.p_size AS t, b.p_type AS name FROM (SELECT DISTINCT p_size FROM part) a, (SELECT DISTINCT p_type FROM part) b),
c AS (SELECT asked.t, asked.name, m.member, up.depth, up.dst AS owner, row_number() OVER (PARTITION BY asked.t, asked.name ORDER BY up.depth) AS r FROM asked JOIN up ON up.src = asked.t JOIN m ON m.t = up.dst AND m.name = asked.name)
SELECT t AS type, name, member, depth, owner FROM c WHERE r = 1""", graph=False)
def member_lookup(d):
    """Each size asks for each part type: its own, or the nearest half's that has one."""
    part = d.t("part")
    sizes = part.select(F.col("p_size").alias("type")).distinct()
    asked = sizes.join(F.broadcast(part.select(F.col("p_type").alias("name")).distinct()))  # at most 150 part types
    members = part.groupBy(F.col("p_size").alias("type"), F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("member"))
    every = part.select(F.explode(F.sequence(L(2), F.greatest("p_size", L(2)))).alias("src")).distinct()
    return clo.member_lookup(asked, every.select("src", F.floor(F.col("src") / 2).cast("int").alias("dst"), L(0).alias("rank")), members)


# -- mutation -------------------------------------------------------------------------------------


@_query("detach_delete", " SELECT type, count(*) AS n FROM refs JOIN orderdefs s ON s.id = source_id WHERE s.definition_type <> '5-LOW' GROUP BY 1")
def detach_delete(d):
    return _count(inc.detach_delete(d.graph, DEFINITION, d.graph.scan(DEFINITION).where("definition_type = '5-LOW'").select("id")).rel(q.DEF_DEF), "type")


@_query("upsert_changed", " SELECT id, CASE WHEN language IN ('BUILDING', 'MACHINERY') THEN upper(path) ELSE path END AS path FROM files WHERE language <> 'FURNITURE'")
def upsert_changed(d):
    """Two languages change, two are deleted; what is both changed and deleted stays, as changed."""
    f = d.graph.scan(FILE)
    changed, deleted = f.where("language IN ('BUILDING', 'MACHINERY')").withColumn("path", F.upper("path")), f.where("language IN ('MACHINERY', 'FURNITURE')")
    return inc.upsert(f, changed, deleted.select("id"), ["id"]).select("id", "path")


@_query("changed_rows", " SELECT id, fqn FROM defs WHERE primary_file_path IN ('lib/Brand#11', 'lib/Brand#12') AND start_line <= 25")
def changed_rows(d):
    """Definitions of two changed files that their new version (the ones beyond line 25) lacks."""
    old = d.graph.scan(DEFINITION)
    changed = d.spark.createDataFrame([("lib/Brand#11",), ("lib/Brand#12",)], "path string")
    return inc.diff(old, old.where("start_line > 25"), ["id"], changed, "primary_file_path").select("id", "fqn")


@_query("assigned_ids", """, k AS (SELECT id, row_number() OVER (ORDER BY path) AS n FROM dirs WHERE id >= 1000)
SELECT path, CASE WHEN d.id < 1000 THEN d.id ELSE (SELECT max(id) FROM dirs WHERE id < 1000) + k.n END AS id FROM dirs d LEFT JOIN k ON k.id = d.id""")
def assigned_ids(d):
    """Known directories keep their ids, the others are numbered on in the order of their paths."""
    all_ = d.graph.scan(DIRECTORY)
    return inc.assign_ids(all_.drop("id"), all_.where("id < 1000"), DIRECTORY).select("path", "id")


@_query("status_classes", """SELECT event_id, CASE WHEN event_type = 'click' THEN 'deleted' WHEN event_type IN ('view', 'signup') THEN 'added' ELSE 'modified' END AS change, CASE WHEN user_id % 2 = 0 THEN 'dir' ELSE 'file' END AS kind FROM events""", graph=False)
def status_classes(d):
    code = F.when(F.col("event_type") == "click", " D").when(F.col("event_type") == "view", "A ").when(F.col("event_type") == "signup", "??").otherwise(" M")
    path = F.concat(F.col("event_id").cast("string"), F.when(F.col("user_id") % 2 == 0, "/").otherwise(".py"))
    x = inc.classify_status(d.t("events").select(path.alias("path"), code.alias("code")))
    return x.select(F.regexp_extract("path", r"^\d+", 0).cast("long").alias("event_id"), "change", "kind")


@_query("watched_classes", """SELECT event_id, CASE WHEN c.c_custkey IS NULL THEN 'deleted' ELSE 'changed' END AS change, CASE WHEN c.c_custkey IS NULL THEN 'dir' WHEN c.c_nationkey < 10 THEN 'dir' ELSE 'file' END AS kind
FROM events LEFT JOIN customer c ON c.c_custkey = event_id""", graph=False)
def watched_classes(d):
    watched = d.t("events").select(F.col("event_id").cast("string").alias("path"))
    there = d.t("customer").select(F.col("c_custkey").cast("string").alias("path"), (F.col("c_nationkey") < 10).alias("is_dir"))
    return inc.classify_watched(watched, there).select(F.col("path").cast("long").alias("event_id"), "change", "kind")


@_query("id_heads", " SELECT 'dirs' AS label, max(id) + 1 AS head FROM dirs UNION ALL SELECT 'files', max(id) + 1 FROM files UNION ALL SELECT 'defs', max(id) + 1 FROM defs")
def id_heads(d):
    part = lambda label, n: d.graph.scan(label).agg((F.max("id") + 1).alias("head")).select(L(n).alias("label"), "head")
    return part(DIRECTORY, "dirs").unionByName(part(FILE, "files")).unionByName(part(DEFINITION, "defs"))


# -- streams, in their batch form -----------------------------------------------------------------


@_query("debounce_sessions", """WITH x AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM x) SELECT user_id AS project, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n, count(DISTINCT event_type) AS paths FROM y GROUP BY user_id, g""", graph=False)
def debounce_sessions(d):
    x = sessions.debounce(sessions.file_events(d.t("events")), "2 hours")
    return x.select("project", F.unix_micros("start").alias("start_us"), "n", F.size("paths").cast("long").alias("paths"))


@_query("tumbling_counts", "SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS day_us, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2", graph=False)
def tumbling_counts(d):
    e = d.t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(L(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.unix_micros("w.start").alias("day_us"), "event_type", "n", "v")


@_query("event_latest_status", "SELECT user_id AS project, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY 1", graph=False)
def event_latest_status(d):
    return d.t("events").groupBy(F.col("user_id").alias("project")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(L(1)).alias("n"))


@_query("priority_preemption", """WITH j AS (SELECT event_id, user_id AS workspace, event_type AS kind, ts, CASE WHEN value > 90 THEN 'High' WHEN value > 40 THEN 'Normal' ELSE 'Low' END AS priority FROM events),
h AS (SELECT *, max(CASE WHEN priority = 'High' THEN ts END) OVER (PARTITION BY workspace, kind) AS last_high FROM j)
SELECT workspace, CASE WHEN priority <> 'High' AND ts < last_high THEN 'Cancelled' ELSE 'Pending' END AS status, count(*) AS n FROM h GROUP BY 1, 2""", graph=False)
def priority_preemption(d):
    p = F.when(F.col("value") > 90, "High").when(F.col("value") > 40, "Normal").otherwise("Low")
    return _count(sessions.preempt(d.t("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("workspace"), F.col("event_type").alias("kind"), "ts", p.alias("priority"))), "workspace", "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return tree_demo.queries() | {name: (lambda spark, sf_dir, f=f: f(Demo(spark, sf_dir))) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return tree_demo.oracle_sql() | {name: sql.strip() for name, (_, sql) in _QUERIES.items() if sql}
