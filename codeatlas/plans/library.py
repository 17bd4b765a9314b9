"""Queries over a property graph. Every limit stands under a total order."""

from __future__ import annotations

from functools import reduce  # noqa: F401  tools use it too

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import any_term, contains_ci
from ..graph import PropertyGraph
from ..operators.joins import first_by
from ..schema import DEF_REL, DEFINITION, DIRECTORY, FILE, FILE_REL, IMP_REL, IMPORT, NODES, RELS, WIDE, Rel, wide

DEF_DEF, DEF_IMP = Rel(DEF_REL, DEFINITION, DEFINITION), Rel(DEF_REL, DEFINITION, IMPORT)
FILE_DEF, FILE_IMP = Rel(FILE_REL, FILE, DEFINITION), Rel(FILE_REL, FILE, IMPORT)
IMP_DEF = Rel(IMP_REL, IMPORT, DEFINITION)
REFERENCE_TYPES = ("CALLS", "AMBIGUOUSLY_CALLS", "PROPERTY_REFERENCE")
PAGE = 50


def page(df: DataFrame, order: list, number: int = 1, size: int = PAGE, most: int | None = None) -> DataFrame:
    """One page of a totally ordered result, pages from 1; one row more is not read to find a next page."""
    size = min(size, most) if most else size
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def import_usage(g: PropertyGraph, import_path: str, name: str | None = None, alias: str | None = None) -> DataFrame:
    """Imports of a package, each with the places that use it (nulls where none does)."""
    cond = F.lower(F.col("n.import_path")) == import_path.lower()
    if name:
        cond = cond & (F.col("n.name") == name)
    if alias:
        cond = cond & (F.col("n.alias") == alias)
    used = g.optional(DEF_IMP, "target", F.col("type").isin(*REFERENCE_TYPES)).where(cond)
    d = g.scan(DEFINITION).select(F.struct(*NODES[DEFINITION].names).alias("d"))
    out = used.join(d, F.col("r.source_id") == F.col("d.id"), "left")
    return out.select(
        F.col("n.file_path").alias("file_path"), F.col("n.import_path").alias("import_path"), F.col("n.name").alias("name"), F.col("n.alias").alias("alias"),
        F.col("n.start_line").alias("import_start_line"), F.col("n.end_line").alias("import_end_line"), F.col("d.primary_file_path").alias("ref_file"),
        F.coalesce(F.col("r.source_start_line"), F.col("d.start_line")).alias("ref_start_line"), F.coalesce(F.col("r.source_end_line"), F.col("d.end_line")).alias("ref_end_line"),
        F.col("d.fqn").alias("ref_fqn"), F.col("d.start_line").alias("def_start_line"), F.col("r.edge_id").alias("edge_id"),
    )


def import_paths(g: PropertyGraph, term: str, limit: int = 50) -> DataFrame:
    cols = ["file_path", "import_path", "name", "alias", "start_line", "end_line"]
    return g.scan(IMPORT).where(contains_ci(F.col("import_path"), term)).orderBy("import_path", "file_path", "id").limit(limit).select(*cols)


def definition_relations(g: PropertyGraph, definition_id: int, limit: int = 100) -> DataFrame:
    """Definitions at either end of any edge of one definition."""
    both = g.undirected(DEF_DEF).where(F.col("source_id") == definition_id)
    d = g.scan(DEFINITION)
    out = both.join(d, F.col("target_id") == d["id"])
    return out.orderBy("fqn", "type", "edge_id").limit(limit).select("fqn", F.col("type").alias("relationship_type"), "name", "definition_type", F.col("primary_file_path").alias("file_path"), F.col("start_line").alias("line_number"))


def file_definitions(g: PropertyGraph, path: str, limit: int = 100) -> DataFrame:
    x = g.expand(FILE_DEF, source=g.scan(FILE).where((F.col("path") == path) | (F.col("absolute_path") == path)))
    return x.orderBy("t.start_line", "t.id").limit(limit).select("t.fqn", "t.name", "t.definition_type", F.col("t.start_line").alias("line_number"), F.col("s.path").alias("file_path"))


def file_imports(g: PropertyGraph, path: str, limit: int = 100) -> DataFrame:
    x = g.expand(FILE_IMP, source=g.scan(FILE).where((F.col("path") == path) | (F.col("absolute_path") == path)))
    return x.orderBy("t.start_line", "t.id").limit(limit).select("t.name", "t.import_path", "t.alias", F.col("t.start_line").alias("line_number"))


def list_matches(g: PropertyGraph, term: str, limit: int = 50) -> DataFrame:
    return g.scan(DEFINITION).where(contains_ci(F.col("fqn"), term)).orderBy("fqn", "id").limit(limit).select("fqn", "name", "definition_type", F.col("primary_file_path").alias("file_path"), F.col("start_line").alias("line_number"))


def initial_graph(g: PropertyGraph, limit: int = 100) -> DataFrame:
    """Nodes and edges to draw first: up to ``limit`` edges of each pair, in the wide form."""
    return g.sections(RELS, limit)


def neighbours(g: PropertyGraph, label: str, node_id: int, limit: int = 100) -> DataFrame:
    """Edges at one node with both ends, in the wide form."""
    if label not in NODES:
        raise ValueError(f"invalid_node_type: {label}")
    rels = [r for r in RELS if label in (r.source, r.target)]
    return g.sections(rels, None, node_id, label).orderBy("order_priority", "source_id", "target_id", "relationship_id").limit(limit)


def unique_nodes(drawn: DataFrame, columns: list[str] = WIDE) -> DataFrame:
    """The nodes of a drawn graph, once each by label and id, in one pass over its edges; ``columns`` hold both."""
    ends = F.array(*[F.struct(*[F.col(p + c).alias(c) for c in columns]) for p in ("source_", "target_")])
    return drawn.select(F.explode(ends).alias("n")).select("n.*").dropDuplicates(["type", "id"])


def search_nodes(g: PropertyGraph, term: str, limit: int = 100) -> DataFrame:
    """Nodes of any label whose name, path, fqn or import path holds ``term``, in the wide form."""
    if not term:
        raise ValueError("empty_search_term")
    fields = {DIRECTORY: ["name", "path"], FILE: ["name", "path"], DEFINITION: ["name", "fqn"], IMPORT: ["name", "import_path", "alias"]}
    parts = [g.scan(n).where(reduce(Column.__or__, [contains_ci(F.col(c), term) for c in cs])).select(*wide(n)) for n, cs in fields.items()]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy("type", "name", "id").limit(limit)


def search_definitions(g: PropertyGraph, terms: list[str], number: int = 1, size: int = PAGE) -> DataFrame:
    hits = g.scan(DEFINITION).where(any_term(F.col("name"), terms) | any_term(F.col("fqn"), terms))
    return page(hits, ["primary_file_path", "start_line", "id"], number, size).select("name", "fqn", "definition_type", F.col("primary_file_path").alias("file_path"), "start_line", "end_line")


def definitions_in_file(g: PropertyGraph, term: str, path: str) -> DataFrame:
    hits = g.scan(DEFINITION).where((contains_ci(F.col("fqn"), term) | contains_ci(F.col("name"), term)) & (F.col("primary_file_path") == path))
    return hits.orderBy("start_line", "id").select("id", "name", "fqn", F.col("primary_file_path").alias("file_path"), F.col("start_line").alias("line_number"))


def call_relationships(g: PropertyGraph, source: str | None = None, target: str | None = None, types: tuple[str, ...] = REFERENCE_TYPES) -> DataFrame:
    """(source_fqn, target_fqn, type) of call edges, from and to given fqns where they are given."""
    d = g.scan(DEFINITION)
    s = d.where(F.col("fqn") == source) if source else d
    t = d.where(F.col("fqn") == target) if target else d
    return g.expand(DEF_DEF, F.col("type").isin(*types), source=s, target=t).select(F.col("s.fqn").alias("source_fqn"), F.col("t.fqn").alias("target_fqn"), F.col("r.type").alias("type"))


def callers(g: PropertyGraph, fqn: str, limit: int | None = None) -> DataFrame:
    out = call_relationships(g, target=fqn).select(F.col("source_fqn").alias("fqn")).distinct().orderBy("fqn")
    return out.limit(limit) if limit else out


def callees(g: PropertyGraph, fqn: str, limit: int | None = None) -> DataFrame:
    out = call_relationships(g, source=fqn).select(F.col("target_fqn").alias("fqn")).distinct().orderBy("fqn")
    return out.limit(limit) if limit else out


def callers_of_import(g: PropertyGraph, import_path: str, name: str | None = None) -> DataFrame:
    t = g.scan(IMPORT).where(F.col("import_path") == import_path)
    if name:
        t = t.where(F.col("name") == name)
    return g.expand(DEF_IMP, F.col("type") == "CALLS", target=t).select(F.col("s.fqn").alias("fqn")).distinct()


def references(g: PropertyGraph, name: str, path: str | None = None, number: int = 1, size: int = PAGE) -> DataFrame:
    """Who refers to the definitions of a name: nine columns, a page."""
    t = g.scan(DEFINITION).where(F.col("name") == name)
    if path:
        t = t.where(F.col("primary_file_path") == path)
    x = g.expand(DEF_DEF, F.col("type").isin(*REFERENCE_TYPES), target=t)
    rows = x.select(
        F.col("s.fqn").alias("fqn"), F.col("s.name").alias("name"), F.col("s.definition_type").alias("definition_type"), F.col("s.primary_file_path").alias("file_path"),
        F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"), F.coalesce("r.call_line", "r.source_start_line").alias("call_line"), F.col("r.type").alias("relationship_type"), F.col("t.fqn").alias("target_fqn"), F.col("r.edge_id").alias("edge_id"),
    )
    return page(rows, ["file_path", "start_line", "fqn", "call_line", "target_fqn", "edge_id"], number, size).drop("edge_id")


def get_definition(g: PropertyGraph, path: str, line: int, start: int, end: int, limit: int = 100) -> DataFrame:
    """What a symbol at a place of a file refers to: calls of definitions and of the file itself, called and declared imports.

    Places are 0-based; a symbol matches the edges whose range holds it.
    """
    here = (F.col("source_start_line") <= line) & (F.col("source_end_line") >= line) & (F.col("source_start_col") <= start) & (F.col("source_end_col") >= end) & F.col("type").isin(*REFERENCE_TYPES)
    own, files = g.scan(DEFINITION).where(F.col("primary_file_path") == path), g.scan(FILE).where(F.col("path") == path)

    def shown(x: DataFrame, target: str, kind: str) -> DataFrame:
        d = target == DEFINITION
        out = x.select(
            F.col("t.id").alias("id"), F.lit(target).alias("node_type"), F.col("t.name").alias("name"), F.col("t.fqn" if d else "t.import_path").alias("fqn"), F.col("t.primary_file_path" if d else "t.file_path").alias("file_path"),
            F.col("t.start_line").alias("start_line"), F.col("t.end_line").alias("end_line"), F.col("r.type").alias("relationship_type"), F.lit(kind).alias("found_by"), (F.col("r.source_end_col") - F.col("r.source_start_col")).alias("width"),
        )
        return out.orderBy("width", "id", "start_line").limit(limit)

    parts = [
        shown(g.expand(DEF_DEF, here, source=own), DEFINITION, "definition"),
        shown(g.expand(FILE_DEF, here, source=files), DEFINITION, "file"),
        shown(g.expand(DEF_IMP, here, source=own), IMPORT, "imported"),
        shown(g.expand(FILE_IMP, here, source=files), IMPORT, "file_imported"),
    ]
    return reduce(DataFrame.unionByName, parts)


def best_definition(found: DataFrame) -> DataFrame:
    """One row a node: the narrowest match."""
    return first_by(found, ["node_type", "id"], [F.col("width"), F.col("found_by")])


def read_definitions(g: PropertyGraph, asked: DataFrame) -> DataFrame:
    """Definitions for (name, file_path) pairs, all in one join."""
    d = g.scan(DEFINITION).select(F.col("name"), F.col("primary_file_path").alias("file_path"), "fqn", "definition_type", "start_line", "end_line", "id")
    return d.join(asked.distinct(), ["name", "file_path"]).orderBy("file_path", "start_line", "id").select("name", "file_path", "fqn", "definition_type", "start_line", "end_line")


def repo_map(g: PropertyGraph, paths: list[str], number: int = 1, size: int = PAGE) -> DataFrame:
    rows = g.get_by(DEFINITION, "primary_file_path", paths)
    return page(rows, ["primary_file_path", "start_line", "id"], number, size, 200).select(F.col("primary_file_path").alias("file_path"), "fqn", "definition_type", "start_line", "end_line")
