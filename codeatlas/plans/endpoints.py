"""Graph endpoints: bounded results as dictionaries (status, body), with the codes of their refusals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.aggregates import node_counts, relationship_counts
from ..schema import NODES, WIDE
from . import library as q

#: Fields a label's node shows besides id, type and name.
_SHOWN = {
    "DirectoryNode": ("path", "absolute_path", "repository_name"),
    "FileNode": ("path", "absolute_path", "repository_name", "language", "extension"),
    "DefinitionNode": ("fqn", "definition_type", "primary_file_path", "start_line", "end_line", "total_locations"),
    "ImportedSymbolNode": ("import_type", "import_path", "alias", "primary_file_path", "start_line", "end_line"),
}
INITIAL_LIMIT, NEIGHBOUR_LIMIT, SEARCH_LIMIT = 100, 100, 100


class Refusal(Exception):
    def __init__(self, status: int, code: str):
        super().__init__(code)
        self.status, self.code = status, code


class Endpoints:
    """``projects`` finds a graph by project path (None: unknown)."""

    def __init__(self, projects: Callable[[str], PropertyGraph | None]):
        self.projects = projects

    def _graph(self, project: str) -> PropertyGraph:
        if not project:
            raise Refusal(400, "empty_project_path")
        if (g := self.projects(project)) is None:
            raise Refusal(404, "project_not_found")
        return g

    def _answer(self, make: Callable[[], dict]) -> tuple[int, dict]:
        try:
            return 200, make()
        except Refusal as r:
            return r.status, {"error": r.code}

    @staticmethod
    def _node(row: dict) -> dict:
        return {"id": f"{row['type']}_{row['id']}", "node_type": row["type"], "label": row["name"] or row["import_path"], "properties": {c: row[c] for c in _SHOWN[row["type"]]}}

    def _drawn(self, drawn: DataFrame) -> dict:
        drawn = drawn.persist()  # a bounded page, read twice
        try:
            nodes = [self._node(r.asDict()) for r in q.unique_nodes(drawn).orderBy("type", "id").collect()]
            edges = drawn.dropDuplicates(["relationship_id"]).orderBy("order_priority", "relationship_id").collect()
        finally:
            drawn.unpersist()
        shown = [{"id": r["relationship_id"], "source": f"{r['source_type']}_{r['source_id']}", "target": f"{r['target_type']}_{r['target_id']}", "relationship_name": r["relationship_name"], "relationship_type": r["relationship_type"]} for r in edges]
        return {"nodes": nodes, "relationships": shown}

    def initial(self, project: str, limit: int = INITIAL_LIMIT) -> tuple[int, dict]:
        return self._answer(lambda: self._drawn(q.initial_graph(self._graph(project), limit)))

    def neighbours(self, project: str, node_type: str, node_id: int, limit: int = NEIGHBOUR_LIMIT) -> tuple[int, dict]:
        def make() -> dict:
            g = self._graph(project)
            if node_type not in NODES:
                raise Refusal(400, "invalid_node_type")
            return self._drawn(q.neighbours(g, node_type, node_id, limit))

        return self._answer(make)

    def search(self, project: str, term: str, limit: int = SEARCH_LIMIT) -> tuple[int, dict]:
        def make() -> dict:
            g = self._graph(project)
            if not term.strip():
                raise Refusal(400, "empty_search_term")
            rows = q.search_nodes(g, term.strip(), limit).select(*WIDE).collect()
            return {"nodes": [self._node(r.asDict()) for r in rows]}

        return self._answer(make)

    def stats(self, project: str) -> tuple[int, dict]:
        def make() -> dict:
            g = self._graph(project)
            nodes, edges = node_counts(g).first().asDict(), relationship_counts(g).first().asDict()
            return {"nodes": nodes, "total_nodes": sum(nodes.values()), "relationships": {k: v for k, v in edges.items() if k != "total"}, "total_relationships": edges["total"]}

        return self._answer(make)


def by_file(rows: DataFrame, path: str = "file_path") -> DataFrame:
    """Rows grouped by file, sorted within, as JSON."""
    rest = [c for c in rows.columns if c != path]
    return rows.groupBy(path).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rest)))).alias("items"))
