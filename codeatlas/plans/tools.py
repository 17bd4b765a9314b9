"""Agent tools over a graph and its file texts (path, text): search, references, usage, definitions, repository maps.

Each tool plans one query with its snippets joined in, collects one page, and renders it. Lines are shown from 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import occurrences
from ..graph import PropertyGraph
from ..operators.text import read_ranges
from ..schema import DEFINITION, FILE
from . import library as q
from .render import Xml, definitions, tree


#: Rows of one package's usage; files that a tree draws (it says how many more there are).
USAGES, DRAWN = 500, 1000


class ToolError(ValueError):
    """A refusal with a code: empty_project_path, empty_search_term, invalid_node_type, invalid_line."""


def list_projects(manifest) -> str:
    """The registered projects of a catalog."""
    x = Xml().start("ToolResponse").start("projects")
    for _, path, _ in manifest.projects():
        x.text("project_path", path)
    return str(x.end().end())


@dataclass
class Tools:
    graph: PropertyGraph
    texts: DataFrame

    def _page(self, rows: DataFrame, size: int) -> tuple[list, bool]:
        got = rows.collect()  # at most size + 1 rows
        return got[:size], len(got) > size

    def _more(self, x: Xml, page: int, more: bool) -> str:
        x.text("next-page", page + 1 if more else "")
        return str(x.end())

    def _with_text(self, rows: DataFrame, first, last) -> DataFrame:
        asked = rows.withColumn("_i", F.monotonically_increasing_id()).select("*", F.col("file_path").alias("path"), first.cast("int").alias("start"), last.cast("int").alias("end"))
        return read_ranges(self.texts, asked).orderBy("_i").drop("_i", "path", "start", "end")

    def search_definitions(self, terms: list[str], page: int = 1, size: int = 50) -> str:
        if not [t for t in terms if t.strip()]:
            raise ToolError("empty_search_term")
        hits = self.graph.scan(DEFINITION).where(q.any_term(F.col("name"), terms) | q.any_term(F.col("fqn"), terms))
        rows = hits.orderBy("primary_file_path", "start_line", "id").offset((max(1, page) - 1) * size).limit(size + 1).select("name", "fqn", "definition_type", F.col("primary_file_path").alias("file_path"), "start_line", "end_line")
        got, more = self._page(self._with_text(rows, F.col("start_line") + 1, F.least(F.col("start_line") + 4, F.col("end_line") + 1)), size)
        x = Xml().start("definitions")
        for r in got:
            x.start("definition", name=r["name"], fqn=r["fqn"], type=r["definition_type"], location=f"{r['file_path']}:L{r['start_line'] + 1}-{r['end_line'] + 1}")
            x.text("context", r["chunk"] if r["error"] is None else r["error"], cdata=True).end()
        return self._more(x, page, more)

    def get_references(self, name: str, path: str | None = None, page: int = 1, size: int = 50) -> str:
        rows = q.references(self.graph, name, path, 1, page * size + 1).offset((max(1, page) - 1) * size)
        place = F.coalesce("call_line", "start_line") + 1
        got, more = self._page(self._with_text(rows, F.greatest(place - 2, F.col("start_line") + 1), F.least(place + 2, F.col("end_line") + 1)), size)
        x, groups = Xml().start("references"), {}
        for r in got:
            groups.setdefault((r["fqn"], r["file_path"], r["start_line"], r["end_line"]), []).append(r)
        for (fqn, file, s, e), calls in groups.items():
            x.start("reference", fqn=fqn, location=f"{file}:L{s + 1}-{e + 1}")
            for r in calls:
                x.text("context", r["chunk"] if r["error"] is None else r["error"], cdata=True)
            x.end()
        return self._more(x, page, more)

    def import_usage(self, packages: list[dict], page: int = 1, size: int = 50) -> str:
        """Usage of packages, each {"import_path", "name"?, "alias"?}, by file."""
        parts = [q.import_usage(self.graph, p["import_path"], p.get("name"), p.get("alias")) for p in packages]
        all_ = q.reduce(DataFrame.unionByName, [p.orderBy("file_path", "import_start_line", "ref_file", "ref_start_line", "edge_id").limit(USAGES) for p in parts])
        files = all_.select(F.coalesce("ref_file", "file_path").alias("file")).union(all_.select("file_path")).distinct().orderBy("file").offset((max(1, page) - 1) * size).limit(size + 1)
        names, more = self._page(files, size)
        shown = [r["file"] for r in names]
        rows = all_.where(F.col("file_path").isin(shown) | F.col("ref_file").isin(shown)).drop("edge_id").distinct().orderBy("file_path", "import_start_line", "ref_file", "ref_start_line").collect() if shown else []
        x = Xml().start("import-usage")
        for f in shown:
            x.start("file", path=f)
            for path, name, line in sorted({(r["import_path"], r["name"], r["import_start_line"]) for r in rows if r["file_path"] == f}):
                x.text("import", f"{path} {name} L{line + 1}")
            for fqn, a, b in sorted({(r["ref_fqn"] or "", r["ref_start_line"], r["ref_end_line"]) for r in rows if r["ref_file"] == f and r["ref_start_line"] is not None}):
                x.text("usage", f"{fqn} L{a + 1}-{(b if b is not None else a) + 1}")
            x.end()
        return self._more(x, page, more)

    def get_definition(self, path: str, line_text: str, symbol: str) -> str:
        """Definitions that a symbol on a line of a file refers to; the line is given by its text."""
        lines = self.texts.where(F.col("path") == path).select(F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).where(F.trim("text") == line_text.strip())
        places = lines.select("line", F.explode(occurrences(F.col("text"), symbol)).alias("o")).select("line", "o.start", "o.end").orderBy("line", "start").limit(100).collect()
        if not places:
            raise ToolError("invalid_line")
        found = q.reduce(DataFrame.unionByName, [q.get_definition(self.graph, path, p["line"], p["start"], p["end"] + 1) for p in places])
        rows = q.best_definition(found).orderBy("file_path", "start_line", "id").limit(100)
        x = Xml().start("definitions")
        for r in self._with_text(rows, F.col("start_line") + 1, F.col("end_line") + 1).collect():
            x.start("definition", name=r["name"], fqn=r["fqn"], kind=r["node_type"], location=f"{r['file_path']}:L{r['start_line'] + 1}-{r['end_line'] + 1}").text("code", r["chunk"] if r["error"] is None else r["error"], cdata=True).end()
        return str(x.end())

    def read_definitions(self, asked: list[tuple[str, str]]) -> str:
        given = self.graph.spark.createDataFrame(asked, "name string, file_path string")
        x = Xml().start("definitions")
        for r in self._with_text(q.read_definitions(self.graph, given), F.col("start_line") + 1, F.col("end_line") + 1).collect():
            x.start("definition", name=r["name"], fqn=r["fqn"], type=r["definition_type"], location=f"{r['file_path']}:L{r['start_line'] + 1}-{r['end_line'] + 1}").text("body", r["chunk"] if r["error"] is None else r["error"], cdata=True).end()
        return str(x.end())

    def repo_map(self, under: str = "", depth: int = 3, page: int = 1, size: int = 50) -> str:
        """A tree of the files up to ``depth`` levels below a folder, and their definitions, a page."""
        size, lead = min(size, 200), under.rstrip("/") + "/" if under else ""
        files = self.graph.scan(FILE).where(F.startswith("path", F.lit(lead)) & (F.size(F.split(F.substring(F.col("path"), len(lead) + 1, 1 << 30), "/")) <= min(depth, 3)))
        n, paths = files.count(), [r["path"] for r in files.select("path").orderBy("path").limit(DRAWN).collect()]
        of = self.graph.scan(DEFINITION).join(files.select(F.col("path").alias("primary_file_path")), "primary_file_path", "left_semi")
        rows = of.orderBy("primary_file_path", "start_line", "id").offset((max(1, page) - 1) * size).limit(size + 1)
        rows = rows.select(F.col("primary_file_path").alias("file_path"), "fqn", "definition_type", "start_line", "end_line")
        got, more = self._page(self._with_text(rows, F.col("start_line") + 1, F.least(F.col("start_line") + 3, F.col("end_line") + 1)), size)
        code = {(r["file_path"], r["start_line"]): (r["chunk"] or "").split("\n")[:-1] for r in got}
        drawn = tree([p[len(lead):] for p in paths], under or ".") + (f"\n({n - len(paths)} more files)" if n > len(paths) else "")
        x = Xml().start("repo-map").text("tree", drawn, cdata=True).text("definitions", definitions([r.asDict() for r in got], code), cdata=True)
        return self._more(x, page, more)
