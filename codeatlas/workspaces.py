"""Workspaces: from a folder to stored graphs, with their catalog, events and followers."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from . import __name__ as _package
from .extract import extract
from .graph import PropertyGraph
from .incremental import Store
from .plans.tools import list_projects
from .resolve import build_graph
from .sources import files as src
from .sources.manifest import Manifest, project_hash
from .streaming.events import EventLog

Answer = tuple[int, dict]


class Workspaces:
    """Indexes the projects of folders; ``data`` holds the catalog, the events and a store for each project."""

    def __init__(self, spark: SparkSession, data: str):
        self.spark, self.data = spark, data.rstrip("/")
        self.manifest, self.events = Manifest(self.data), EventLog(spark, f"{self.data}/events")

    def store(self, project: str) -> Store:
        return Store(self.spark, f"{self.data}/{project_hash(project)}")

    def graph(self, project: str) -> PropertyGraph | None:
        """The current graph of a project; None if there is none."""
        store = self.store(os.path.realpath(project))
        return store.read() if store.current() else None

    def index_project(self, workspace: str, project: str) -> str:
        """Read, extract, resolve and store one project; the version that is current then."""
        known = self.store(project).current()
        self.manifest.set_status(workspace, project, "reindexing" if known else "indexing")
        try:
            with self.events.record("project_reindexing" if known else "project_indexing", workspace, project):
                files = src.with_language(src.read_tracked(self.spark, project)).where("status = 'ok' AND language IS NOT NULL")
                version = self.store(project).commit(build_graph(files, extract(files), os.path.basename(project), project))
                self.store(project).clean()
        except Exception as e:
            self.manifest.set_status(workspace, project, "error", str(e)[:500])
            raise
        self.manifest.set_status(workspace, project, "indexed")
        return version

    # -- what a server answers: (status, body) ------------------------------------------------------

    def index(self, folder: str) -> Answer:
        """Register a folder's projects and index them all."""
        if not os.path.isdir(folder):
            return 400, {"status": "invalid_workspace_path"}
        workspace = os.path.realpath(folder)
        projects = self.manifest.register(folder)
        if not projects:
            return 400, {"status": "no_projects_found_in_workspace"}
        for p in projects:
            self.index_project(workspace, p)
        return 200, self._shown(workspace)

    def delete(self, folder: str) -> Answer:
        workspace = os.path.realpath(folder)
        own = [p for w, p, _ in self.manifest.projects() if w == workspace]
        if not own:
            return 404, {"status": "workspace_not_found"}
        for p in own:
            self.store(p).remove()
        self.manifest.remove(workspace)
        return 200, {"status": "deleted", "projects": len(own)}

    def list(self) -> Answer:
        return 200, {"workspaces": [self._shown(w) for w in dict.fromkeys(w for w, _, _ in self.manifest.projects())]}

    def _shown(self, workspace: str) -> dict:
        own = [(p, e) for w, p, e in self.manifest.projects() if w == workspace]
        return {"workspace_folder_path": workspace, "status": self.manifest.status(workspace), "project_count": len(own), "projects": [{"project_path": p, **e} for p, e in own]}

    def info(self) -> Answer:
        return 200, {"name": _package, "spark": self.spark.version}

    def health(self) -> Answer:
        return 200, {"status": "ok"} if self.spark.range(1).count() == 1 else {"status": "error"}

    # -- agent tools ----------------------------------------------------------------------------------

    def list_projects(self) -> str:
        return list_projects(self.manifest)


class Followers:
    """One streaming query for each followed project, started and stopped as the catalog says."""

    def __init__(self, manifest: Manifest, start: Callable[[str], StreamingQuery]):
        self.manifest, self.start, self.running = manifest, start, {}

    def reconcile(self) -> tuple[list[str], list[str]]:
        """(started, stopped): queries of projects that are newly followed, and of those that no longer are or have ended."""
        wanted = set(self.manifest.watched())
        gone = sorted(p for p, query in self.running.items() if p not in wanted or not query.isActive)
        for p in gone:
            self.running.pop(p).stop()
        new = sorted(wanted - set(self.running))
        for p in new:
            self.running[p] = self.start(p)
        return new, gone

    def stop(self) -> None:
        for query in self.running.values():
            query.stop()
        self.running.clear()
