"""The catalog of workspaces and projects: one JSON document, written by staged rename."""

from __future__ import annotations

import hashlib
import json
import os
import time
from pathlib import Path

STATUSES = ("indexed", "indexing", "reindexing", "error", "pending")


def project_hash(path: str) -> str:
    """The first 16 hex digits of the SHA-256 of the canonical path."""
    return hashlib.sha256(os.path.realpath(path).encode()).hexdigest()[:16]


class Manifest:
    def __init__(self, folder: str):
        self.file = Path(folder) / "manifest.json"

    def _read(self) -> dict:
        return json.loads(self.file.read_text()) if self.file.exists() else {}

    def _write(self, data: dict) -> None:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        staged = self.file.with_suffix(".new")
        staged.write_text(json.dumps(data, indent=2, sort_keys=True))
        staged.replace(self.file)

    def register(self, workspace: str) -> list[str]:
        """Find the git projects at or below a folder and register them; known ones keep their state."""
        workspace = os.path.realpath(workspace)
        found = sorted(str(p.parent) for p in Path(workspace).rglob(".git")) or []
        data = self._read()
        projects = data.setdefault(workspace, {})
        for p in found:
            projects.setdefault(p, {"project_hash": project_hash(p), "status": "pending", "last_indexed_at": None, "error_message": None})
        self._write(data)
        return found

    def set_status(self, workspace: str, project: str, status: str, error: str | None = None) -> None:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status}")
        data = self._read()
        entry = data[os.path.realpath(workspace)][os.path.realpath(project)]
        entry |= {"status": status, "error_message": error} | ({"last_indexed_at": time.time()} if status == "indexed" else {})
        self._write(data)

    def status(self, workspace: str) -> str:
        kinds = {p["status"] for p in self._read().get(os.path.realpath(workspace), {}).values()}
        return next((s for s in ("error", "indexing", "reindexing") if s in kinds), "indexed" if kinds == {"indexed"} else "pending")

    def projects(self, *status: str) -> list[tuple[str, str, dict]]:
        """(workspace, project, entry) of all projects, or of those with one of the statuses."""
        return [(w, p, e) for w, ps in sorted(self._read().items()) for p, e in sorted(ps.items()) if not status or e["status"] in status]

    def watched(self) -> list[str]:
        """The projects that are followed: indexed ones, also while they are indexed again."""
        return [p for _, p, _ in self.projects("indexed", "reindexing")]

    def owner(self, path: str) -> str | None:
        """The most specific project a path lies in."""
        path = os.path.realpath(path)
        return max((p for _, p, _ in self.projects() if path == p or path.startswith(p + os.sep)), key=len, default=None)

    def remove(self, workspace: str) -> None:
        data = self._read()
        data.pop(os.path.realpath(workspace), None)
        self._write(data)
