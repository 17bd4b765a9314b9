"""Rendering of bounded results: directory trees, definition lists and XML. Pure Python on collected pages."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr


def tree(paths: Iterable[str], root: str = ".") -> str:
    """An ASCII tree; folders first at each level, both in order of name."""
    top: dict = {}
    for p in paths:
        at = top
        *folders, name = p.split("/")
        for f in folders:
            at = at.setdefault(f, {})
        at.setdefault(name, None)
    out = [root]

    def walk(node: dict, lead: str) -> None:
        items = sorted(node.items(), key=lambda x: (x[1] is None, x[0]))
        for i, (name, below) in enumerate(items):
            last = i == len(items) - 1
            out.append(f"{lead}{'└── ' if last else '├── '}{name}{'' if below is None else '/'}")
            if below is not None:
                walk(below, lead + ("    " if last else "│   "))

    walk(top, "")
    return "\n".join(out)


def definitions(rows: Iterable[dict], snippets: dict[tuple[str, int], list[str]] | None = None, most: int = 3) -> str:
    """``type fqn Lx-y`` by file with up to ``most`` snippet lines; lines are shown from 1, each once a file."""
    out, file, seen = [], None, set()
    for r in rows:
        if r["file_path"] != file:
            file, seen = r["file_path"], set()
            out.append(file)
        out.append(f"  {r['definition_type']} {r['fqn']} L{r['start_line'] + 1}-{r['end_line'] + 1}")
        for i, line in enumerate((snippets or {}).get((file, r["start_line"]), [])[:most]):
            if (n := r["start_line"] + i) not in seen:
                seen.add(n)
                out.append(f"  │ {line}")
    return "\n".join(out)


class Xml:
    """A small XML writer with CDATA."""

    def __init__(self) -> None:
        self.out, self.open = [], []

    def start(self, tag: str, **attributes) -> "Xml":
        self.out.append("  " * len(self.open) + f"<{tag}{''.join(f' {k}={quoteattr(str(v))}' for k, v in attributes.items())}>")
        self.open.append(tag)
        return self

    def end(self) -> "Xml":
        tag = self.open.pop()
        self.out.append("  " * len(self.open) + f"</{tag}>")
        return self

    def text(self, tag: str, value: object, cdata: bool = False) -> "Xml":
        s = "" if value is None else str(value)
        body = "<![CDATA[" + s.replace("]]>", "]]]]><![CDATA[>") + "]]>" if cdata else escape(s)
        self.out.append("  " * len(self.open) + f"<{tag}>{body}</{tag}>")
        return self

    def __str__(self) -> str:
        return "\n".join(self.out)
