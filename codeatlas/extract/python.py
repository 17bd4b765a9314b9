"""Python through the standard library's parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from .model import Item


def _part(name: str) -> str:
    return name.replace(".", "#")


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        inner = _dotted(node.func)
        return None if inner is None else ".".join([inner + "()", *reversed(parts)])
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def extract(text: str) -> Iterator[Item]:
    tree = ast.parse(text)
    starts, raw = [0], text.split("\n")
    for line in raw:
        starts.append(starts[-1] + len(line) + 1)

    def offset(line: int, col: int) -> int:
        row = raw[line - 1]
        return starts[line - 1] + (col if row.isascii() else len(row.encode()[:col].decode("utf-8", "ignore")))

    def span(n: ast.AST) -> tuple[int, int]:
        return offset(n.lineno, n.col_offset), offset(n.end_lineno, n.end_col_offset)

    def visit(nodes, scope: list[str], inside: str, kinds: dict[str, str]) -> Iterator[Item]:
        for n in nodes:
            if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                decorated = "Decorated" if n.decorator_list else ""
                if isinstance(n, ast.ClassDef):
                    kind = decorated + "Class"
                else:
                    kind = decorated + ("Async" if isinstance(n, ast.AsyncFunctionDef) else "") + ("Method" if inside == "class" else "Function")
                own = [*scope, _part(n.name)]
                bases = ",".join(filter(None, (_dotted(b) for b in n.bases))) if isinstance(n, ast.ClassDef) else ""
                yield Item("definition", kind, n.name, ".".join(own), *span(n), scope=".".join(scope), extra={"bases": bases})
                for d in n.decorator_list:
                    yield from visit([d], scope, inside, kinds)
                yield from visit(n.body, own, "class" if isinstance(n, ast.ClassDef) else "function", {})
                continue
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Lambda) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                own = [*scope, _part(n.targets[0].id)]
                yield Item("definition", "Lambda", n.targets[0].id, ".".join(own), *span(n), scope=".".join(scope))
                yield from visit([n.value.body], own, "function", {})
                continue
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and (t := _dotted(n.value.func)):
                kinds[n.targets[0].id] = t  # x = Name(...): later x.m() may be a method of Name
            if isinstance(n, ast.Import):
                for a in n.names:
                    yield Item("import", "AliasedImport" if a.asname else "Import", a.name if not a.asname else a.name, "", *span(n), scope=".".join(scope), path=a.name, alias=a.asname or "")
            elif isinstance(n, ast.ImportFrom):
                path = "." * n.level + (n.module or "")
                for a in n.names:
                    kind = "FutureImport" if n.module == "__future__" else "WildcardImport" if a.name == "*" else "AliasedFromImport" if a.asname else "FromImport"
                    yield Item("import", kind, a.name, "", *span(n), scope=".".join(scope), path=path, alias=a.asname or "")
            if isinstance(n, ast.Call) and (target := _dotted(n.func)) is not None:
                head, _, rest = target.partition(".")
                extra = {"type": kinds.get(head, "")} if rest else {}
                yield Item("reference", "Call", target.rsplit(".", 1)[-1], target, *span(n.func), scope=".".join(scope), receiver=target.rpartition(".")[0], extra=extra)
            yield from visit(ast.iter_child_nodes(n), scope, inside, kinds)

    yield from visit(tree.body, [], "module", {})
