"""Ruby by statement keywords and their ``end``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .model import Item

_BLANK = re.compile(r"#(?!\{)[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|^=begin.*?^=end[^\n]*", re.S | re.M)
_OPEN = re.compile(r"^\s*(class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
_CLASS = re.compile(r"^\s*class\s+(?!<<)(?P<n>[A-Z][\w:]*)(?:\s*<\s*(?P<p>[\w:]+))?")
_MODULE = re.compile(r"^\s*module\s+(?P<n>[A-Z][\w:]*)")
_DEF = re.compile(r"^\s*(?:(?:private|protected|public|private_class_method)\s+)?def\s+(?P<self>self\.|[A-Z]\w*\.)?(?P<n>[\w]+[?!=]?|[+\-*/%<>=!~^&|\[\]]+)")
_LAMBDA = re.compile(r"^\s*(?P<n>\w+)\s*=\s*(?P<k>lambda\b|->|Proc\.new\b|proc\b)")
_ASSIGN = re.compile(r"(?P<v>@{0,2}[a-z_]\w*)\s*(?:\|\|)?=\s*(?P<t>[A-Z][\w:]*)(?:\.(?P<m>\w+))?")
_CALL = re.compile(r"(?P<r>(?:@{0,2}[A-Za-z_][\w:]*(?:\([^()]*\))?(?:\.|&\.|::))+)(?P<n>[a-z_]\w*[?!]?)|(?<![\w.:@])(?P<f>[a-z_]\w*[?!]?)(?=\()")
_REQUIRE = re.compile(r"^\s*(?P<k>require|require_relative|load|autoload)\s*\(?\s*(?::\w+\s*,\s*)?['\"](?P<p>[^'\"]+)['\"]")
_INCLUDE = re.compile(r"^\s*(?:include|extend|prepend)\s+(?P<n>[A-Z][\w:]*)")
_WORDS = set("if unless while until case begin end def class module return puts print p raise require require_relative yield super and or not do then else elsif when in self nil true false lambda proc".split())


def extract(text: str) -> Iterator[Item]:
    clean = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    stack: list[list] = []  # [kind, item or None, scope before]
    scope, at = "", 0
    done: list[Item] = []
    types: dict[tuple[str, str], str] = {}
    owners: list[Item] = []
    for line, raw in zip(clean.split("\n"), text.split("\n"), strict=True):
        start = at + len(line) - len(line.lstrip())
        if m := _REQUIRE.match(raw):
            if line.strip():
                kind = {"require": "Require", "require_relative": "RequireRelative", "load": "Load", "autoload": "Autoload"}[m["k"]]
                yield Item("import", kind, m["p"].rsplit("/", 1)[-1], "", start, at + len(raw.rstrip()), path=m["p"])
        item = None
        if m := _CLASS.match(line):
            fqn = f"{scope}::{m['n']}" if scope else m["n"]
            item = Item("definition", "Class", m["n"].rsplit("::", 1)[-1], fqn, start, -1, scope=scope, extra={"bases": m["p"] or ""})
        elif m := _MODULE.match(line):
            fqn = f"{scope}::{m['n']}" if scope else m["n"]
            item = Item("definition", "Module", m["n"].rsplit("::", 1)[-1], fqn, start, -1, scope=scope)
        elif m := _DEF.match(line):
            single = bool(m["self"]) or any(s[0] == "class<<" for s in stack)
            fqn = f"{scope}{'::' if single else '#'}{m['n']}" if scope else m["n"]
            item = Item("definition", "SingletonMethod" if single else "Method", m["n"], fqn, start, -1, scope=scope)
        elif m := _LAMBDA.match(line):
            fqn = f"{scope}::{m['n']}" if scope else m["n"]
            done.append(Item("definition", "Lambda" if m["k"] in ("lambda", "->") else "Proc", m["n"], fqn, start, at + len(line.rstrip()), scope=scope))
        if (m := _INCLUDE.match(line)) and owners and owners[-1].type in ("Class", "Module"):
            owners[-1].extra["mixins"] = ",".join(filter(None, [owners[-1].extra.get("mixins", ""), m["n"]]))
        inside = owners[-1].fqn if owners else ""
        for m in _ASSIGN.finditer(line):
            key = (scope if m["v"].startswith("@") else inside, m["v"])
            types.setdefault(key, m["t"] if m["m"] in (None, "new") else "")
        if item is None:
            for m in _CALL.finditer(line):
                name = m["n"] or m["f"]
                if name in _WORDS and not m["n"]:
                    continue
                receiver = (m["r"] or "").rstrip(".:&")
                head = re.split(r"\.|&\.", receiver)[0].split("(")[0] if receiver else ""
                kind = head if head[:1].isupper() else types.get((inside, head)) or types.get((scope, head)) or ""
                pos = at + m.start("n" if m["n"] else "f")
                done.append(Item("reference", "Call", name, f"{receiver}.{name}" if receiver else name, pos, pos + len(name), scope=inside, receiver=receiver, extra={"type": kind, "self": scope}))
        if re.match(r"\s*end\b", line) and stack:
            kind, closed, scope = stack.pop()
            if closed is not None:
                closed.end = at + line.index("end") + 3
                owners.remove(closed)
                done.append(closed)
        elif re.match(r"\s*class\s*<<", line):
            stack.append(["class<<", None, scope])
        elif _OPEN.search(line) and not re.search(r"\bend\b", line) and not re.match(r"\s*def\s+[^=]*\)?\s*=\s", line):
            stack.append(["", item, scope])
            if item is not None:
                owners.append(item)
                if item.type in ("Class", "Module"):
                    scope = item.fqn
        elif item is not None:
            item.end = at + len(line.rstrip())
            done.append(item)
        at += len(raw) + 1
    for _, closed, _ in stack:
        if closed is not None:  # an unfinished file
            closed.end = len(text)
            done.append(closed)
    yield from sorted(done, key=lambda x: (x.start, x.kind))
