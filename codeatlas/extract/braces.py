"""Java, Kotlin, C#, Rust and TypeScript by a tokenizer and brace matching.

Comments and strings are blanked, keeping offsets; headers before an opening brace (or a semicolon, for
members without a body) are matched by one rule table a language; braces give ranges and nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..resolve.rules import KOTLIN_BINARY
from .model import Item

_ID = r"[A-Za-z_$][\w$]*"
_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|`(?:\\.|[^`\\])*`", re.S)
_BLANK_JS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_NOT_CALLS = set("if for while switch catch return new function super this throw typeof instanceof when synchronized using lock match else do try fn fun sizeof await yield import delete void in of is as".split())


def blank(text: str, language: str) -> str:
    """The text with comments and string contents as spaces (newlines stay)."""
    def hide(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0])

    return (_BLANK_JS if language == "TypeScript" else _BLANK).sub(hide, text)


# Fixed values, by language: (definition type, pattern of the header; group n is the name), in order of trial.
_MODS = r"(?:@" + _ID + r"(?:\([^)]*\))?\s*|\b(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|suspend|inline|operator|infix|data|value|annotation|inner|enum|partial|readonly|default|native|synchronized|const|lateinit|tailrec|external|strictfp|extern|unsafe|export|declare|pub(?:\([^)]*\))?)\b\s*)*"
RULES = {
    "Java": [
        ("AnnotationDeclaration", rf"{_MODS}@interface\s+(?P<n>{_ID})"),
        ("Enum", rf"{_MODS}\benum\s+(?P<n>{_ID})"),
        ("Record", rf"{_MODS}\brecord\s+(?P<n>{_ID})\s*(?:<[^>]*>)?\s*\("),
        ("Interface", rf"{_MODS}\binterface\s+(?P<n>{_ID})"),
        ("Class", rf"{_MODS}\bclass\s+(?P<n>{_ID})"),
        ("Constructor", rf"^{_MODS}(?P<n>[A-Z][\w$]*)\s*\([^;{{}}]*\)\s*(?:throws[\w\s.,]+)?$"),
        ("Method", rf"{_MODS}(?:<[^>]+>\s*)?[\w$.<>\[\],? ]+?[\s\]>](?P<n>{_ID})\s*\([^;{{}}]*\)\s*(?:throws[\w\s.,]+)?$"),
    ],
    "Kotlin": [
        ("CompanionObject", rf"{_MODS}\bcompanion\s+object\b\s*(?P<n>{_ID})?"),
        ("Enum", rf"{_MODS}\benum\s+class\s+(?P<n>{_ID})"),
        ("DataClass", rf"(?=.*\bdata\b){_MODS}\bclass\s+(?P<n>{_ID})"),
        ("ValueClass", rf"(?=.*\bvalue\b){_MODS}\bclass\s+(?P<n>{_ID})"),
        ("AnnotationClass", rf"(?=.*\bannotation\b){_MODS}\bclass\s+(?P<n>{_ID})"),
        ("Class", rf"{_MODS}\bclass\s+(?P<n>{_ID})"),
        ("Interface", rf"{_MODS}(?:fun\s+)?\binterface\s+(?P<n>{_ID})"),
        ("Object", rf"{_MODS}\bobject\s+(?P<n>{_ID})"),
        ("Function", rf"{_MODS}\bfun\s+(?:<[^>]*>\s*)?(?:(?P<r>{_ID})(?:<[^>]*>)?\??\.)?(?P<n>{_ID})\s*\("),
    ],
    "CSharp": [
        ("Namespace", rf"\bnamespace\s+(?P<n>[\w.]+)"),
        ("Enum", rf"{_MODS}\benum\s+(?P<n>{_ID})"),
        ("Struct", rf"{_MODS}\bstruct\s+(?P<n>{_ID})"),
        ("Record", rf"{_MODS}\brecord\s+(?:class\s+|struct\s+)?(?P<n>{_ID})"),
        ("Interface", rf"{_MODS}\binterface\s+(?P<n>{_ID})"),
        ("Class", rf"{_MODS}\bclass\s+(?P<n>{_ID})"),
        ("Delegate", rf"{_MODS}\bdelegate\s+[\w<>\[\],.? ]+\s(?P<n>{_ID})\s*\("),
        ("StaticMethod", rf"(?=.*\bstatic\b){_MODS}[\w<>\[\],.? ]+\s(?P<n>{_ID})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?:where[^{{]*)?(?:=>.*)?$"),
        ("Constructor", rf"^{_MODS}(?P<n>[A-Z]\w*)\s*\([^;{{}}]*\)\s*(?::\s*(?:base|this)\s*\([^)]*\)\s*)?$"),
        ("InstanceMethod", rf"{_MODS}[\w<>\[\],.? ]+\s(?P<n>{_ID})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?:where[^{{]*)?(?:=>.*)?$"),
        ("Property", rf"{_MODS}[\w<>\[\],.? ]+\s(?P<n>{_ID})\s*$"),
    ],
    "Rust": [
        ("Module", rf"{_MODS}\bmod\s+(?P<n>{_ID})"),
        ("Struct", rf"{_MODS}\bstruct\s+(?P<n>{_ID})"),
        ("Enum", rf"{_MODS}\benum\s+(?P<n>{_ID})"),
        ("Union", rf"{_MODS}\bunion\s+(?P<n>{_ID})"),
        ("Trait", rf"{_MODS}\btrait\s+(?P<n>{_ID})"),
        ("Impl", rf"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>', ]+\s+for\s+)?(?P<n>{_ID})"),
        ("Macro", rf"\bmacro_rules!\s*(?P<n>{_ID})"),
        ("Function", rf"{_MODS}\bfn\s+(?P<n>{_ID})"),
    ],
    "TypeScript": [
        ("Namespace", rf"{_MODS}\b(?:namespace|module)\s+(?P<n>[\w.]+)"),
        ("Enum", rf"{_MODS}\benum\s+(?P<n>{_ID})"),
        ("Interface", rf"{_MODS}\binterface\s+(?P<n>{_ID})"),
        ("Class", rf"{_MODS}\bclass\s+(?P<n>{_ID})"),
        ("NamedClassExpression", rf"\b(?:const|let|var)\s+(?P<n>{_ID})\s*=\s*class\b"),
        ("NamedGeneratorFunctionExpression", rf"\bfunction\s*\*\s*(?P<n>{_ID})"),
        ("NamedArrowFunction", rf"\b(?:const|let|var)\s+(?P<n>{_ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^{{}}]*\)|{_ID})\s*(?::[^=]+)?=>\s*$"),
        ("NamedFunctionExpression", rf"\b(?:const|let|var)\s+(?P<n>{_ID})\s*=\s*(?:async\s+)?function\b"),
        ("Function", rf"{_MODS}\bfunction\s+(?P<n>{_ID})"),
        ("Method", rf"^(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*(?P<n>{_ID}|#\w+)\s*(?:<[^>]*>)?\([^{{}}]*\)\s*(?::[^{{]+)?$"),
    ],
}
_COMPILED = {lang: [(kind, re.compile(p, re.S)) for kind, p in rules] for lang, rules in RULES.items()}
_TYPES = {"Class", "Interface", "Enum", "Record", "Struct", "Object", "CompanionObject", "DataClass", "ValueClass", "AnnotationClass", "AnnotationDeclaration", "Trait", "Impl", "NamedClassExpression"}
_KEYWORDS = re.compile(r"^\s*(?:else\s+)?(?:if|for|while|switch|catch|try|do|else|finally|when|match|loop|return|synchronized|using|lock|foreach|unsafe|case|default)\b")
_BASES = re.compile(r"\b(?:extends|implements)\s+([\w$.<>, ]+)|\)?\s*:\s*([\w$.<>, ()]+)")

IMPORTS = {
    "Java": re.compile(r"^\s*import\s+(?P<static>static\s+)?(?P<p>[\w.]+?)(?:\.(?P<n>\w+|\*))\s*;", re.M),
    "Kotlin": re.compile(r"^\s*import\s+(?P<p>[\w.]+?)\.(?P<n>\w+|\*)(?:\s+as\s+(?P<a>\w+))?\s*$", re.M),
    "CSharp": re.compile(r"^\s*(?:global\s+)?using\s+(?P<static>static\s+)?(?:(?P<a>\w+)\s*=\s*)?(?P<p>[\w.]+)\s*;", re.M),
    "Rust": re.compile(r"^\s*(?:pub\s+)?use\s+(?P<p>[^;]+);", re.M),
    "TypeScript": re.compile(r"^\s*import\s+(?P<what>[^;'\"]*?)\s*(?:from\s*)?(['\"])(?P<p>[^'\"]+)\2", re.M),
}
_PACKAGE = re.compile(r"^\s*package\s+([\w.]+)", re.M)
_CALL = re.compile(rf"(?P<new>\bnew\s+)?(?P<chain>(?:{_ID}\s*(?:\?\.|!!\.|\.|::)\s*)*)(?P<n>{_ID})\s*(?:<[\w, .?\[\]]*>)?\s*\(")
_OPERATOR = re.compile(rf"\b(?P<v>{_ID})\s*(?P<op>\[|\.\.<?|[-+*/%]=?(?![-+>=])|[=!]=(?!=)|[<>]=?(?=\s)|!?\bin\b)")
_TYPED = re.compile(rf"\b(?P<t>[A-Z][\w$]*)(?:<[^>;=()]*>)?\s+(?P<v>{_ID})\s*[=;,):]|\b(?:val|var|const|let)\s+(?P<v2>{_ID})\s*(?::\s*(?P<t2>[A-Z][\w$]*))?\s*=\s*(?:new\s+)?(?P<t3>[A-Z][\w$]*)?|\b(?P<v3>{_ID})\s*:\s*(?P<t4>[A-Z][\w$]*)")


def _scopes(clean: str, language: str) -> list[tuple[str, str, int, int, int, str, str]]:
    """(type, name, header start, body start, end, receiver, header) of definitions, outer ones first."""
    out, stack, since = [], [], 0
    for i, c in enumerate(clean):
        if c in ";":
            header = clean[since:i]
            depth_is_type = bool(stack) and stack[-1] is not None and out[stack[-1]][0] in _TYPES
            if header.strip() and (depth_is_type or language in ("Kotlin", "Rust", "CSharp")):
                _match(out, header, since, i, i, language, depth_is_type)
            since = i + 1
        elif c == "{":
            header = clean[since:i]
            inside_type = not stack or stack[-1] is not None and out[stack[-1]][0] in _TYPES | {"Namespace", "Module"}
            stack.append(_match(out, header, since, i, -1, language, inside_type))
            since = i + 1
        elif c == "}":
            if stack and (k := stack.pop()) is not None:
                out[k][4] = i + 1
            since = i + 1
        elif c == "\n" and language in ("Kotlin", "TypeScript"):
            header = clean[since:i]
            if header.strip() and header.count("(") == header.count(")") and not re.match(r"\s*[{(]", clean[i + 1 : i + 200].lstrip(" \n")[:1] or " ") and not re.search(r"[=,(<:]\s*$", header):
                if language == "Kotlin" and re.search(r"\b(fun|class|object|interface)\b", header):
                    _match(out, header, since, i, i, language, True)
                since = i + 1
    return [tuple(x) for x in out if x[4] >= 0]


def _match(out: list, header: str, since: int, at: int, end: int, language: str, inside_type: bool) -> int | None:
    text = header.rstrip()
    lead = len(text) - len(text.lstrip())
    text = text.lstrip()
    if not text or _KEYWORDS.match(text):
        return None
    for kind, rule in _COMPILED[language]:
        if kind in ("Method", "Constructor", "InstanceMethod", "StaticMethod", "Property") and not inside_type:
            continue
        if end >= 0 and kind in ("Property",):
            continue
        m = rule.search(text)
        if m and (m["n"] or kind == "CompanionObject") and (m["n"] not in _NOT_CALLS or language == "Rust"):
            out.append([kind, m["n"] or "Companion", since + lead + (m.start() if kind not in ("Method", "Constructor") else 0), at, end, m.groupdict().get("r") or "", text])
            return len(out) - 1
    return None


def extract(text: str, language: str) -> Iterator[Item]:
    clean = blank(text, language)
    package = ""
    if language in ("Java", "Kotlin") and (m := _PACKAGE.search(clean)):
        package = m[1]
        yield Item("definition", "Package", package.rsplit(".", 1)[-1], package, m.start(1), m.end(1))
    sep = "::" if language in ("Rust", "TypeScript") else "."
    scopes = _scopes(clean, language)
    open_: list[tuple[str, str, str, int]] = []  # path, scope that children name, type, end
    spans: list[tuple[int, int, str, str]] = []
    for kind, name, start, body, end, receiver, header in scopes:
        while open_ and open_[-1][3] <= start:
            open_.pop()
        path, scope, outer = open_[-1][:3] if open_ else (package, package, "")
        fqn = f"{path}{sep}{name}" if path else name
        own = fqn
        if kind == "Impl":  # a block of a type's methods: they are named after the type, and belong to the block
            own = f"{path}{sep}{re.sub(r'\s+', ' ', header)}" if path else re.sub(r"\s+", " ", header)
        elif language == "Rust" and kind == "Function" and outer in ("Impl", "Trait"):
            kind = "Method" if re.search(r"\(\s*(?:&\s*(?:'\w+\s*)?)?(?:mut\s+)?self\b", header) else "AssociatedFunction"
        bases = ",".join(b.split("<")[0].split("(")[0].strip() for m in _BASES.finditer(re.sub(r"\([^()]*\)", "", header)) for b in (m[1] or m[2] or "").split(",") if b.strip()) if kind in _TYPES else ""
        returns = re.search(r"\)\s*:\s*([A-Z]\w*)", header)
        yield Item("definition", kind, name, own, start, end, scope=scope, receiver=receiver, extra={"bases": bases, "returns": returns[1] if returns else ""})
        if end > body:
            open_.append((fqn, own, kind, end))
            spans.append((start, end, own, kind))
            for part, at, to in _parts(clean, kind, language, body + 1, end - 1):
                member = clean[at:to]
                yield Item("definition", part, member, f"{fqn}{sep}{member}", at, to, scope=own)
        if language == "Kotlin" and kind in ("Class", "DataClass", "ValueClass", "AnnotationClass") and (m := re.search(r"\bclass\b[^(:{]*\(", clean[start:body])):
            for p in re.finditer(rf"\b(?:val|var)\s+({_ID})", clean[start + m.end() : body]):
                at = start + m.end() + p.start(1)
                yield Item("definition", "Property", p[1], f"{fqn}{sep}{p[1]}", at, at + len(p[1]), scope=own)
    yield from _imports(text, clean, language)
    if language in ("CSharp", "Rust"):
        return  # definitions and imports only
    types: dict[tuple[str, str], str] = {}
    values = {at for kind, _, _, body, end, *_ in scopes if end > body for _, at, _ in _parts(clean, kind, language, body + 1, end - 1)}

    def owner(i: int) -> tuple[str, str]:
        best = ("", "")
        for s, e, fqn, kind in spans:
            if s <= i < e:
                best = (fqn, kind)
        return best

    for m in _TYPED.finditer(clean):
        v, t = m["v"] or m["v2"] or m["v3"], m["t"] or m["t2"] or m["t3"] or m["t4"]
        if v and t:
            types.setdefault((owner(m.start())[0], v), t)
    if language == "Kotlin":
        for m in _OPERATOR.finditer(clean):
            fqn, at = owner(m.start("op"))[0], m.start("op")
            scope, kind = fqn, ""
            while not kind and scope:
                kind, scope = types.get((scope, m["v"]), ""), scope.rpartition(sep)[0]
            if kind:  # an operator on something of a known type calls the type's function
                name = "get" if m["op"] == "[" else KOTLIN_BINARY[m["op"]]
                yield Item("reference", "Operator", name, f"{m['v']}.{name}", at, m.end("op"), scope=fqn, receiver=m["v"], extra={"type": kind})
    for m in _CALL.finditer(clean):
        if m["n"] in _NOT_CALLS and not m["new"]:
            continue
        at = m.start("n")
        if any(x[1] == m["n"] and x[2] <= at < x[3] for x in scopes) or at in values:
            continue  # the declaration itself
        fqn, _ = owner(at)
        chain = re.sub(r"\s|\?|!!", "", m["chain"]).rstrip(".:")
        head = re.split(r"\.|::", chain)[0] if chain else ""
        kind, scope = "", fqn
        while head and not kind:
            kind = types.get((scope, head), "")
            if not scope:
                break
            scope = scope.rpartition(sep)[0]
        yield Item("reference", "New" if m["new"] else "Call", m["n"], f"{chain}.{m['n']}" if chain else m["n"], at, m.end("n"), scope=fqn, receiver=chain, extra={"type": kind})


_PARTS = {("Java", "Enum"): "EnumConstant", ("Kotlin", "Enum"): "EnumEntry", ("Rust", "Enum"): "Variant", ("Rust", "Struct"): "Field", ("Rust", "Union"): "Field"}


def _parts(clean: str, kind: str, language: str, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(type, start, end) of the names of an enum's values, or of a struct's fields, and of Kotlin properties."""
    if language == "Kotlin" and kind in _TYPES:
        depth = 0
        for m in re.finditer(rf"[{{}}()]|\b(?:val|var)\s+({_ID})", clean[at:end]):
            if m[1] is None:
                depth += 1 if m[0] in "{(" else -1
            elif depth == 0:
                yield "Property", at + m.start(1), at + m.end(1)
    if (part := _PARTS.get((language, kind))) is None:
        return
    depth, since = 0, at
    for i in range(at, end + 1):
        c = clean[i] if i < end else ","
        depth += (c in "{([<") - (c in "})]>")
        if c in ",;" and depth == 0:
            m = re.match(rf"(?:\s|#\[[^\]]*\]|@{_ID}(?:\([^)]*\))?)*(?:pub(?:\([^)]*\))?\s+)?({_ID})\s*(:?)", clean[since:i])
            if m and (part != "Field" or m[2]):
                yield part, since + m.start(1), since + m.end(1)
            if c == ";":
                return
            since = i + 1


def _imports(text: str, clean: str, language: str) -> Iterator[Item]:
    if language == "TypeScript":
        for m in IMPORTS[language].finditer(text):
            if not clean[m.start() : m.end()].strip().startswith("import"):
                continue
            what = m["what"].strip()
            names: list[tuple[str, str, str]] = []
            if not what:
                names.append(("SideEffectImport", "", ""))
            for part in re.findall(r"\{[^}]*\}|[^,{}]+", what):
                part = part.strip()
                if part.startswith("{"):
                    for one in filter(None, (x.strip() for x in part[1:-1].split(","))):
                        name, _, alias = one.removeprefix("type ").partition(" as ")
                        names.append(("AliasedImport" if alias else "NamedImport", name.strip(), alias.strip()))
                elif part.startswith("*"):
                    names.append(("NamespaceImport", "*", part.partition(" as ")[2].strip()))
                elif part:
                    names.append(("DefaultImport", part.removeprefix("type ").strip(), ""))
            for kind, name, alias in names:
                yield Item("import", kind, name, "", m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), path=m["p"], alias=alias)
        return
    for m in IMPORTS[language].finditer(clean):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if language == "Rust":
            for path, alias in _rust_paths(re.sub(r"\s+", " ", m["p"]).strip()):
                head, _, name = path.rpartition("::")
                yield Item("import", "GlobUse" if name == "*" else "AliasedUse" if alias else "Use", name, "", start, m.end(), path=head, alias=alias)
        else:
            groups = m.groupdict()
            if language == "CSharp":
                kind = "StaticUsing" if groups["static"] else "AliasedUsing" if groups["a"] else "Using"
                yield Item("import", kind, m["p"].rsplit(".", 1)[-1], "", start, m.end(), path=m["p"], alias=groups["a"] or "")
            else:
                kind = "WildcardImport" if m["n"] == "*" else "AliasedImport" if groups.get("a") else "StaticImport" if groups.get("static") else "Import"
                yield Item("import", kind, m["n"], "", start, m.end(), path=m["p"], alias=groups.get("a") or "")


def _rust_paths(path: str) -> Iterator[tuple[str, str]]:
    head, brace, rest = path.partition("{")
    if not brace:
        name, _, alias = path.partition(" as ")
        yield name.strip(), alias.strip()
        return
    depth, at = 0, 0
    body = rest.rsplit("}", 1)[0]
    for i, c in enumerate(body + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            if one := body[at:i].strip():
                for p, a in _rust_paths(one):
                    yield (head + p if p != "self" else head.rstrip(":")), a
            at = i + 1
