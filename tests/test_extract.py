"""Extraction over source trees of our own (no Spark)."""

import fixtures as X
import pytest

from codeatlas.extract.run import parse_text


def items(path, language, text, kind):
    return [r for r in parse_text(path, language, text) if r[4] == kind]


def fqns(path, language, text):
    return {(r[5], r[7]) for r in items(path, language, text, "definition")}


def test_python_definitions_and_ranges():
    got = {r[7]: r for r in items("m", "Python", X.PYTHON["app/models.py"], "definition")}
    assert {n: r[5] for n, r in got.items()} == {
        "Base": "Class", "Base.save": "Method", "User": "Class", "User.__init__": "Method", "User.label": "DecoratedMethod", "User.format": "Method", "User.format.inner": "Function", "make": "Function", "double": "Lambda",
    }
    assert got["User"][13] == "Base" and (got["User"][17], got["User"][18]) == (5, 16)


def test_python_imports_and_failures():
    got = {(r[5], r[9], r[6], r[10]) for r in items("m", "Python", X.PYTHON["app/api.py"], "import")}
    assert got == {("FromImport", ".models", "make", ""), ("AliasedFromImport", ".models", "User", "Person"), ("WildcardImport", "app.util", "*", ""), ("AliasedImport", "app.util", "app.util", "util"), ("Import", "json", "json", "")}
    assert parse_text("m", "Python", X.PYTHON["broken.py"])[0][2] == "error"


def test_columns_are_bytes():
    text = "def f(): pass\n'é'; f()\n"
    ref = items("m", "Python", text, "reference")[0]
    assert (ref[17], ref[19], ref[15]) == (1, 6, len("def f(): pass\n".encode()) + 6)


@pytest.mark.parametrize(
    ("language", "path", "wanted"),
    [
        ("Java", "src/com/x/Foo.java", {("Class", "com.x.Foo"), ("Constructor", "com.x.Foo.Foo"), ("Method", "com.x.Foo.run"), ("Package", "com.x")}),
        ("Java", "src/com/x/Bar.java", {("Class", "com.x.Bar"), ("Method", "com.x.Bar.greet"), ("Enum", "com.x.Bar.Kind"), ("EnumConstant", "com.x.Bar.Kind.A"), ("EnumConstant", "com.x.Bar.Kind.B"), ("Package", "com.x")}),
        ("Kotlin", "k/Main.kt", {("DataClass", "k.Point"), ("Property", "k.Point.x"), ("Class", "k.Runner"), ("Function", "k.Runner.go"), ("Class", "k.Base"), ("Function", "k.Base.step"), ("Function", "k.make"), ("Package", "k")}),
        ("TypeScript", "web/main.ts", {("Class", "Store"), ("Method", "Store::get"), ("Function", "load"), ("NamedArrowFunction", "twice")}),
        ("Ruby", "lib/auth.rb", {("Module", "Auth"), ("Class", "Auth::Session"), ("SingletonMethod", "Auth::Session::open"), ("Method", "Auth::Session#close"), ("Method", "Auth::Session#helper")}),
        ("CSharp", "App.cs", {("Namespace", "App"), ("Class", "App.Program"), ("Property", "App.Program.Size"), ("StaticMethod", "App.Program.Main"), ("InstanceMethod", "App.Program.Run"), ("Struct", "App.Pair")}),
        ("Rust", "lib.rs", {("Struct", "Point"), ("Field", "Point::x"), ("Impl", "impl Point"), ("AssociatedFunction", "Point::new"), ("Module", "inner"), ("Function", "inner::f")}),
    ],
)
def test_definitions(language, path, wanted):
    trees = {"Java": X.JAVA, "Kotlin": X.KOTLIN, "TypeScript": X.TYPESCRIPT, "Ruby": X.RUBY, "CSharp": X.CSHARP, "Rust": X.RUST}
    assert fqns(path, language, trees[language][path]) == wanted


def test_calls_in_comments_and_strings_do_not_count():
    names = [r[6] for r in items("f", "Java", X.JAVA["src/com/x/Foo.java"], "reference")]
    assert names == ["greet", "greet", "Helper", "assist"]
    assert not items("f", "Rust", X.RUST["lib.rs"], "reference") and not items("f", "CSharp", X.CSHARP["App.cs"], "reference")


def test_imports_of_other_languages():
    ts = {(r[5], r[9], r[6], r[10]) for r in items("f", "TypeScript", X.TYPESCRIPT["web/main.ts"], "import")}
    assert ts == {("DefaultImport", "fs", "fs", ""), ("AliasedImport", "fs", "readFile", "rf"), ("NamespaceImport", "path", "*", "path"), ("SideEffectImport", "./side", "", "")}
    rust = {(r[5], r[9], r[6], r[10]) for r in items("f", "Rust", X.RUST["lib.rs"], "import")}
    assert rust == {("Use", "std", "fmt", ""), ("AliasedUse", "std::collections", "HashMap", "Map"), ("GlobUse", "crate::a", "*", "")}
    assert [(r[5], r[9]) for r in items("f", "Ruby", X.RUBY["lib/auth.rb"], "import")] == [("Require", "json"), ("RequireRelative", "user")]
