"""The property graph's tables: node and edge columns, label pairs, and the wide node projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(spec: str, nullable: bool = False) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType()}
    out = T.StructType()
    for item in spec.split(", "):
        name, kind = item.split()
        out.add(name, kinds[kind], nullable)
    return out


DIRECTORY, FILE, DEFINITION, IMPORT = "DirectoryNode", "FileNode", "DefinitionNode", "ImportedSymbolNode"

NODES = {
    DIRECTORY: _struct("id long, path string, absolute_path string, repository_name string, name string"),
    FILE: _struct("id long, path string, absolute_path string, language string, repository_name string, extension string, name string"),
    DEFINITION: _struct(
        "id long, fqn string, name string, definition_type string, primary_file_path string, primary_start_byte long, primary_end_byte long, "
        "start_line int, end_line int, start_col int, end_col int, total_locations int"
    ),
    IMPORT: _struct(
        "id long, import_type string, import_path string, name string, alias string, file_path string, start_byte long, end_byte long, "
        "start_line int, end_line int, start_col int, end_col int"
    ),
}

EDGE = _struct("source_id long, target_id long, type string")
for _c in ("source_start_byte", "source_end_byte"):
    EDGE.add(_c, T.LongType(), True)
for _c in ("source_start_line", "source_end_line", "source_start_col", "source_end_col"):
    EDGE.add(_c, T.IntegerType(), True)
#: Where the call stands, and the range of the definition that makes it, are kept apart.
EDGE.add("call_line", T.IntegerType(), True).add("edge_id", T.StringType(), False)

#: Columns that identify a node across re-indexing.
NATURAL_KEYS = {
    DIRECTORY: ["path"],
    FILE: ["path"],
    DEFINITION: ["primary_file_path", "primary_start_byte", "primary_end_byte", "fqn"],
    IMPORT: ["file_path", "start_byte", "end_byte", "name", "alias"],
}


@dataclass(frozen=True)
class Rel:
    """One (table, from, to) pair of an edge table."""

    table: str
    source: str
    target: str

    @property
    def file(self) -> str:
        return f"{self.source}_to_{self.target}_relationships.parquet".lower()


DIR_REL, FILE_REL, DEF_REL, IMP_REL = "DIRECTORY_RELATIONSHIPS", "FILE_RELATIONSHIPS", "DEFINITION_RELATIONSHIPS", "IMPORTED_SYMBOL_RELATIONSHIPS"
RELS = (
    Rel(DIR_REL, DIRECTORY, DIRECTORY),
    Rel(DIR_REL, DIRECTORY, FILE),
    Rel(FILE_REL, FILE, DEFINITION),
    Rel(FILE_REL, FILE, IMPORT),
    Rel(DEF_REL, DEFINITION, DEFINITION),
    Rel(DEF_REL, DEFINITION, IMPORT),
    Rel(IMP_REL, IMPORT, IMPORT),
    Rel(IMP_REL, IMPORT, DEFINITION),
    Rel(IMP_REL, IMPORT, FILE),
)

#: The wide form: every label in the same 17 columns.
WIDE = (
    "id type path absolute_path repository_name language extension name fqn definition_type primary_file_path "
    "import_type import_path alias start_line end_line total_locations"
).split()
_NUMBERS = {"id", "start_line", "end_line", "total_locations"}


def wide(label: str, prefix: str = "", get=F.col) -> list[Column]:
    """The wide projection of one label's columns; what it lacks is '' or 0."""
    own = {f.name for f in NODES[label].fields}
    out = []
    for c in WIDE:
        if c == "type":
            v = F.lit(label)
        elif c == "primary_file_path" and label == IMPORT:
            v = get("file_path")
        elif c in own:
            v = get(c)
        else:
            v = F.lit(0 if c in _NUMBERS else "")
        out.append((v.cast("long") if c in _NUMBERS else v).alias(prefix + c))
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the columns of ``schema``: missing strings become '', missing numbers 0 where null isn't allowed."""
    out = []
    for f in schema.fields:
        v = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if not f.nullable:
            v = F.coalesce(v, F.lit("" if isinstance(f.dataType, T.StringType) else 0).cast(f.dataType))
        out.append(v.alias(f.name))
    return df.select(*out)
