"""Column functions: strings, paths and byte positions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ci(column: Column, term: str) -> Column:
    """Case-insensitive literal substring test (% and _ mean themselves)."""
    return F.contains(F.lower(column), F.lower(F.lit(term)))


def any_term(column: Column, terms: list[str]) -> Column:
    """Whether the lower-cased column contains one of the lower-cased terms."""
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(column), t)) if terms else F.lit(False)


def parent_path(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The part after the last dot of the name, 'unknown' without one."""
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.substring_index(name, ".", -1)).otherwise("unknown")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_prefix(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), path.substr(F.length(root) + 2, F.length(path))).otherwise(path)


def is_directory_like(path: Column) -> Column:
    """A path that ends with / or whose last part has no dot."""
    return F.endswith(path, F.lit("/")) | ~F.contains(base_name(path), F.lit("."))


def under(path: Column, root: Column) -> Column:
    """Whether ``path`` is ``root`` or lies below it, by components."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def has_component(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def path_hash16(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def occurrences(line: Column, symbol: str) -> Column:
    """Array of (start, end) byte columns, end included, of the non-overlapping occurrences of ``symbol``."""
    parts = F.split(line, F.lit("\\Q" + symbol.replace("\\E", "\\E\\\\E\\Q") + "\\E"), -1)
    n = len(symbol.encode())
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.octet_length(F.array_join(F.slice(parts, 1, i), symbol)))
    spans = F.transform(ends, lambda e: F.struct(e.cast("long").alias("start"), (e + n - 1).cast("long").alias("end")))
    return F.when(F.lit(n > 0) & (F.size(parts) > 1), F.slice(spans, 1, F.size(parts) - 1)).otherwise(F.slice(spans, 1, 0))


def escape_dots(part: Column) -> Column:
    return F.replace(part, F.lit("."), F.lit("#"))


def camel(name: Column) -> Column:
    """``@user_account`` -> ``UserAccount``."""
    return F.array_join(F.transform(F.split(F.regexp_replace(name, "^@+", ""), "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")


def readable_bytes(n: Column) -> Column:
    """1536 -> '1.50 KB'."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for p, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**p, F.concat(F.format_string("%.2f", n / float(1024**p)), F.lit(f" {unit}"))).otherwise(out)
    return out
