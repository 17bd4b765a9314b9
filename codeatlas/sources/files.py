"""Source files as (path, size, text, status, reason) rows.

Folders are walked and files read on executors, from any file system pyarrow knows; Spark's own file sources hide
names that begin with an underscore, such as package initialisers. Files beyond the size limit or with bytes that
are not UTF-8 are kept as skipped rows with a reason.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import base_name, extension, parent_path
from ..operators.text import directories, directory_edges
from ..session import ship

# Extensions of the supported languages, and suffixes that are not parsed.
LANGUAGES = {
    "Ruby": ["rb", "rbw", "rake", "gemspec"],
    "Python": ["py"],
    "TypeScript": ["ts", "tsx", "js", "jsx", "mjs", "cjs"],
    "Java": ["java"],
    "Kotlin": ["kt", "kts"],
    "CSharp": ["cs"],
    "Rust": ["rs"],
}
EXCLUDED_SUFFIXES = {"TypeScript": ["min.js", ".d.ts"]}
MAX_BYTES = 5_000_000


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, lang) for lang, es in LANGUAGES.items() for e in es], "extension string, language string")


def supported(path) -> "F.Column":
    return extension(path).isin([e for es in LANGUAGES.values() for e in es])


def excluded(path, language) -> "F.Column":
    out = F.lit(False)
    for lang, suffixes in EXCLUDED_SUFFIXES.items():
        for s in suffixes:
            out = out | (language == lang) & F.endswith(path, F.lit(s))
    return out


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (a path or a URI) that driver and executors reach, and the folder's path in it."""
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    return fs, base.rstrip("/")


_READ = "path string, size long, text string, status string, reason string"


def read_files(paths: DataFrame, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, size, text, status, reason) of files (path, below ``root``); executors read, names alone were listed.

    Sizes are looked at first, so a file beyond ``max_bytes`` is skipped unread; text must be UTF-8. Empty files and
    names that begin with an underscore are files like others; paths that are no files give no row.
    """
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 1 else pa.string()) for i, c in enumerate(zip(*out, strict=True))], names=[c.split()[0] for c in _READ.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for path in batch.column(0).to_pylist():
                info = fs.get_file_info(f"{base}/{path}")
                if info.type != pafs.FileType.File:
                    continue
                if info.size > max_bytes:
                    out.append((path, info.size, None, "skipped", f"file too large: {info.size}"))
                    continue
                with fs.open_input_stream(info.path) as f:
                    data = f.read()
                try:
                    out.append((path, info.size, data.decode(), "ok", None))
                except UnicodeDecodeError:
                    out.append((path, info.size, None, "skipped", "not UTF-8"))
                held += len(data)
                if held > 4 << 20 or len(out) >= 1000:
                    yield flush()
                    held = 0
        if out:
            yield flush()

    n = max(1, paths.sparkSession.sparkContext.defaultParallelism)
    return paths.select("path").where(supported(F.col("path"))).repartition(n).mapInArrow(run, _READ)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file below ``root``: the driver lists its entries, executors walk the folders among them."""
    fs, base = _store(root)
    top = fs.get_file_info(pafs.FileSelector(base))
    files = [(x.base_name,) for x in top if x.type == pafs.FileType.File]
    folders = [(x.base_name,) for x in top if x.type == pafs.FileType.Directory]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}", recursive=True))
                yield pa.RecordBatch.from_arrays([pa.array([x.path[len(base) + 1 :] for x in found if x.type == pafs.FileType.File], pa.string())], names=["path"])

    ship(spark)
    below = spark.createDataFrame(folders, "path string").repartition(max(1, min(len(folders), 10_000))).mapInArrow(walk, "path string")
    return spark.createDataFrame(files, "path string").unionByName(below)


def read_tree(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every supported file below ``root``, without ignore rules."""
    return read_files(list_tree(spark, root), root, max_bytes)


def read_tracked(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files that git tracks or would add (ignore rules hold, hidden ones go); names only are listed on the driver."""
    listed = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout.decode().split("\0")
    names = [(p,) for p in dict.fromkeys(listed) if p and not any(x.startswith(".") for x in p.split("/"))]
    return read_files(spark.createDataFrame(names, "path string"), root, max_bytes)


def read_changed(files: DataFrame, changed: DataFrame) -> DataFrame:
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def with_language(files: DataFrame) -> DataFrame:
    """Adds language and extension; files with an excluded suffix become skipped."""
    out = files.withColumn("extension", extension(F.col("path"))).join(F.broadcast(language_table(files.sparkSession)), "extension", "left")  # a row an extension
    cut = excluded(F.col("path"), F.col("language"))
    return out.withColumn("reason", F.when(cut, "excluded suffix").otherwise(F.col("reason"))).withColumn("status", F.when(cut, "skipped").otherwise(F.col("status")))


def file_nodes(files: DataFrame, repository: str, root: str) -> DataFrame:
    """FileNode columns without ids."""
    return files.select("path", F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("absolute_path"), "language", F.lit(repository).alias("repository_name"), "extension", base_name(F.col("path")).alias("name"))


def directory_nodes(files: DataFrame, repository: str, root: str) -> DataFrame:
    return directories(files).select(F.col("dir").alias("path"), F.concat(F.lit(root.rstrip("/") + "/"), "dir").alias("absolute_path"), F.lit(repository).alias("repository_name"), base_name(F.col("dir")).alias("name"))


def containment(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((parent, child) of directories, (dir, path) of files; files at the top have none)."""
    dirs = directories(files)
    return directory_edges(dirs), files.where(F.contains("path", F.lit("/"))).select(parent_path(F.col("path")).alias("dir"), "path")
