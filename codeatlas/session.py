"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the Python workers of every executor this package (once for each application)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(), "codeatlas.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(home.rglob("*.py")):
                z.write(p, f"codeatlas/{p.relative_to(home)}")
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="codeatlas-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")
