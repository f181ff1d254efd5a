"""The package for Python workers that do not have it on their path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the workers of this application import the package: where neither PYTHONPATH nor the working folder leads to it, Spark hands them an archive of it, once."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    known = [Path(p or ".").resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()) if p or p == ""]
    if app in _shipped or root in known:
        return
    d = tempfile.mkdtemp(prefix="crucible-ship-")  # the driver serves the archive as long as it lives
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    shutil.copytree(root / "crucible", f"{d}/in/crucible", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/crucible", "zip", f"{d}/in"))
    _shipped.add(app)
