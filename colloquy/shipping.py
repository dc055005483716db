"""Makes this package importable on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ship-")
    with_parent = Path(folder) / "tree"
    shutil.copytree(root, with_parent / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", with_parent))
    shutil.rmtree(with_parent)
    _shipped.add(context.applicationId)
