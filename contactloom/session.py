"""What a session needs before Python workers can run this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application.

    Workers unpickle functions of this package by name.  Where they do not share the driver's
    import path, Spark's own file server brings them this archive.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="contactloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{folder}/contactloom", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
