"""Session defaults, and the package for Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "folioflux", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings by keyword, dots as underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: once an application, as a file of the job.

    Workers of a local master that find it by PYTHONPATH or the working folder need no copy.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    found = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if context.applicationId in _shipped or context.master.startswith("local") and str(package.parent) in map(os.path.realpath, filter(None, found)):
        return
    place = tempfile.mkdtemp(prefix="folioflux-")
    context.addPyFile(shutil.make_archive(f"{place}/{package.name}", "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
