"""Sending this package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package's sources to the application once, so that workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="lattica-"), "lattica-sources.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("lattica", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(path)
        _sent.add(app)
    return spark
