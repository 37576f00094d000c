"""Getting this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to executors whose workers wouldn't find it on their path.

    Workers look in the working directory and in PYTHONPATH; if neither has the package's
    folder, it goes along as an archive, once for each application.
    """
    app = spark.sparkContext.applicationId
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or any(os.path.isdir(os.path.join(p or ".", "tidewater")) for p in paths):
        return
    archive = os.path.join(tempfile.mkdtemp(), "tidewater.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(_ROOT, "tidewater")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
