"""Tables written between two jobs of one operator.

Spark recomputes a DataFrame each time an action reads it, and a lost executor
takes its shuffle files along.  Where an operator reads an intermediate result
more than once, it writes it here: Parquet in the folder that all executors
share, so nothing has to be computed again.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset.

    The setting is only made up in local mode: on a cluster a temporary folder of
    the driver can't be read by executors, so there an unset value is an error.
    """
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"tidewater-{os.getpid()}")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def _write(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    path = f"{shared_folder(df.sparkSession)}/tidewater/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a DataFrame that reads it."""
    return _write(df, label)[1]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``materialize`` whose tables go at the end of the block, in which their last reader must have been written.

    >>> with scratch(spark) as keep:
    ...     parts = keep(docs.select("doc_id"), "parts")
    ...     result = materialize(parts.join(parts, "doc_id"), "result")
    """
    paths: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        path, table = _write(df, label)
        paths.append(path)
        return table

    try:
        yield keep
    finally:
        for path in paths:
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for ``df``; nothing may read it afterwards."""
    root = f"{shared_folder(df.sparkSession)}/tidewater/"
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/tidewater/" in folder and root.split("://")[-1].rstrip("/") in folder:
            _delete(df.sparkSession, folder)
