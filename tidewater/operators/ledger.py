"""A ledger of answered requests, so that a job that is started again doesn't send what has an answer.

Tasks write the answers to a folder that all executors share, as they come in, long before their job ends.
A later job, a task that is tried again and a second action on one result find them there.

The folder holds small Parquet files, ``<run>/<task>/<name>.parquet``.  A file gets its name once
it is written, so there are no parts of files.  A request is known by a digest of its keys and its body: if the
prompt of a key changes, it is sent.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = "request string, status int, body string, attempts int"
_ARROW = pa.schema([("request", pa.string()), ("status", pa.int32()), ("body", pa.string()), ("attempts", pa.int32())])


class Answer(NamedTuple):
    """What was answered to a request, and to which attempt."""

    status: int
    body: str
    attempts: int


def request_id(keys: list[Column], payload: Column) -> Column:
    """What a request is known by; null if there is none to send."""
    named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    return F.sha2(F.concat(named, F.lit("\n"), payload), 256)


class Ledger(NamedTuple):
    """A ledger's folder as the tasks of one run see it; ``rows`` answers are written together."""

    folder: str
    run: str
    rows: int

    @classmethod
    def open(cls, spark: SparkSession, folder: str, rows: int) -> Ledger:
        """A new run in a folder, which is made if it isn't there."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(place)
        return cls(system.makeQualified(place).toString(), uuid.uuid4().hex, rows)

    def _place(self, task: int) -> tuple[fs.FileSystem, str]:
        uri = self.folder if "://" in self.folder else "file://" + self.folder.removeprefix("file:")
        system, root = fs.FileSystem.from_uri(uri)
        return system, f"{root}/{self.run}/{task}"

    def of_task(self, task: int) -> dict[str, Answer]:
        """What earlier attempts of a task of this run have written."""
        system, place = self._place(task)
        files = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
        found: dict[str, Answer] = {}
        for file in files:
            if file.base_name.endswith(".parquet"):
                rows = pq.read_table(file.path, filesystem=system).to_pydict()
                found |= {r: Answer(*rest) for r, *rest in zip(*(rows[c] for c in _ARROW.names))}
        return found

    def write(self, task: int, answers: dict[str, Answer]) -> None:
        """Add answers; they are all there, or none is."""
        system, place = self._place(task)
        system.create_dir(place, recursive=True)
        name = uuid.uuid4().hex
        columns = [list(answers), *zip(*answers.values())]
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
        pq.write_table(table, f"{place}/_{name}", filesystem=system)
        system.move(f"{place}/_{name}", f"{place}/{name}.parquet")


def answered(spark: SparkSession, folder: str, failed: bool = True) -> DataFrame:
    """``request, status, body, attempts`` of a ledger, each request once; without ``failed`` only successes."""
    files = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)
    return (files if failed else files.where("status < 400")).dropDuplicates(["request"])
