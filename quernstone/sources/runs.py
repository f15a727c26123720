"""Runs: an identity from what went in, a sealed folder, the last good one, a listing, one writer at a time; tables kept by content.

All files lie on the file system that Spark writes to.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.sinks import finish, finished


class Busy(RuntimeError):
    """Another run writes to the folder."""


class Folder:
    """Small files of a folder, read and written by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def write(self, name: str, value: Mapping, *, replace: bool = True) -> None:
        """value as JSON; without `replace` an existing file is an error, decided by the file system."""
        out = self.fs.create(self.at(name), replace)
        out.write(bytearray(json.dumps(value, sort_keys=True), "utf-8"))
        out.close()

    def read(self, name: str) -> dict | None:
        if not self.exists(name):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/{name}").collect()))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path)) if self.fs.exists(self._path) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, time of change) of the files of an input, in order. Their content is not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.unix_millis("modificationTime").alias("t"))
    return sorted((r.path.rsplit("/", 1)[1], r.length, r.t) for r in rows.collect())


def identity(inputs: Mapping[str, list], code: str, arguments: Mapping) -> str:
    """A digest of what decides a result: the input files, the version of the code, the arguments."""
    told = json.dumps({"inputs": {k: inputs[k] for k in sorted(inputs)}, "code": code, "arguments": dict(arguments)}, sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def code_version() -> str:
    """A digest of this package's own files."""
    import os

    import quernstone

    here, h = os.path.dirname(os.path.abspath(quernstone.__file__)), hashlib.sha256()
    for folder, _, names in sorted(os.walk(here)):
        for n in sorted(names):
            if n.endswith(".py"):
                with open(os.path.join(folder, n), "rb") as f:
                    h.update(n.encode() + b"\0" + f.read())
    return h.hexdigest()


@contextmanager
def locked(folder: Folder):
    """One writer at a time: a lock file that only one can create. A lock left by a lost run is removed by hand."""
    from py4j.protocol import Py4JJavaError

    try:
        folder.write("lock.json", {"by": folder.spark.sparkContext.applicationId}, replace=False)
    except Py4JJavaError as e:
        raise Busy(f"{folder.path} is being written by {(folder.read('lock.json') or {}).get('by')}") from e
    try:
        yield
    finally:
        folder.remove("lock.json")


def run(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame], run_id: str) -> tuple[str, int]:
    """(folder, rows) of the sealed result of a run: made and written, or, if a run of this identity is sealed, as it stands.

    The pointer to the last good run of a name moves only after its folder is sealed.
    """
    top = Folder(spark, f"{root.rstrip('/')}/{name}")
    with locked(top):
        path = f"{top.path}/{run_id}"
        sealed = finished(spark, path) if top.exists(run_id) else None
        if sealed is None:
            top.remove(run_id)
            make().write.parquet(f"{path}/rows")
            sealed = {"rows": spark.read.parquet(f"{path}/rows").count()}
            finish(spark, path, sealed)
        top.write("last_good.json", {"run_id": run_id, **sealed})
    return path, sealed["rows"]


def last_good(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    told = Folder(spark, f"{root.rstrip('/')}/{name}").read("last_good.json")
    return None if told is None else spark.read.parquet(f"{root.rstrip('/')}/{name}/{told['run_id']}/rows")


def status(spark: SparkSession, root: str) -> list[dict]:
    """Every run under a root: its name, identity, whether it is sealed, its rows, and whether it is the last good one."""
    out = []
    top = Folder(spark, root)
    for name in top.names():
        inner = Folder(spark, f"{top.path}/{name}")
        last = (inner.read("last_good.json") or {}).get("run_id")
        for run_id in inner.names():
            if not run_id.startswith(".") and not run_id.endswith(".json"):
                sealed = finished(spark, f"{inner.path}/{run_id}")
                out.append({"name": name, "run_id": run_id, "sealed": sealed is not None, "rows": (sealed or {}).get("rows"), "last_good": run_id == last})
    return out


def cached(spark: SparkSession, root: str, key: Mapping, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under a digest of what it was made from, as captured pages or vectors of a model; made only if it is not there whole."""
    return spark.read.parquet(run(spark, root, "cache", make, identity({}, "", key))[0] + "/rows")
