"""Session defaults and small helpers that depend on the session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[*]", app: str = "quernstone", **conf: str) -> SparkSession:
    """A session with this library's defaults; conf overrides them."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a data frame's size; for files it is their size, 0 where it has none. No job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the cluster has cores.

    Only an input that is read in fewer pieces is dealt out again, that is one
    so small that its files cannot be split; larger ones stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in spark.checkpoint.dir, shared by all its machines.

    Only a local session may do without; then it is a temporary folder, removed
    at the end. On a cluster a missing setting is an error, as no machine could
    read what another one wrote.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if "local" not in _local:
        _local["local"] = tempfile.mkdtemp(prefix="quernstone-tables-")
        atexit.register(shutil.rmtree, _local["local"], True)
    return _local["local"]


_local: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def settled(df: DataFrame) -> DataFrame:
    """df, written once as a table in the shared folder and read from there: what follows neither repeats its work nor needs its lineage.

    The table survives the loss of any executor. It is removed by release(), at
    the latest when the process ends.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_release_all)
    folder = f"{scratch(spark)}/quernstone-{uuid.uuid4().hex}"
    _written.append((spark, folder))
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables of a session; data frames that still read them can no longer run."""
    mine = [f for s, f in _written if s is spark]
    for folder in mine:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = [(s, f) for s, f in _written if s is not spark]
    return len(mine)


def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # noqa: BLE001 - the session may be gone; nothing else can be done at exit
            pass


def spill_folder() -> str:
    """Where a worker process may spill: the scratch folder that Spark gave it, as for its own shuffles; outside a worker none."""
    given = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return os.path.join(given, f"quernstone-spill-{os.getpid()}") if given else ""


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quernstone-py-"), "quernstone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
