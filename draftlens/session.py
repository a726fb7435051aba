"""Session helpers: the folder every executor can reach, and the package for Python workers."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import draftlens

_shipped: set[str] = set()
_local: dict[str, str] = {}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "draftlens") -> SparkSession:
    """A session with adaptive execution and UTC, for scripts and tests; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application: a zip that the driver serves."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(draftlens.__file__))
    folder = tempfile.mkdtemp(prefix="draftlens-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "draftlens_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for d, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("draftlens", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a local one of this process if all runs in this process.

    On a cluster without that setting it raises: executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="draftlens-scratch-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return "file://" + _local[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut and nothing is computed twice.

    The table outlives the loss of any executor. It is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/draftlens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table in any file system that Spark writes to, or do nothing once the session has ended."""
    with contextlib.suppress(Exception):
        at, fs = _file_system(spark, path)
        fs.delete(at, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    at, fs = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def state_of(*tables: DataFrame) -> str:
    """A digest of the files that tables are read from: names, sizes and times of change."""
    seen = hashlib.sha256()
    for df in tables:
        for name in sorted(df.inputFiles()):
            at, fs = _file_system(df.sparkSession, name)
            status = fs.getFileStatus(at)
            seen.update(f"{name}:{status.getLen()}:{status.getModificationTime()}\n".encode())
    return seen.hexdigest()


#: Tables of more bytes are not dealt anew: they have parts enough, or their reshuffling would cost more than it gains.
SPREAD_BYTES = 4 << 30


def spread(df: DataFrame, most: int = SPREAD_BYTES) -> DataFrame:
    """df dealt evenly where its scan, of `most` bytes at most, has fewer parts than the cluster has cores; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > most or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df has not, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        made = f"_{name}"
        while made in taken:
            made = "_" + made
        out.append(made)
        taken.add(made)
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
