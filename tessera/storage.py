"""Table access and durable intermediate results.

``materialize`` is the only way the library cuts lineage: it writes a Parquet table into the shared
folder named by ``spark.checkpoint.dir`` and reads it back, so a lost executor costs a re-read and
never a recomputation of unbounded depth.  The setting is read from the session; only where it is
unset (local tests) a temporary folder of this machine is used instead.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Paths handed out inside each open ``scratch``.
_SCRATCH: list[list[str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one table in the shared folder."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialized inside are removed at the end, and shuffles that nothing refers to any
    more with them: what is to stay must have been written elsewhere by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            drop_path(spark, path)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def list_paths(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, or the path of a file itself; a missing path holds nothing."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in system.listStatus(target)] if system.exists(target) else []


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI that names its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that ``new_path`` placed; missing paths are fine."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return the stored table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
