"""What the corpus operators share: stage tables, worker imports, hashing helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"

_own_root: str | None = None


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one where driver and executors are one process."""
    global _own_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="terrametric-")
        atexit.register(shutil.rmtree, _own_root, True)
    return _own_root


#: Rows that go to a Python worker at once. Whole texts are long: the default of
#: 10,000 would hold tens of MB on both sides of the pipe, for each task.
ROWS_A_BATCH = 1000
#: Workers are kept between tasks; one arena and the system's pool keep less of what they freed.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ready_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, in small batches of rows
    and with little memory kept.

    A batch size that the session has set itself is left alone.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *paths])


def release_memory() -> None:
    """Give what a Python worker has freed back to the system, where its C library can."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks under this key: one object at a time, the next step's in place of the last one's."""
    if key not in _resident:
        forget_resident()
        _resident[key] = make()
    return _resident[key]


def forget_resident() -> None:
    """Give back what an earlier step keeps in this worker, before a step that keeps nothing."""
    if _resident:
        _resident.clear()
        release_memory()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would resolve it by, so that other readers find the same place."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


class Scratch:
    """Tables that cut a job's lineage, written below the shared folder.

    A lost executor costs only the tasks since the last table. Tables that a
    later step has replaced are dropped at once; those that the returned
    DataFrame reads stay until the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._remove, self.root, True)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        self._remove(self.path(table))

    def _remove(self, path: str, quiet: bool = False) -> None:
        try:
            sc = self.spark.sparkContext
            if sc._jsc is None:
                return
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            if not quiet:
                raise


def carried(docs: DataFrame, *added: str) -> Column:
    """All input columns as one struct `row`, but for those of which a result column takes the name."""
    taken = {a.lower() for a in added}
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]).alias("row")


def wide_hash(*cols: Column | str) -> list[Column]:
    """128 bits over the columns as two longs, for keys that must not collide at corpus scale."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("\u0001"), *cols)]
