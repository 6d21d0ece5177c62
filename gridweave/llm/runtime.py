"""Session plumbing that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: long documents must not add up to gigabytes in one Python worker.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20
#: Bytes of input after which a Python worker gives freed memory back.
TIDY_BYTES = 16 << 20
_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and send this package to the executors once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(name, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(name))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir.

    Where the setting is absent a local master gets a folder of its own; a cluster must name one,
    because a machine's own disk is out of reach for the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
        os.makedirs(base, exist_ok=True)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _cleanup(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended before the interpreter
        if path.startswith("/tmp/checkpoints/"):
            import shutil

            shutil.rmtree(path, ignore_errors=True)


_REGISTERED: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    base = shared_dir(spark)
    if base not in _REGISTERED:
        _REGISTERED.add(base)
        atexit.register(_cleanup, spark, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove what settle() wrote for df, once nothing reads it any more."""
    if df is not None and getattr(df, "_settled", None):
        _delete(df.sparkSession, df._settled)


def release(spark: SparkSession) -> None:
    """Let shuffle files of plans that are done go: Spark removes them when the driver's JVM collects the plans."""
    spark.sparkContext._jvm.System.gc()


def columns_of(df: DataFrame) -> list:
    """All columns of df, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


@cache
def _malloc_trim():
    """The C library's function, or None where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give memory that Arrow and the C library hold, but nobody uses, back to the system."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim():
        _malloc_trim()(0)


def tidy(function):
    """A function over Arrow batches that trims as it goes and when it ends: Spark keeps workers, and else all they ever held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            read = 0
            for batch in batches:
                read += batch.nbytes
                if read > TIDY_BYTES:
                    read = 0
                    trim()
                yield batch

        try:
            yield from function(counted())
        finally:
            trim()

    return run


def filtered(df: DataFrame, function, *more) -> DataFrame:
    """Rows of df that a function over Arrow batches, of its columns and `more`, lets through; names with dots pass, too."""
    plain = df.select(*columns_of(df), *more)
    plain = plain.toDF(*(f"c{i}" for i in range(len(plain.columns))))
    schema = plain.select(*plain.columns[: len(df.columns)]).schema
    return plain.mapInArrow(tidy(function), schema).toDF(*df.columns)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*cols, seed: int = 0):
    """A uniform number in (0, 1) from the columns: reruns and retried tasks agree."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
