"""Session settings the operators rely on, shared scratch tables, and lineage cutting."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results. Everything else is left to the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Rows may be whole texts, so batches that go to Python are bounded in bytes, not in rows alone, and
#: those read from Parquet have few rows: their arrays are single objects on an executor's heap.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}

_own_folder: list[str] = []
_scratch: list[tuple[SparkSession, str]] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that results and bounded memory depend on to a running session."""
    for key, value in {**REQUIRED, **BOUNDS}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the local benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder for scratch tables, which the cluster names in ``spark.checkpoint.dir``.

    The setting is only read, never written. A local session without it uses one fresh
    temporary folder; a cluster without it is refused, as executors could not share files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_folder[0]


def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # the JVM may be gone already
            return


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """Name of a new folder below the shared one; it is deleted when Python ends."""
    if not _scratch:
        atexit.register(_drop_scratch)
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def cut_lineage(df: DataFrame, label: str = "cut", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Later jobs read the columns they need from storage, so neither a lost executor nor a
    second reader computes ``df`` again. ``replaces`` is an earlier result of this function
    that nothing reads any more: its files are deleted once ``df`` is written.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if replaces is not None:
        release(replaces)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a result of ``cut_lineage`` that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path is not None:
        remove(df.sparkSession, path)
        _scratch[:] = [s for s in _scratch if s[1] != path]
