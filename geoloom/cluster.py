"""Places and tables that every executor of a cluster can see."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests on one machine) a temporary
    folder is chosen and remembered for the session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="geoloom-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_collecting: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that ``written`` makes inside, for whoever knows when nothing reads them any more."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting.pop()


def written(df: DataFrame, name: str = "table", partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage as ``checkpoint()`` does, survives lost executors, and gives the optimiser the real size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    for paths in _collecting:
        paths.append(path)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._geoloom_path = path
    return out


def drop_written(df: DataFrame | None) -> None:
    """Delete what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_geoloom_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def put_bytes(spark: SparkSession, uri: str, data: bytes) -> None:
    """Write a small file through Hadoop's file systems, so that any store works."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get_text(spark: SparkSession, uri: str) -> str | None:
    """A small text file, hidden ones too, through Hadoop's file systems; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, which may have wildcards, leads to any file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, where it isn't installed; once for each context."""
    sc = spark.sparkContext
    if any("geoloom-modules" in f for f in sc.listFiles):
        return
    root, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"geoloom/{f.relative_to(root)}")
    uri = f"{fresh_path(spark, 'modules')}/geoloom-modules.zip"
    put_bytes(spark, uri, data.getvalue())
    sc.addPyFile(uri)
