"""Materialising intermediate results where every executor can read them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local.

    On a cluster each executor would write to a disk of its own, so there an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veriscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Deletes the shuffle files of a query at its end (Spark 4.1); read when a write begins.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


class Workspace:
    """Tables written under one folder of the shared directory; dropped one by one when no longer read.

    A written table cuts the lineage and survives the loss of executors. With ``release`` the shuffle files that led to
    a table are deleted as soon as it is written; else they stay until the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, name: str, release: bool = False):
        self.spark = spark
        self.release = release
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self._n:03d}-{name}"
        self._n += 1
        with _released(self.spark) if self.release else nullcontext():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._veriscope_path = path  # type: ignore[attr-defined]
        return out

    def close(self) -> None:
        """Deletes all tables of this workspace; what has not been written elsewhere can no longer be read."""
        _delete(self.spark, self.root)

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_veriscope_path", None)
        if path:
            _delete(self.spark, path)


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(path: str, text: str) -> None:
    """A small text to any path that Spark's session knows, or to a local file where there is no session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str) -> str:
    spark = SparkSession.getActiveSession()
    if spark is None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    p, fs = _path(spark, path)
    got = fs.open(p)
    try:
        return bytes(got.readAllBytes()).decode()
    finally:
        got.close()
