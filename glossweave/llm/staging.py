"""Tables written to the folder that all executors share.

Staged tables cut lineage, so a lost executor costs a re-read and never a
recomputation of everything before it.  The folder is ``spark.checkpoint.dir``;
only a session that names none (tests on ``local[n]``) gets a temporary one.

A table goes when nothing can read it any more: operators drop what their result
doesn't need, and a `scope` drops all that was staged inside it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local[") or master == "local":
        folder = tempfile.mkdtemp(prefix="glossweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = f"file://{folder}"
    else:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCOPES: list[list[Staging]] = []
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def scope() -> Iterator[None]:
    """Drops, at its end, the staged tables of all operators called inside: their results have to be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for staging in _SCOPES.pop():
            staging.drop()


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Batches of at most so many rows for what is run inside, where a row is wide."""
    before = spark.conf.get(ARROW_ROWS)
    if rows is not None:
        spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


class Staging:
    """A folder for the staged tables of one operator call."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{operator}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        if _SCOPES:
            _SCOPES[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
        """Write ``df`` once and return a scan of what was written; ``rows`` bounds the batches that Python gets."""
        self.names.add(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with arrow_rows(self.spark, rows):
            writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read
        if like is not None:
            reader = reader.schema(like.schema)
        return reader.parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Delete all staged tables but these."""
        for name in sorted(self.names - set(names)):
            self.drop(name)
            self.names.discard(name)

    def drop(self, name: str = "") -> None:
        """Delete one staged table, or everything of this call."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
