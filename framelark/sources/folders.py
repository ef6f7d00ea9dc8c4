"""Folders that the driver and all executors share, and jobs that go on where a killed run stopped."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Only a local session may go without that setting and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: files need a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='framelark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/framelark-{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``; none if there is no such path."""
    fs, p = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def partitions_of(rows: DataFrame, each: int = 2 << 20) -> int:
    """A number of partitions that grows with the files that ``rows`` are read from, at least Spark's own for shuffles."""
    spark = rows.sparkSession
    size = 0
    for name in rows.inputFiles():
        p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        size += p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


class Resumable:
    """Results by key under ``path``, made batch by batch, so that a run that is killed goes on without repeating what stands.

    A batch first writes its results under ``data/<name>``, then its keys under ``done/<name>``. Only a batch whose keys were committed counts:
    results without them come from a killed run, are never read and are removed by the next run. A key without results is done as well. ``work`` maps
    a frame with some rows of ``todo`` to results; keys must not be null.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def committed(self) -> list[str]:
        return [n for n in folders(self.spark, f"{self.path}/done") if exists(self.spark, f"{self.path}/done/{n}/_SUCCESS")]

    def done(self) -> DataFrame | None:
        """Keys that are done."""
        names = self.committed()
        return self.spark.read.parquet(*(f"{self.path}/done/{n}" for n in names)) if names else None

    def results(self) -> DataFrame | None:
        names = self.committed()
        return self.spark.read.parquet(*(f"{self.path}/data/{n}" for n in names)) if names else None

    def left(self, todo: DataFrame) -> DataFrame:
        """Rows of ``todo`` whose keys aren't done."""
        done = self.done()
        return todo if done is None else todo.join(done, self.key, "left_anti")

    def run(self, todo: DataFrame, work: Callable[[DataFrame], DataFrame], batches: int = 8) -> DataFrame | None:
        """Do what is left in ``batches`` parts by a hash of the key and return all results, of earlier runs too."""
        good = set(self.committed())
        for kind in ("data", "done"):
            for name in folders(self.spark, f"{self.path}/{kind}"):
                if name not in good:
                    remove(self.spark, f"{self.path}/{kind}/{name}")
        left, part = self.left(todo), F.pmod(F.xxhash64(self.key), F.lit(batches))
        for b in range(batches):
            rows = left.where(part == b)
            if rows.isEmpty():
                continue
            name = uuid.uuid4().hex
            work(rows).write.parquet(f"{self.path}/data/{name}")
            rows.select(self.key).distinct().write.parquet(f"{self.path}/done/{name}")
        return self.results()
