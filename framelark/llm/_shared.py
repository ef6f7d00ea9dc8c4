"""Helpers the operators share: intermediate tables, Arrow batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: texts may be long, so batches stay small.
BATCH_ROWS = 512
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that long texts never gather in one Python buffer."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``; only a local session may go without and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='framelark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This ends the lineage: a lost executor costs the tasks it was running, not the stages before. Once the
    table stands, Spark deletes the shuffle files it was made from.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framelark-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    back = spark.read.schema(df.schema).parquet(path)
    back.framelark_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing will read any more."""
    for t in tables:
        path = getattr(t, "framelark_path", None)
        if path:
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def n_partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one record batch to one dict of columns (or None)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            if b.num_rows:
                got = fn(b)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) if not isinstance(got[f.name], pa.Array) else got[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000, clean=None):
        super().__init__()
        self.limit, self.clean = limit, clean

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(self.clean(word) if self.clean else word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``, as UTF-8 bytes, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


PUNCTUATION = b".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def clean(word: bytes) -> bytes:
    """A word without punctuation at its ends (a word of punctuation only stays)."""
    return word.strip(PUNCTUATION) or word


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; the whole sequence if it has fewer words."""
    if len(ids) == 0:
        return ids
    k = min(k, len(ids))
    n = len(ids) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n])
    return np.unique(h)


def fingerprint(col: str = "text"):
    """Two 64-bit hashes of a text as one column, for rows that share an id."""
    return F.struct(F.xxhash64(F.lit(1), F.col(col)).alias("a"), F.xxhash64(F.lit(2), F.col(col)).alias("b"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores, which no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def named(column: str):
    """The column of exactly this name, with dots or backticks in it too."""
    return F.col("`" + column.replace("`", "``") + "`")
