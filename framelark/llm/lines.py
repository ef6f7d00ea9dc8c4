"""Lines that repeat across documents, found in sorted hash ranges."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, cut, documents, fingerprint, fresh, map_batches, n_partitions, prepare

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LINE = "doc_id long, a long, b long, n_lines int, h1 long, h2 long, positions binary"
FOUND = "kind int, doc_id long, a long, b long, n_lines int, h1 long, h2 long, positions binary, n_docs long"
LOST, PENDING, SUMMARY = 0, 1, 2


def line_key(line: str) -> str:
    """A line without white space at its ends, A-Z lower-cased."""
    return line.strip(SPACE).translate(_LOWER)


def pack_positions(positions) -> bytes:
    return np.asarray(positions, "<u4").tobytes()


def keep_bitmap(n_lines: int, dropped: np.ndarray) -> bytes:
    """A bit for each line, set where it stays, compressed."""
    bits = np.ones(n_lines, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def read_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines, bitorder="little").astype(bool)


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("fp", fingerprint())


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each document and distinct key of ``min_chars`` code points or more, with the positions that have it."""

    def run(b):
        out: dict[str, list] = {k: [] for k in ("doc_id", "a", "b", "n_lines", "h1", "h2", "positions")}
        for d, x, y, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if not t or len(t) < min_chars:
                continue
            lines = t.split("\n")
            own: dict[str, list[int]] = {}
            for i, line in enumerate(lines):
                if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                    own.setdefault(key, []).append(i)
            for key, at in own.items():
                h = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))
                for k, v in zip(out, (d, x, y, len(lines), int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), pack_positions(at)), strict=True):
                    out[k].append(v)
        return out

    return map_batches(_ids(docs).select("doc_id", "fp.a", "fp.b", "text"), run, LINE)


def _stream(min_docs: int):
    """Stream one partition, sorted by hash and then by document, largest first.

    A run is the rows of one hash. Its first document keeps the line; later ones lose it once ``min_docs`` documents have come, until
    then their rows are held (those of fewer than ``min_docs`` documents). A run at an edge of the partition may go on in another
    one: what this partition can't tell is sent on as PENDING, with a SUMMARY of the run.
    """

    def run(batches):
        out: list[tuple] = []
        key, index, n, largest, doc, held = None, -1, 0, None, None, []

        def end(edge: bool):
            if key is not None and (edge or index == 0):
                out.append((SUMMARY, largest, None, None, None, *key, None, n))
                if index:
                    out.extend((PENDING, *r, None) for r in held)

        def table():
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in _NAMES[1:8]), strict=True):
                if (r[4], r[5]) != key:
                    end(False)
                    key, index, n, largest, doc = (r[4], r[5]), index + 1, 1, r[0], r[0]
                    held.clear()
                elif r[0] != doc:
                    n, doc = n + 1, r[0]
                if index == 0:
                    out.append((PENDING, *r, None))
                elif n > 1:
                    if n >= min_docs:
                        out.extend((LOST, *x, None) for x in held)
                        held.clear()
                        out.append((LOST, *r, None))
                    else:
                        held.append(r)
            if len(out) > 20_000:
                yield table()
        end(True)
        if out:
            yield table()

    return run


_NAMES = ["kind", "doc_id", "a", "b", "n_lines", "h1", "h2", "positions", "n_docs"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: doc_id, a, b (hashes of the text), n_dropped, bitmap.

    Rows (hash, document, positions) are dealt by ranges of (hash, document) and sorted by hash, document (largest
    first) and text, so a common line spreads over as many tasks as its documents need. Each partition is streamed once;
    only runs at its edges stay open, and their summaries (two a partition at most, hence the broadcast) settle them.
    """
    spark = prepare(docs.sparkSession)
    parts = n_partitions(spark)
    by = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    lines = hashed_lines(docs, min_chars).repartitionByRange(parts, *by).sortWithinPartitions(*by, "a", "b")
    found = cut(lines.mapInArrow(_stream(min_docs), FOUND), "lines")
    open_runs = found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.max("doc_id").alias("largest"))
    pending = found.where(F.col("kind") == PENDING).drop("n_docs").join(F.broadcast(open_runs), ["h1", "h2"])
    columns = ["doc_id", "a", "b", "n_lines", "positions"]
    lost = found.where(F.col("kind") == LOST).select(columns).unionByName(pending.where((F.col("docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("largest"))).select(columns))

    packed = lost.groupBy("doc_id", "a", "b").agg(F.first("n_lines").alias("n_lines"), F.collect_list("positions").alias("positions"))

    def pack(b):
        got = [(int(n), np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in ps]))) for n, ps in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        return {"doc_id": b.column(0), "a": b.column(1), "b": b.column(2), "n_dropped": [len(at) for _, at in got], "bitmap": [keep_bitmap(n, at) for n, at in got]}

    return map_batches(packed, pack, "doc_id long, a long, b long, n_dropped long, bitmap binary")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` without their repeated lines, and ``n_lines``, ``n_dropped``.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of ``min_chars`` code points or more found in
    ``min_docs`` documents or more stays only in the document with the largest doc_id among them, in all its lines there. Other
    lines stay, joined by newlines. Null or empty text is one empty line and comes back as it was. A document is a doc_id: rows that
    share one count once and lose lines alike; a null doc_id is a document of its own, smaller than all others. All columns of ``docs`` stay
    (columns named ``n_lines`` or ``n_dropped`` are replaced). No rows give no rows.
    """
    rows = docs.drop("n_lines", "n_dropped")
    key, own, lost, bits = (fresh(rows, n) for n in ("_key", "_own", "_lost", "_bitmap"))
    bitmaps = line_bitmaps(docs, min_chars, min_docs).select(F.struct("doc_id", "a", "b").alias(own), F.col("n_dropped").alias(lost), F.col("bitmap").alias(bits))
    rows = rows.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b")))
    joined = rows.join(bitmaps, F.col(key).eqNullSafe(F.col(own)), "left").drop(key, own)

    @F.pandas_udf("string")
    def cut_lines(text, bitmap):
        import pandas as pd

        def one(t, m):
            lines = t.split("\n")
            return "\n".join([x for x, keep in zip(lines, read_bitmap(m, len(lines)), strict=True) if keep])

        return pd.Series([t if m is None else one(t, m) for t, m in zip(text, bitmap, strict=True)], dtype=object)

    counted = joined.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")).withColumn("n_dropped", F.coalesce(lost, F.lit(0).cast("long")))
    return counted.withColumn("text", F.when(F.col(bits).isNull(), F.col("text")).otherwise(cut_lines("text", bits))).drop(bits, lost)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
