"""Packing documents into fixed-length training sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, map_batches, prepare
from .tokens import default_path, encoder

#: So many pieces of a document stay together; longer documents are dealt in such parts, so that no group grows with one document.
LONG_PIECES = 1024
PIECE = "doc_id long, fp long, start long, length long, doc_tokens long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class TournamentTree:
    """Remaining capacities of bins as leaves; each inner node holds the larger of its children.

    ``first(size)`` descends to the leftmost bin with room, in log time.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(1, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        return i - self.leaves

    def take(self, leaf: int, size: int) -> int:
        """Put ``size`` into a bin; return the offset it gets."""
        room, i = self.room, leaf + self.leaves
        left = room[i]
        room[i] = left - size
        i //= 2
        while i:
            room[i] = max(room[2 * i], room[2 * i + 1])
            i //= 2
        return left


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, ``sizes`` in any order; ties keep the order given."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = TournamentTree(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        bins[i] = leaf = tree.first(size)
        offsets[i] = capacity - tree.take(leaf, size)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of ``capacity``."""

    def run(b):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        out: dict[str, list] = {k: [] for k in ("doc_id", "fp", "start", "length", "doc_tokens", "ids")}
        for d, fp, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), enc.many(b.column(2).to_pylist(), end), strict=True):
            n = len(ids) // 4
            for s in range(0, n, capacity):
                part = ids[4 * s : 4 * (s + capacity)]
                for k, v in zip(out, (d, fp, s, len(part) // 4, n, part), strict=True):
                    out[k].append(v)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text"), run, PIECE)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, group_docs: int = 4096, group_chars: int = 32_000_000, seed: int = 17) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids with little padding.

    Every document is encoded, ended with ``end_id`` and cut at multiples of ``capacity``. Documents are dealt at
    random (by a hash of id and text, so reruns agree) to groups, and each group is packed by itself: first-fit decreasing,
    the first bin with room found in a tournament tree. The number of groups follows the documents and
    their characters, so that a group holds about ``group_docs`` documents and ``group_chars`` characters at
    most, whatever the size of the corpus. A group wastes at most its last bins, so large groups pad little.

    Returns a row for each piece: doc_id, start (its document's ids before it), length, doc_tokens, sequence_id,
    offset (gapless from 0 in each sequence), ids (little-endian unsigned 32-bit). Null or empty text is a document with the end id alone; a
    null doc_id stays null. Rows that share a doc_id are packed as documents of their own. No rows give no rows. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    tokenizer = tokenizer or default_path()
    docs = docs.select("doc_id", "text")
    n, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    groups = max(1, -(-n // group_docs), -(-chars // group_chars))

    # Arrow keeps ids beyond 2^53 exact beside nulls
    def one(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=[("doc_id", "ascending"), ("fp", "ascending"), ("start", "ascending")]))
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        sequences = (np.int64(group["pack_group"][0].as_py()) << np.int64(32)) + bins
        return group.drop_columns(["pack_group", "fp", "ids"]).append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets)).append_column("ids", group["ids"])

    part = F.floor(F.col("start") / (capacity * LONG_PIECES))
    dealt = pieces(docs, tokenizer, capacity, end_id).withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "fp", part), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(one, PACKED)


def with_crc(packed: DataFrame) -> DataFrame:
    """``ids_crc32`` in place of the ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op1_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return with_crc(pack(documents(spark, sf_dir))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


__all__ = ["TournamentTree", "first_fit_decreasing", "op1_pack_sequences", "pack", "pieces", "with_crc"]
