"""Token ids in files: blocks coded by an adaptive context-mixing range coder.

A file set is a Parquet table of blocks in ascending doc_id order (``part``, then ``block``). Parquet carries
only the rows; ids are coded here. A block holds whole documents and is independent of every
other block: its model starts anew, and its payload is

    "CMR1" | ids u32 | lanes u32 | crc32 of the ids as u32 | words of each lane u32 ... | 16-bit words of lane 0, 1, ...

all little-endian. A block's ids are cut into equal lanes which one model codes side by side: step ``t``
codes the ``t``-th id of each lane, and what it learns from a step holds for the next. The model mixes three predictions of an id
into one distribution: order 0 (adaptive counts of all ids), order 1 and order 2 (the id that
last followed the previous one or two ids, trusted by how often such predictions came true at their confidence). A carryless
range coder of 64 bits turns the mixed distribution into words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import documents, map_batches, n_partitions, prepare, shared_dir
from .tokens import default_path, encoder

U = np.uint64
MAGIC, A, LIMIT, EVERY, GAIN = b"CMR1", 4096, 1 << 17, 8, 24
TOP, BOTTOM = U(1) << U(48), U(1) << U(40)
HASH_BITS, BUCKET, SHIFT = 18, 6, A.bit_length() - 1


#: By confidence + 8 * whether the prediction came true (a case): what the confidence gains. In cases 0 to 3 another id takes the place, at confidence 1.
GAINS = np.array([0] * 4 + [-3] * 4 + [1] * 7 + [0], np.int32)


class Model:
    """Predictions for one block; coder and decoder drive it with the same ids in the same order."""

    def __init__(self, ids: int, lanes: int):
        self.ids, self.lanes, self.step = ids, lanes, 0
        self.count = np.ones(ids, np.int64)
        # ids and cases of both orders since the last sums
        self.seen: list[np.ndarray] = []
        self.cases: list[np.ndarray] = []
        self.sum_up()
        # a context's predicted id * 8 + its confidence, for orders 1 and 2
        self.tables = np.zeros(ids + 1, np.int32), np.zeros(1 << HASH_BITS, np.int32)
        self.hit = np.ones((2, 8))
        self.tried = np.full((2, 8), 4.0)
        self.rate()
        self.last = np.full(lanes, ids, np.int64)
        self.last2 = self.last.copy()

    def sum_up(self) -> None:
        self.cum = np.zeros(self.ids + 1, np.int64)
        np.cumsum(self.count, out=self.cum[1:])
        self.total = int(self.cum[-1])
        self.first = None

    def rate(self) -> None:
        self.weight = np.minimum((A * 15 // 16) * self.hit / self.tried, A * 15 // 16).astype(np.int64)
        self.weight[:, 0] = 0

    def predict(self, live: int) -> None:
        """Set the two predicted ids and the weights of the three orders for the first ``live`` lanes."""
        a, b = self.last[:live], self.last2[:live]
        self.at1, self.at2 = a, ((a * 0x9E3779B1 + b * 0x85EBCA6B) >> 7) & ((1 << HASH_BITS) - 1)
        self.e1, self.e2 = e1, e2 = self.tables[0].take(self.at1), self.tables[1].take(self.at2)
        self.q1, self.k1, self.q2, self.k2 = e1 >> 3, e1 & 7, e2 >> 3, e2 & 7
        w2 = self.weight[1].take(self.k2)
        w1 = (A - w2) * self.weight[0].take(self.k1) >> SHIFT
        same = w1 * (self.q1 == self.q2)
        w2 += same
        w1 -= same
        self.w0, self.w1, self.w2 = A - w1 - w2, w1 * self.total, w2 * self.total

    def interval(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids ``s`` begin in the mixed distribution, and their widths."""
        start, width = self.w0 * self.cum.take(s), self.w0 * self.count.take(s)
        for q, w in ((self.q1, self.w1), (self.q2, self.w2)):
            start += w * (q < s)
            width += w * (q == s)
        return start, width

    def find(self, u: np.ndarray) -> np.ndarray:
        """The ids whose counts of order 0 hold ``u``: mostly the last id that begins before u's bucket of ``1 << BUCKET`` counts, else found by search."""
        if self.first is None:
            self.first = np.cumsum(np.bincount((self.cum[:-1] + ((1 << BUCKET) - 1)) >> BUCKET, minlength=(self.total >> BUCKET) + 1)) - 1
        s = self.first.take(u >> BUCKET, mode="clip")
        further = np.flatnonzero(self.cum.take(s + 1) <= u)
        s[further] = np.searchsorted(self.cum, u.take(further), "right") - 1
        return s

    def locate(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose intervals of the mixed distribution hold ``v``, where those begin and their widths."""
        # what a prediction adds lies where its id begins: from the end of that id on, v has it before it
        rest, mine = v, []
        for q, w, before in ((self.q1, self.w1, self.w2 * (self.q2 < self.q1)), (self.q2, self.w2, self.w1 * (self.q1 < self.q2))):
            before += self.w0 * self.cum.take(q)
            past = v >= before + self.w0 * self.count.take(q) + w
            rest = rest - w * past
            mine.append((v >= before) > past)
        s = self.find((rest.view(U) // self.w0.view(U)).view(np.int64))
        s = np.where(mine[0], self.q1, np.where(mine[1], self.q2, s))
        if int(s.max()) >= self.ids:
            raise ValueError("a block of token ids is damaged")
        return s, *self.interval(s)

    def learn(self, ids: np.ndarray) -> None:
        live = len(ids)
        small = ids.astype(np.int32)
        new = (small << 3) + 1
        for table, at, e, q, k in ((self.tables[0], self.at1, self.e1, self.q1, self.k1), (self.tables[1], self.at2, self.e2, self.q2, self.k2)):
            case = k + ((q == small).view(np.int8) << 3)
            table[at] = np.where(case > 3, e + GAINS.take(case), new)
            self.cases.append(case)
        self.last2[:live] = self.last[:live]
        self.last[:live] = ids
        self.seen.append(ids)
        self.step += 1
        if self.step % EVERY == 0:
            new = np.concatenate(self.seen)
            self.seen.clear()
            for o in (0, 1):
                n = np.bincount(np.concatenate(self.cases[o::2]), minlength=16)
                self.hit[o] += n[8:]
                self.tried[o] += n[:8] + n[8:]
            self.cases.clear()
            self.count += np.bincount(new, minlength=self.ids) * GAIN
            if self.total + len(new) * GAIN > LIMIT + 40 * self.ids:
                self.count = (self.count + 1) >> 1
            self.sum_up()
            self.rate()


def _lanes(ids: np.ndarray, most: int) -> tuple[int, int]:
    lanes = max(1, min(most, len(ids) // 128))
    return lanes, -(-len(ids) // lanes)


def encode_block(ids: np.ndarray, n_ids: int, most_lanes: int = 4096) -> bytes:
    ids = np.asarray(ids, np.int64)
    lanes, steps = _lanes(ids, most_lanes)
    used = -(-len(ids) // steps) if len(ids) else 0
    head = MAGIC + struct.pack("<III", len(ids), used, zlib.crc32(ids.astype("<u4").tobytes()))
    if not used:
        return head
    rows = np.zeros(used * steps, np.int64)
    rows[: len(ids)] = ids
    rows = np.ascontiguousarray(rows.reshape(used, steps).T)
    short = used * steps - len(ids)
    m = Model(n_ids, used)
    low, rng = np.zeros(used, U), np.full(used, ~U(0), U)
    # words in the order of coding, and their lanes
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(steps):
        live = used if t < steps - short else used - 1
        s = rows[t, :live]
        m.predict(live)
        start, width = m.interval(s)
        r = rng[:live] // U(A * m.total)
        low[:live] += start.astype(U) * r
        rng[:live] = r * width.astype(U)
        _emit(low, rng, live, out)
        m.learn(s)
    for k in range(4):
        out.append(((low >> U(48 - 16 * k)).astype(np.uint16), np.arange(used)))
    words, lanes = np.concatenate([w for w, _ in out]), np.concatenate([i for _, i in out])
    lengths = np.bincount(lanes, minlength=used).astype("<u4")
    # sorting of 16 bits takes a few passes
    order = np.argsort(lanes.astype(np.uint16) if used <= 1 << 16 else lanes, kind="stable")
    return head + lengths.tobytes() + words.take(order).astype("<u2").tobytes()


def _ready(lo: np.ndarray, ra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a word is settled, or has to be as the range got small; and what the range becomes there."""
    done = (lo ^ (lo + ra)) < TOP
    where = np.flatnonzero(done | (ra < BOTTOM))
    ra = ra.take(where)
    short = np.flatnonzero(~done.take(where))
    if len(short):
        ra[short] = (~lo.take(where.take(short)) + U(1)) & (BOTTOM - U(1))
    return where, ra


def _emit(low: np.ndarray, rng: np.ndarray, live: int, out: list[tuple[np.ndarray, np.ndarray]]) -> None:
    i, lo, ra = None, low[:live], rng[:live]
    while True:
        where, ra = _ready(lo, ra)
        if not len(where):
            return
        lo, i = lo.take(where), where if i is None else i.take(where)
        out.append(((lo >> U(48)).astype(np.uint16), i))
        lo, ra = lo << U(16), ra << U(16)
        low[i], rng[i] = lo, ra


def decode_block(payload: bytes, n_ids: int) -> np.ndarray:
    """The ids of a block; ValueError where the checksum or the frame doesn't fit."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n, used, crc = struct.unpack_from("<III", payload, 4)
    if not used:
        return np.zeros(0, np.int64)
    lengths = np.frombuffer(payload, "<u4", used, 16).astype(np.int64)
    words = np.concatenate([np.frombuffer(payload, "<u2", -1, 16 + 4 * used).astype(U), np.zeros(8, U)])
    at = np.cumsum(lengths) - lengths
    steps = -(-n // used)
    if -(-n // steps) != used or int(lengths.sum()) != len(words) - 8:
        raise ValueError("a block of token ids is damaged")
    short = used * steps - n
    code = np.zeros(used, U)
    for k in range(4):
        code = (code << U(16)) | words[at + k]
    at = at + 4
    m = Model(n_ids, used)
    low, rng = np.zeros(used, U), np.full(used, ~U(0), U)
    rows = np.zeros((steps, used), np.int64)
    for t in range(steps):
        live = used if t < steps - short else used - 1
        m.predict(live)
        r = rng[:live] // U(A * m.total)
        v = np.minimum((code[:live] - low[:live]) // r, U(A * m.total - 1)).astype(np.int64)
        s, start, width = m.locate(v)
        low[:live] += start.astype(U) * r
        rng[:live] = r * width.astype(U)
        i, lo, ra = None, low[:live], rng[:live]
        while True:
            where, ra = _ready(lo, ra)
            if not len(where):
                break
            lo, i = lo.take(where) << U(16), where if i is None else i.take(where)
            ra <<= U(16)
            here = at.take(i)
            code[i] = (code.take(i) << U(16)) | words.take(here, mode="clip")
            at[i] = here + 1
            low[i], rng[i] = lo, ra
        rows[t, :live] = s
        m.learn(s)
    ids = np.ascontiguousarray(rows.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of token ids fails its checksum")
    return ids


BLOCK = "part int, block int, doc_ids array<long>, lengths array<long>, n_tokens long, payload binary"


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, block_tokens: int = 1_000_000, n_ids: int = 49_408) -> None:
    """Encode ``docs`` and write their blocks under ``path`` in ascending doc_id order.

    Documents are dealt by ranges of doc_id and sorted in each; a task gathers whole documents until a block has
    ``block_tokens`` ids (a longer document makes a longer block). Null or empty text is the end id alone; null doc_ids come
    first; rows that share a doc_id follow each other by their text's hash. Other columns are ignored. ``n_ids`` bounds the ids.
    """
    spark = prepare(docs.sparkSession)
    tokenizer = tokenizer or default_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def flush():
            payload = encode_block(np.frombuffer(b"".join(x for _, x in held), "<u4"), n_ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())), "lengths": pa.array([[len(x) // 4 for _, x in held]], pa.list_(pa.int64())), "n_tokens": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), enc.many(b.column(1).to_pylist(), end), strict=True):
                if held and size + len(x) // 4 > block_tokens:
                    yield flush()
                    block, held, size = block + 1, [], 0
                held.append((d, x))
                size += len(x) // 4
        if held:
            yield flush()

    parts = n_partitions(spark)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id")
    ordered = dealt.sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str, n_ids: int = 49_408) -> DataFrame:
    """A row for each document of the files under ``path``: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit).

    Blocks are decoded independently and checked against their checksums. Starts come from the blocks' sizes alone: a running
    sum within each part, and over the parts' totals.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    sizes = blocks.select("part", "block", "n_tokens")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    starts = sizes.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "part").select("part", "block", (F.col("within") + F.col("before")).alias("start"))

    def run(b):
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids")}
        for docs, lengths, payload, start in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            raw, at = decode_block(payload, n_ids).astype("<u4").tobytes(), 0
            for d, n in zip(docs, lengths, strict=True):
                for k, v in zip(out, (d, start + at, n, raw[4 * at : 4 * (at + n)]), strict=True):
                    out[k].append(v)
                at += n
        return out

    rows = blocks.drop("n_tokens").join(starts, ["part", "block"]).select("doc_ids", "lengths", "payload", "start")
    return map_batches(rows, run, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/framelark-tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["decode_block", "encode_block", "op4_token_files", "read_token_files", "write_token_files"]
