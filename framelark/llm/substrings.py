"""Byte strings that repeat across documents, decided on bytes.

Documents are packed into shards of a few megabytes. Two rounds of questions and answers between shards and buckets of hashes leave the
places that may repeat; the strings there go to buckets of anchors, whose suffixes external induced sorting orders with their common prefixes, and
every shard gets back the least document of each string.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, documents, fingerprint, mix, prepare, release
from .induced import sorted_suffixes

LENGTH = 50
#: Bytes of text in a shard (a longer document makes a longer one), and of text for each bucket.
SHARD_BYTES, BUCKET_BYTES = 1 << 20, 2 << 20
_A, _B, _POS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64((1 << 30) - 1)
_NONE = (1 << 63) - 1
SHARD = "shard binary, a array<long>, b array<long>, doc array<long>, sizes array<long>, data binary"
ASKED = "shard binary, bucket int, keys binary, flags binary"
ANSWER = "shard binary, bucket int, bits binary"


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = (x * _A + y) * _B
    return h ^ (h >> np.uint64(31))


def gram_hashes(data: np.ndarray, of_40: bool = True, of_50: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Hashes of all runs of 24, and where asked for of 40 and of 50 bytes."""
    h2 = _pair(data[:-1].astype(np.uint64) + np.uint64(1), data[1:].astype(np.uint64) + np.uint64(1))
    h4 = _pair(h2[:-2], h2[2:])
    h8 = _pair(h4[:-4], h4[4:])
    h16 = _pair(h8[:-8], h8[8:])
    h24 = _pair(h16[:-8], h8[16:])
    h50 = None
    if of_50:
        h48 = _pair(h24[:-24], h24[24:])
        h50 = mix(_pair(h48[:-2], h2[48:]))
    return h24, mix(_pair(h24[:-16], h24[16:])) if of_40 else None, h50


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours."""
    step = 1
    while 2 * step <= n:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    return np.minimum(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


class Shard:
    """One shard in a task: its bytes, whose they are, and the strings of ``LENGTH`` bytes that lie in one document."""

    def __init__(self, row: dict, of_40: bool = True, of_50: bool = True):
        self.id, self.doc = row["shard"], np.array(row["doc"], np.int64)
        self.sizes, self.data = np.array(row["sizes"], np.int64), np.frombuffer(row["data"], np.uint8)
        self.ends = np.cumsum(self.sizes)
        n = max(0, len(self.data) - LENGTH + 1)
        self.of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)[:n]
        self.valid = np.arange(n) + LENGTH <= self.ends[self.of] if n else np.zeros(0, bool)
        if n:
            self.h24, h40, self.h50 = gram_hashes(self.data, of_40, of_50)
            #: A string of 50 bytes holds eleven runs of 40; the least of their hashes speaks for it.
            self.h40 = sliding_min(h40, LENGTH - 39) if of_40 else None
        else:
            self.h24 = self.h40 = self.h50 = np.zeros(0, np.uint64)

    def ask(self, at: np.ndarray, h: np.ndarray, buckets: int):
        """Distinct hashes of the strings at ``at``, sorted: their buckets, what is sent of each, whether two documents here have it."""
        key, of = h[at], self.of[at]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        key, of = key[first], of[first]
        # documents ascend along a shard, so a stable sort leaves those of one hash in order
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        last = np.append(starts[1:], len(key)) - 1
        return key[starts], of[starts] != of[last] if len(key) else np.zeros(0, bool)

    def hot(self, at: np.ndarray, h: np.ndarray, buckets: int, answers) -> np.ndarray:
        """Which of the strings at ``at`` the buckets know from two documents; the question is worked out again."""
        key = h[at]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        distinct, back = np.unique(key[first], return_inverse=True)
        edges = _edges(distinct, buckets)
        bits = np.zeros(len(distinct), bool)
        for bucket, blob in answers:
            lo, hi = edges[bucket], edges[bucket + 1]
            bits[lo:hi] = np.unpackbits(np.frombuffer(blob, np.uint8), count=hi - lo)
        return bits[back][np.cumsum(first) - 1] if len(key) else first


def _edges(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    at = (sorted_keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))


def _questions(shard: Shard, at: np.ndarray, h: np.ndarray, buckets: int):
    keys, many = shard.ask(at, h, buckets)
    edges, low = _edges(keys, buckets), keys.astype(np.uint32)
    for k in np.flatnonzero(edges[1:] > edges[:-1]):
        lo, hi = edges[k], edges[k + 1]
        yield shard.id, int(k), low[lo:hi].tobytes(), np.packbits(many[lo:hi]).tobytes()


def _rows(batches, make, names: list[str], types: list, most: int = 16 << 20):
    """Record batches of the tuples that ``make`` yields for each row, cut by their bytes."""
    out, size = [], 0
    table = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    for b in batches:
        for i in range(b.num_rows):
            for r in make({n: b.column(n)[i].as_py() for n in b.schema.names}):
                out.append(r)
                size += sum(len(x) for x in r if isinstance(x, bytes))
                if size > most:
                    yield table()
                    out, size = [], 0
    if out:
        yield table()


def shards(unique: DataFrame) -> DataFrame:
    """Documents (a, b, doc_id, text) packed into rows of about ``SHARD_BYTES``; shorter ones than ``LENGTH`` bytes come along."""

    def run(batches):
        held, size = [], 0

        def row():
            a, b, d, t = zip(*held, strict=True)
            name = xxhash.xxh3_128_digest(np.array([a, b], np.int64).tobytes())
            return pa.RecordBatch.from_pydict({"shard": pa.array([name], pa.binary()), "a": [list(a)], "b": [list(b)], "doc": pa.array([list(d)], pa.list_(pa.int64())), "sizes": [[len(x) for x in t]], "data": pa.array([b"".join(t)], pa.binary())})

        for batch in batches:
            for a, b, d, t in zip(*(batch.column(n).to_pylist() for n in ("a", "b", "doc_id", "text")), strict=True):
                held.append((a, b, d, t.encode("utf-8", "surrogatepass")))
                size += len(held[-1][3])
                if size >= SHARD_BYTES:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    return unique.select("a", "b", "doc_id", "text").mapInArrow(run, SHARD)


def _known_twice(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket: which of each shard's hashes stand in two documents."""
    keys = [np.frombuffer(k, np.uint32) for k in pdf["keys"]]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(k)).astype(bool) for f, k in zip(pdf["flags"], keys, strict=True)]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(new) - 1
    many = np.bincount(group) > 1
    many[group[np.concatenate(flags)[order]]] = True
    hot = np.empty(len(every), bool)
    hot[order] = many[group]
    cuts = np.split(hot, np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"shard": pdf["shard"], "bucket": pdf["bucket"], "bits": [np.packbits(c).tobytes() for c in cuts]})


def _answers(questions: DataFrame) -> DataFrame:
    """(shard, answers): what the buckets say, a row for each shard."""
    said = questions.where("bucket >= 0").groupBy("bucket").applyInPandas(_known_twice, ANSWER)
    return said.groupBy("shard").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))


def contexts(shard: Shard, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first string and number of strings of each run of hot strings with one anchor, the least of the 24-byte runs inside them."""
    n = len(hot)
    m = sliding_min((mix(shard.h24) & ~_POS) | (np.arange(len(shard.h24), dtype=np.uint64) & _POS), LENGTH - 23)[:n]
    on = np.flatnonzero(hot)
    if not len(on):
        return on.astype(np.uint64), on, on
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (m[on][1:] != m[on][:-1]) | (shard.of[on][1:] != shard.of[on][:-1])
    first = on[new]
    count = np.diff(np.append(np.flatnonzero(new), len(on)))
    return mix(shard.h24[(m[first] & _POS).astype(np.int64)]), first, count


def least_docs(data: np.ndarray, begins: np.ndarray, counts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every string of 50 bytes of some contexts the least document with it.

    The contexts' suffixes are sorted by induction; strings are equal where no common prefix between their suffixes falls below 50 bytes.
    ``data``: the contexts' bytes one after another; ``begins``, ``counts``: where each starts and its number of strings; ``doc``: its document.
    """
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    number = np.full(len(data), -1, np.int32)
    number[at] = np.arange(len(at))
    order, group, groups = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for places, prefix in sorted_suffixes(data, LENGTH):
        of = groups + np.cumsum(prefix < LENGTH, dtype=np.int32)
        groups, mine = int(of[-1]), number[places] >= 0
        order.append(number[places[mine]])
        group.append(of[mine])
    order, group = np.concatenate(order), np.concatenate(group)
    out = np.empty(len(at), np.int64)
    if len(at):
        new = np.concatenate([[True], group[1:] != group[:-1]])
        out[order] = np.minimum.reduceat(np.repeat(doc, counts)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _sorted_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket of contexts: to each shard the least documents of its strings, in the order it sent them. Equal contexts are sorted once."""
    counts = [np.frombuffer(c, np.uint8).astype(np.int64) for c in pdf["counts"]]
    place: dict[bytes, int] = {}
    number, low = [], []
    for blob, n, docs in zip(pdf["bytes"], counts, pdf["docs"], strict=True):
        ends = np.cumsum(n + LENGTH - 1)
        for e, size, d in zip(ends.tolist(), (n + LENGTH - 1).tolist(), np.frombuffer(docs, np.int64).tolist(), strict=True):
            i = place.setdefault(blob[e - size : e], len(place))
            if i == len(low):
                low.append(d)
            elif d < low[i]:
                low[i] = d
            number.append(i)
    sizes = np.fromiter(map(len, place), np.int64, len(place))
    each = sizes - LENGTH + 1
    found = least_docs(np.frombuffer(b"".join(place), np.uint8), np.cumsum(sizes) - sizes, each, np.array(low, np.int64))
    ends = np.cumsum(each)
    answers, i = [], 0
    for n in counts:
        own = [found[ends[k] - each[k] : ends[k]] for k in number[i : i + len(n)]]
        i += len(n)
        answers.append(zlib.compress(np.concatenate(own).tobytes(), 1))
    return pd.DataFrame({"shard": pdf["shard"], "bucket": pdf["bucket"], "least": answers})


def repeated_bytes(docs: DataFrame, digest: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay; with ``digest`` their SHA-256).

    Every byte covered by a 50-byte string that also starts in a document with a smaller doc_id goes; overlaps count and strings are judged on
    the input. Null text is empty. Texts under 50 bytes stay whole. Rows that share a doc_id don't count as smaller than one another; a null doc_id counts
    as the largest there is (2^63 - 1, and isn't larger than that very id). No rows give no rows; other columns are ignored.

    Of equal texts only the one with the least doc_id is searched; the others go whole. The rest is packed into shards. First every shard asks
    buckets of hashes which of its 40-byte minimizers stand in two documents, then the same for the 50-byte strings that are left: 32 bits of a
    hash a question, a bit an answer, so what passes by chance is some thousandth and costs time only. The strings left are cut into contexts by anchors (24-byte
    minimizers), which depend on a string's bytes alone, and sorted in buckets of anchors by external induced sorting (``induced``); a shard sends equal contexts once, so a
    passage of very many documents reaches its bucket once a shard. Answers go back by shard: no bitmap, list or table of the corpus is broadcast.
    """
    spark = prepare(docs.sparkSession)
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    rows = docs.select(F.col("doc_id").cast("long").alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", fingerprint())
    unique = rows.groupBy("fp.a", "fp.b").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    packed = keep(shards(unique), "shards")
    total = packed.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    buckets = max(8, -(-total // BUCKET_BYTES))
    asked = ["shard", "bucket", "keys", "flags"], [pa.binary(), pa.int32(), pa.binary(), pa.binary()]

    def first(row):
        s = Shard(row, of_50=False)
        return _questions(s, np.flatnonzero(s.valid), s.h40, buckets)

    def second(row):
        s = Shard(row)
        at = np.flatnonzero(s.valid)
        at = at[s.hot(at, s.h40, buckets, [(x["bucket"], x["bits"]) for x in row["answers"]])]
        left = np.zeros(len(s.valid), bool)
        left[at] = True
        yield s.id, -1, zlib.compress(np.packbits(left).tobytes(), 1), b""
        yield from _questions(s, at, s.h50, buckets)

    def third(row):
        s = Shard(row, of_40=False)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(row["mask"]), np.uint8), count=len(s.valid)))
        hot = np.zeros(len(s.valid), bool)
        hot[at[s.hot(at, s.h50, buckets, [(x["bucket"], x["bits"]) for x in row["answers"] or []])]] = True
        anchor, begin, count = contexts(s, hot)
        if not len(begin):
            return
        order = np.argsort(anchor, kind="stable")
        edges = _edges(anchor[order], buckets)
        doc, text = s.doc[s.of[begin]], s.data.tobytes()
        where = [np.empty(0, "<u4")] * 4
        for k in np.flatnonzero(edges[1:] > edges[:-1]):
            place: dict[bytes, int] = {}
            low: list[int] = []
            mine = order[edges[k] : edges[k + 1]]
            number = np.empty(len(mine), "<u4")
            for j, (x, n, d) in enumerate(zip(begin[mine].tolist(), count[mine].tolist(), doc[mine].tolist(), strict=True)):
                i = number[j] = place.setdefault(text[x : x + n + LENGTH - 1], len(place))
                if i == len(low):
                    low.append(d)
                elif d < low[i]:
                    low[i] = d
            sizes = np.fromiter(map(len, place), np.int64, len(place)) - LENGTH + 1
            where = [np.concatenate([w, x]) for w, x in zip(where, (begin[mine].astype("<u4"), count[mine].astype("<u4"), np.full(len(mine), k, "<u4"), number), strict=True)]
            yield s.id, int(k), sizes.astype(np.uint8).tobytes(), np.array(low, np.int64).tobytes(), b"".join(place)
        yield s.id, -1, zlib.compress(np.stack(where).tobytes(), 1), b"", b""

    one = packed.mapInArrow(lambda b: _rows(b, first, *asked), ASKED)
    said = keep(_answers(one), "first")
    both = packed.join(said, "shard", "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<struct<bucket:int,bits:binary>>")))
    two = keep(both.mapInArrow(lambda b: _rows(b, second, *asked), ASKED), "second")
    again = keep(_answers(two), "third")
    masks = two.where("bucket < 0").select("shard", F.col("keys").alias("mask"))
    both = packed.join(masks, "shard").join(again, "shard", "left")
    kinds = ["shard", "bucket", "counts", "docs", "bytes"], [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    sent = keep(both.mapInArrow(lambda b: _rows(b, third, *kinds), "shard binary, bucket int, counts binary, docs binary, bytes binary"), "contexts")
    release(*made[1:-1])
    least = sent.where("bucket >= 0").groupBy("bucket").applyInPandas(_sorted_bucket, "shard binary, bucket int, least binary")
    least = keep(least.groupBy("shard").agg(F.collect_list(F.struct("bucket", "least")).alias("answers")), "least")
    final = (lambda x: hashlib.sha256(x).digest()) if digest else bytes

    def strip(row):
        s_doc, sizes, data = np.array(row["doc"], np.int64), np.array(row["sizes"], np.int64), np.frombuffer(row["data"], np.uint8)
        edge, of = np.zeros(len(data) + 1, np.int32), np.repeat(np.arange(len(sizes)), sizes)
        if row["sent"]:
            begin, count, bucket, number = np.frombuffer(zlib.decompress(row["sent"]), "<u4").reshape(4, -1).astype(np.int64)
            for x in row["answers"]:
                mine = np.flatnonzero(bucket == x["bucket"])
                low, each = np.frombuffer(zlib.decompress(x["least"]), np.int64), np.zeros(number[mine].max() + 1, np.int64)
                each[number[mine]] = count[mine]
                n, start = count[mine], np.cumsum(each) - each
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(begin[mine], n) + inside
                at = at[low[np.repeat(start[number[mine]], n) + inside] < s_doc[of[at]]]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + LENGTH, -1)
        cover = np.cumsum(edge[:-1]) > 0
        end = 0
        for a, b, d, n in zip(row["a"], row["b"], s_doc.tolist(), sizes.tolist(), strict=True):
            x, gone, end = data[end : end + n], cover[end : end + n], end + n
            runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if n else 0
            yield a, b, d, n, int(gone.sum()), runs, final(x[~gone].tobytes())

    names = ["a", "b", "least", "n_bytes", "n_removed", "n_spans", "kept"]
    types = [pa.int64()] * 6 + [pa.binary()]
    own = packed.join(sent.where("bucket < 0").select("shard", F.col("counts").alias("sent")), "shard", "left").join(least, "shard", "left")
    stripped = cut(own.mapInArrow(lambda b: _rows(b, strip, names, types), "a long, b long, least long, n_bytes long, n_removed long, n_spans long, kept binary"), "stripped")
    release(*made)
    everyone = rows.select("own", "doc_id", F.col("fp.a").alias("x"), F.col("fp.b").alias("y"))
    joined = everyone.join(stripped, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    whole = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    return joined.select(
        F.col("own").alias("doc_id"), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(whole, F.lit(final(b""))).otherwise(F.col("kept")).alias("kept"),
    )


def op7_repeated_bytes(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(documents(spark, sf_dir), digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all strings; for small inputs."""
    first: dict[bytes, int] = {}
    data = {d: (t or "").encode() for d, t in rows}
    for d in sorted(data):
        for i in range(len(data[d]) - LENGTH + 1):
            first.setdefault(data[d][i : i + LENGTH], d)
    out = {}
    for d, x in data.items():
        cover = np.zeros(len(x), bool)
        for i in range(len(x) - LENGTH + 1):
            if first[x[i : i + LENGTH]] < d:
                cover[i : i + LENGTH] = True
        runs = int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(x) else 0
        out[d] = (len(x), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~cover])).hexdigest())
    return out


__all__ = ["brute_force", "op7_repeated_bytes", "repeated_bytes"]
