"""Benchmark passages in documents, found by spaced seeds and verified with substitutions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, clean, cut, documents, fingerprint, fresh, map_batches, mix, prepare, words

#: Masks of six words. 0: ignored. Every stretch of 12 equal words or more, 80 % or more of it equal, holds a hit of one of them wherever
#: its substitutions lie (the tests enumerate this).
MASKS = ("1011001011", "1111011", "11100100011")
#: A filter of fixed size has a bitmap for each of three runs of this many bits of a seed.
BITS, RUNS = 21, (43, 22, 1)


def least_equal(n_words: int, min_words: int) -> float:
    """Equal words that an overlap with an item of ``n_words`` needs."""
    return min(min_words, 0.8 * n_words)


def masks_for(min_words: int, min_share: float) -> tuple[str, ...]:
    """Masks of which one hits in every overlap of ``min_words`` equal words: ``MASKS``, or a run that no looser overlap can do without."""
    if min_words >= 12 and min_share >= 0.8:
        return MASKS
    run = lambda e: -(-e // (math.floor(e * (1 - min_share) / max(min_share, 1e-9) + 1e-9) + 1))
    return ("1" * max(1, min(run(e) for e in range(min_words, min_words + 200))),)


def item_masks(n: int) -> tuple[int, tuple[str, ...]]:
    """For an item of ``n`` words, too few for ``masks_for``: how many may differ, and masks over the whole item of which one avoids those.

    The item has two parts more than words that may differ; a mask takes two of the parts.
    """
    k = n - math.ceil(0.8 * n - 1e-9)
    if k == 0:
        return 0, ("1" * n,)
    parts = np.array_split(np.arange(n), k + 2)
    return k, tuple("".join("1" if i in (*x, *y) else "0" for i in range(n)) for x, y in itertools.combinations(parts, 2))


def seed_hashes(ids: np.ndarray, masks: tuple[str, ...], short: tuple[int, ...] = (), whole: bool = False) -> list[tuple[int, np.ndarray]]:
    """For each mask, then for each mask of each short length: the first place (below 0 where an item may begin before the text), and the hash at each place from there on.

    ``whole``: ``ids`` is an item, which nothing goes before or after.
    """
    todo = [(number, mask, 0) for number, mask in enumerate(masks)]
    for n in short:
        k, own = item_masks(n)
        todo += [(1000 + 100 * n + j, mask, 0 if whole else k) for j, mask in enumerate(own)]
    out = []
    for number, mask, pad in todo:
        x = np.concatenate([edge := np.zeros(pad, np.uint64), ids, edge]) if pad else ids
        n = len(x) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, 0xA5A5 + number, np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                h = (h + x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        out.append((-pad, mix(h)))
    return out


def diagonal_overlaps(same: np.ndarray, need: float, share: float) -> list[tuple[int, int, int]]:
    """Stretches of a diagonal with ``need`` equal words or more, ``share`` of them equal: start, length, equal words.

    The stretch with the most equal words, then the same to its left and to its right; empty only if no stretch holds.
    """
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        equal = np.concatenate([[0], np.cumsum(same[lo:hi])])
        if equal[-1] < need - 1e-9:
            continue
        level = np.round(equal - share * np.arange(hi - lo + 1), 9)
        # for each end the first start from which the share holds
        start = np.searchsorted(-np.minimum.accumulate(level), -level)
        gain = equal - equal[start]
        j = int(gain.argmax())
        if gain[j] < max(need - 1e-9, 1):
            continue
        i = lo + int(start[j])
        i += int(same[i : lo + j].argmax())
        out.append((i, lo + j - i, int(gain[j])))
        todo += [(lo, i), (lo + j, hi)]
    return out


def bench_tokens(benchmark: DataFrame) -> DataFrame:
    """item_id and its word hashes; items without a word are left out."""

    def run(b):
        h, out = WordHashes(clean=clean), {"item_id": [], "item": []}
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words(t)
            if w:
                out["item_id"].append(d)
                out["item"].append(h.of(w).view(np.int64))
        return out

    return map_batches(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), run, "item_id long, item array<long>")


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 12, min_share: float = 0.8, masks: tuple[str, ...] | None = None) -> DataFrame:
    """Overlaps of documents with benchmark items: doc_id, a, b (the text's hashes), item_id, doc_start, item_start, n_words, n_equal.

    Words are runs without white space, A-Z lower-cased, without punctuation at their ends. Masks (``masks_for`` by default) pick
    words out of every window; a window of a document and one of an item with equal picked words are a hit. The texts
    are compared word by word along the whole diagonal of a hit. An overlap holds where
    ``min_share`` of its words are equal and those are ``min_words`` or more (or 80 % of a shorter item). Items too
    short for ``min_words`` have masks of their own length (``item_masks``).

    Documents are hashed where they are read. A filter of fixed size (three bitmaps of 2^21 bits, whatever the benchmark) sorts out
    nearly all windows whose hash no item has; the rest are joined with the items' hashes, and only documents with a hit send their words on.
    """
    spark = prepare(docs.sparkSession)
    items = cut(bench_tokens(benchmark), "items")
    few = min(min_words, 12)
    masks = masks or masks_for(few, min_share)
    lengths = [r[0] for r in items.where(F.size("item") < 2 * few).select(F.size("item").alias("n")).distinct().sort("n").collect()]  # 23 at most
    short = tuple(n for n in lengths if least_equal(n, few) < few)

    def item_seeds(b):
        out: dict[str, list] = {"item_id": [], "seed": [], "item_at": []}
        for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.array(x, np.int64).view(np.uint64)
            own = tuple(n for n in short if n == len(ids))
            for _, h in seed_hashes(ids, () if own else masks, own, whole=True):
                out["item_id"] += [d] * len(h)
                out["seed"] += h.view(np.int64).tolist()
                out["item_at"] += range(len(h))
        return out

    seeds = cut(map_batches(items, item_seeds, "item_id long, seed long, item_at int"), "seeds")
    # 3 * 2^21 bits as words of 64 bits: 98,304 rows at most, however large the benchmark
    places = F.array(*(F.shiftrightunsigned("seed", r).bitwiseAND(F.lit((1 << BITS) - 1)) + i * (1 << BITS) for i, r in enumerate(RUNS)))
    bits = seeds.select(F.explode(places).alias("p")).selectExpr("cast(p div 64 as int) AS w", "shiftleft(1L, cast(p % 64 as int)) AS m").groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    table = np.zeros(len(RUNS) << (BITS - 6), np.uint64)
    for r in bits:
        table[r["w"]] = np.uint64(r["m"] & 0xFFFFFFFFFFFFFFFF)
    bitmap = spark.sparkContext.broadcast(table)

    def probe(batches):
        have = np.unpackbits(bitmap.value.view(np.uint8), bitorder="little").astype(bool).reshape(len(RUNS), -1)
        h, low = WordHashes(clean=clean), np.uint64((1 << BITS) - 1)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for d, x, y, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids = h.of(words(t))
                at, seed = [], []
                for first, s in seed_hashes(ids, masks, short):
                    hit = np.flatnonzero(have[0][(s >> np.uint64(RUNS[0])) & low])
                    for i, r in enumerate(RUNS[1:], 1):
                        hit = hit[have[i][(s[hit] >> np.uint64(r)) & low]]
                    at.append((hit + first).astype(np.int32))
                    seed.append(s[hit].view(np.int64))
                if sum(map(len, at)):
                    for k, v in zip(out, (d, x, y, np.concatenate(at), np.concatenate(seed), ids.view(np.int64)), strict=True):
                        k.append(v)
            if out[0]:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in zip(out, types, strict=True)], names=["doc_id", "a", "b", "at", "seed", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("fp", fingerprint()).select("doc_id", "fp.a", "fp.b", "text")
    probed = cut(rows.mapInArrow(probe, "doc_id long, a long, b long, at array<int>, seed array<long>, tokens array<long>"), "probed")
    hits = probed.select("doc_id", "a", "b", F.explode(F.arrays_zip("at", "seed")).alias("h")).select("doc_id", "a", "b", F.col("h.at").alias("doc_at"), F.col("h.seed").alias("seed"))
    lines = hits.join(seeds, "seed").withColumn("diagonal", F.col("doc_at") - F.col("item_at"))
    lines = lines.select(F.struct("doc_id", "a", "b").alias("k"), "item_id", "diagonal").distinct()
    texts = probed.select(F.struct("doc_id", "a", "b").alias("key"), "tokens").dropDuplicates(["key"])
    pairs = lines.join(items, "item_id").join(texts, F.col("k").eqNullSafe(F.col("key")))
    # where the two lie on one another
    lo, hi = F.greatest(F.lit(0), -F.col("diagonal")), F.least(F.size("item"), F.size("tokens") - F.col("diagonal"))
    part = lambda c, at: F.slice(c, at + 1, hi - lo)
    pairs = pairs.select("key.doc_id", "key.a", "key.b", "item_id", "diagonal", lo.alias("lo"), F.size("item").alias("n"), part("tokens", lo + F.col("diagonal")).alias("tokens"), part("item", lo).alias("item"))

    def verify(b):
        out: dict[str, list] = {k: [] for k in ("doc_id", "a", "b", "item_id", "doc_start", "item_start", "n_words", "n_equal")}
        doc, item = b.column("tokens"), b.column("item")
        for i, (d, x, y, it, g, lo, size) in enumerate(zip(*(b.column(k).to_pylist() for k in ("doc_id", "a", "b", "item_id", "diagonal", "lo", "n")), strict=True)):
            same = doc[i].values.to_numpy() == item[i].values.to_numpy()
            for start, n, equal in diagonal_overlaps(same, least_equal(size, min_words), min_share):
                for k, v in zip(out, (d, x, y, it, lo + start + g, lo + start, n, equal), strict=True):
                    out[k].append(v)
        return out if out["doc_id"] else None

    return map_batches(pairs, verify, "doc_id long, a long, b long, item_id long, doc_start int, item_start int, n_words int, n_equal int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with ``item_ids`` (sorted distinct items that a document overlaps with, empty if none), ``n_overlaps`` and ``contaminated``.

    See ``overlaps`` for what counts and for ``options``. Null, empty or wordless text overlaps with nothing. Rows that share a doc_id are
    judged by their own texts. All other columns of ``docs`` stay; columns named as these three are replaced. An empty benchmark finds nothing.
    """
    found = overlaps(docs, benchmark, **options).groupBy("doc_id", "a", "b").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_overlaps"))
    rows = docs.drop("item_ids", "n_overlaps", "contaminated")
    key, own = fresh(rows, "_key"), fresh(rows, "_own")
    found = found.select(F.struct("doc_id", "a", "b").alias(own), "item_ids", "n_overlaps")
    rows = rows.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b")))
    joined = rows.join(found, F.col(key).eqNullSafe(F.col(own)), "left").drop(key, own)
    return joined.withColumn("contaminated", F.col("item_ids").isNotNull()).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<long>"))).withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0).cast("long")))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", (~F.col("contaminated")).alias("kept"), "n_overlaps", "item_ids")
