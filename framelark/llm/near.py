"""Near-duplicate documents: SuperMinHash signatures, bands, confirmed links, union-find groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import WordHashes, cut, documents, fingerprint, map_batches, mix, prepare, release, shingles, words

SLOTS, BANDS = 128, 32
#: Share of equal signature slots under which a pair isn't looked at again in mixed buckets: 0.8 less 4.5 standard errors.
LIKELY = 0.64
#: Shingles (and 64 a row), or rows, of a block.
SET_BLOCK, SIGNATURE_BLOCK = 1 << 18, 2048
#: Edges that one task may take at the end of ``components``.
LAST_EDGES = 50_000
_GOLD, _TOP = np.uint64(0x9E3779B97F4A7C15), ~np.uint64(0)
_STEPS = np.arange(1, SLOTS + 1, dtype=np.uint64) * _GOLD


def super_min_hash(items: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of ``n_docs`` sets; ``items`` holds all elements' hashes and ``doc`` whose they are.

    Each element shuffles the slots by Fisher and Yates with random numbers of its own. Its ``j``-th slot gets rank ``j`` plus a random
    fraction, and a slot keeps the least value over all elements. Ranks go up in step for all documents, so once all slots of one have
    a value, no later rank can lower any of them, and the document stops early. Shuffles aren't stored: a slot is traced back through its element's swaps.
    """
    table, swaps = np.full(n_docs * slots, _TOP), []
    for j in range(slots):
        if not len(items):
            break
        r = mix(items + _STEPS[j])
        k = (np.uint64(j) + (r >> np.uint64(32)) % np.uint64(slots - j)).astype(np.int16)
        at = k.copy()
        for i in range(j - 1, -1, -1):
            at[swaps[i] == at] = i
        swaps.append(k)
        np.minimum.at(table, doc * slots + at, (np.uint64(j) << np.uint64(40)) | (mix(r) >> np.uint64(24)))
        full = (table.reshape(n_docs, slots) != _TOP).all(1)
        if full.any():
            go = ~full[doc]
            items, doc, swaps = items[go], doc[go], [s[go] for s in swaps]
    return table.reshape(n_docs, slots)


def bands_of(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        h = mix(h * _GOLD + parts[:, :, i])
    return h.view(np.int64)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a, b (hashes of the text), n (set size), c (hash of the set), bands, sig (a byte for each slot)."""
    hashes: list[WordHashes] = []

    def run(b):
        if not hashes:
            hashes.append(WordHashes())
        sets = [shingles(hashes[0].of(words(t)), k) for t in b.column(3).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        doc = np.repeat(np.arange(len(sets)), sizes)
        sig = super_min_hash(np.concatenate([np.zeros(0, np.uint64), *sets]), doc, len(sets))
        low = mix(sig).astype(np.uint8)
        own = bands_of(sig)
        return {"doc_id": b.column(0), "a": b.column(1), "b": b.column(2), "n": sizes.tolist(), "c": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "bands": [x if n else [] for x, n in zip(own, sizes, strict=True)], "sig": [x.tobytes() for x in low]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("fp", fingerprint()).select("doc_id", "fp.a", "fp.b", "text")
    return map_batches(rows, run, "doc_id long, a long, b long, n int, c binary, bands array<long>, sig binary")


def local_union(batches):
    """Union-find over one partition's edges: each node with the least of its group, as edges (u, v)."""
    up: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([top(x) for x in part], pa.binary())], names=["u", "v"])


def components(edges: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(c, root) for every node of ``edges`` (u, v: binary); nodes with one root are connected. Tables written on the way are added to ``made``.

    Each task first contracts its own edges with union-find. Then, round by round, each node is merged into the neighbour with the least
    random priority (its own included), which leaves a fraction of the nodes; edges follow, until ``LAST_EDGES`` at most are left for a last
    union-find. The rounds' parents are then composed backwards.
    """

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    levels, salt = [], 0
    edges = keep(edges.mapInArrow(local_union, "u binary, v binary"), "edges")
    while edges.count() > LAST_EDGES:
        rank = lambda x: F.xxhash64(F.lit(salt), x)  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.struct(rank("v").alias("r"), "v")).alias("m"))
        parents = keep(least.select(F.col("u").alias("c"), F.when(F.struct(F.col("m.r"), F.col("m.v")) < F.struct(rank("u").alias("r"), F.col("u").alias("v")), F.col("m.v")).otherwise(F.col("u")).alias("p")), "parents")
        levels.append(parents)
        step = edges.join(parents, edges["u"] == parents["c"]).select(F.col("p").alias("pu"), "v")
        step = step.join(parents, step["v"] == parents["c"]).select(F.col("pu").alias("u"), F.col("p").alias("v")).where("u <> v").distinct()
        edges, salt = keep(step.mapInArrow(local_union, "u binary, v binary"), "edges"), salt + 1
    last = edges.coalesce(1).mapInArrow(local_union, "u binary, v binary")
    roots = keep(last.select(F.col("u").alias("c"), F.col("v").alias("root")), "last")
    roots = roots.unionByName(roots.select(F.col("root").alias("c"), "root").distinct())
    for parents in reversed(levels):
        up = roots.select(F.col("c").alias("q"), "root")
        roots = parents.join(up, parents["p"] == up["q"], "left").select("c", F.coalesce("root", "p").alias("root"))
    return keep(roots, "roots")


def in_block_pairs(rows: DataFrame, most: int) -> DataFrame:
    """Rows of each key ``k`` dealt to pairs of blocks, so that every pair of rows with one of ``rest`` in it meets in one task.

    ``rows``: k, rest, c, w (weight) and more. The rows of ``rest`` and the others are cut into blocks of about ``most`` by a hash of ``c``.
    Adds i (a block of ``rest``), j (a block of ``rest`` from i on, or of the others: below 0) and left (the row belongs to block i), and sorts by
    them. Keys without a row of ``rest`` go. No task needs more than two blocks of a key at a time.
    """
    weigh = lambda x: F.ceil(F.coalesce(F.sum(F.when(x, F.col("w"))), F.lit(0)) / most).cast("int")
    sizes = rows.groupBy("k").agg(weigh(F.col("rest")).alias("nr"), weigh(~F.col("rest")).alias("nm")).where("nr > 0")
    count = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), left.alias("left"))
    own = F.col("b")
    of_rest = F.concat(F.transform(count(F.col("nr")), lambda x: place(F.least(own, x), F.greatest(own, x), own <= x)), F.transform(count(F.col("nm")), lambda x: place(own, -1 - x, F.lit(True))))
    of_main = F.transform(count(F.col("nr")), lambda x: place(x, -1 - own, F.lit(False)))
    dealt = rows.join(sizes, "k").withColumn("b", F.pmod(F.xxhash64("c"), F.when(F.col("rest"), F.col("nr")).otherwise(F.col("nm"))).cast("int"))
    dealt = dealt.select(*rows.columns, F.explode(F.when(F.col("rest"), of_rest).otherwise(of_main)).alias("p")).select(*rows.columns, "p.*")
    return dealt.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")


def links_in_blocks(dealt: DataFrame, percent: int, likely: float, k: int | None) -> DataFrame:
    """Links (u, v) inside the block pairs of ``in_block_pairs``; columns c, root, n, sig and, with ``k``, text.

    Pairs of different roots whose sizes allow it and of whose signatures ``likely`` of the slots agree are compared. With ``k`` their whole sets of
    ``k``-word shingles decide; without, the signatures' word is enough. Only links between what a task hasn't connected yet come
    out, so a task returns fewer links than it has rows, however many pairs it looks at.
    """
    columns = ["k", "i", "j", "left", "c", "root", "n", "sig"] + ["text"] * (k is not None)

    def meet(key, rows, h):
        same = key[1] == key[2]
        right = rows if same else [r for r in rows if not r[0]]
        left = rows if same else [r for r in rows if r[0]]
        if not left or not right or (same and len(rows) < 2):
            return
        names = [r[1] for r in right]
        sizes, sig = np.array([r[3] for r in right]), np.frombuffer(b"".join([r[4] for r in right]), np.uint8).reshape(-1, SLOTS)
        number: dict[bytes, int] = {}
        roots = [np.array([number.setdefault(r[2], len(number)) for r in x]) for x in (left, right)]
        # what is connected already: groups where whole sets decide, else only what this task has linked
        if k is None:
            number.clear()
            group = [np.array([number.setdefault(r[1], len(number)) for r in x]) for x in (left, right)]
        else:
            group = [roots[0].copy(), roots[1] if same else roots[1].copy()]
        if same:
            group[0] = group[1]
        if k is not None:
            sets = [shingles(h.of(words(r[5])), k) for r in right]
            own_sets = sets if same else [shingles(h.of(words(r[5])), k) for r in left]
            ends = np.cumsum([len(s) for s in sets])
            vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
            flag, begins = np.zeros(len(vocabulary), np.int64), ends - sizes
        for x, r in enumerate(left):
            near = (roots[1] != roots[0][x]) & (group[1] != group[0][x]) & (100 * np.minimum(r[3], sizes) >= percent * np.maximum(r[3], sizes))
            if same:
                near[: x + 1] = False
            near = np.flatnonzero(near)
            if likely and len(near):
                near = near[(sig[near] == np.frombuffer(r[4], np.uint8)).mean(1) >= likely]
            if k is not None and len(near):
                at = np.searchsorted(vocabulary, own_sets[x])
                at = at[vocabulary[np.minimum(at, len(vocabulary) - 1)] == own_sets[x]]
                flag[at] = 1
                if len(near) * 8 < len(right):
                    both = np.array([flag[flat[begins[y] : ends[y]]].sum() for y in near])
                else:
                    both = np.add.reduceat(flag[flat], begins)[near]
                flag[at] = 0
                near = near[100 * both >= percent * (r[3] + sizes[near] - both)]
            for y in near:
                a, b = group[0][x], group[1][y]
                if a != b:
                    for g in group[: 2 - same]:
                        g[g == b] = a
                    yield r[1], names[y]

    def run(batches):
        h, key, held = WordHashes(), None, []
        out: list[tuple[bytes, bytes]] = []
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(len(columns))), strict=True):
                if r[:3] != key:
                    if held:
                        out.extend(meet(key, held, h))
                    key, held = r[:3], []
                held.append(r[3:])
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if held:
            out.extend(meet(key, held, h))
        yield _edges(out)

    return dealt.select(columns).mapInArrow(run, "u binary, v binary")


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["u", "v"])


def with_rest(rows: DataFrame) -> DataFrame:
    """``rows`` (k, root, w, ...) with ``rest``: not of the key's heaviest root. Rows of one root need not meet."""
    heavy = rows.groupBy("k", "root").agg(F.sum("w").alias("w")).groupBy("k").agg(F.max_by("root", F.struct("w", "root")).alias("main"))
    return rows.join(heavy, "k").withColumn("rest", F.col("root") != F.col("main")).drop("main")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, likely: float = LIKELY) -> DataFrame:
    """A row for each row of ``docs``: doc_id, a, b (hashes of its text), n_shingles, component_id, kept, component (binary: a class of
    the component; null for a document without words).

    A document's set has its distinct ``k``-word shingles (see ``shingles``); words are runs without white space, A-Z lower-cased. Documents
    are linked where 100 * intersection >= ``percent`` * union, and ``component_id`` is the least doc_id reachable, itself included.
    Documents without words (null, empty, white space) are linked with nothing. Rows that share a doc_id are rows of their own; a null doc_id counts as
    larger than all others and is its own component where it stands alone. ``kept``: doc_id = component_id. No rows give no rows.

    Equal sets are one class. A class is first compared with the least class of the bucket that it shares most bands with, which settles large groups in
    one pass. Where groups found so still share a bucket, pairs of different groups with ``likely`` of their slots equal are
    linked into families, and inside a family every such pair is compared that could still join two groups. All comparisons take
    full sets and happen inside tasks, block by block; only links that join something come out. Two documents with similarity 0.8 share one of the 32
    bands of 4 slots with probability 1 - 5e-8. ``likely`` 0.64 lies 4.5 standard errors below 0.8; with ``likely`` 0 every pair of a bucket is compared.
    """
    prepare(docs.sparkSession)
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    signed = cut(_signed(docs, k), "signed")
    own = signed.where("n > 0")
    classes = keep(own.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows")), "classes")
    buckets = classes.select(F.explode("bands").alias("h"), "c")
    leaders = buckets.groupBy("h").agg(F.min("c").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "leader")
    shared = keep(buckets.join(leaders, "h"), "shared")
    first = shared.where("c <> leader").groupBy("c", "leader").agg(F.count(F.lit(1)).alias("m"))
    first = keep(first.groupBy("c").agg(F.max_by("leader", F.struct("m", "leader")).alias("k")), "first")
    wanted = shared.select("c").distinct().join(classes.select("c", "least", "n", "sig"), "c").select("c", F.col("least.doc_id").alias("_d"), F.col("least.a").alias("_a"), F.col("least.b").alias("_b"), "n", "sig")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("fp", fingerprint())
    match = source["fp.a"].eqNullSafe(F.col("_a")) & source["fp.b"].eqNullSafe(F.col("_b")) & source["doc_id"].eqNullSafe(F.col("_d"))
    # rows equal in id and text are one
    texts = keep(source.join(wanted, match).groupBy("c").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("sig").alias("sig"), (F.first("n") + 64).alias("w")), "texts")
    star = first.join(texts, "c").withColumn("rest", F.lit(False)).unionByName(first.select(F.col("k").alias("c")).distinct().join(texts, "c").withColumn("k", F.col("c")).withColumn("rest", F.lit(True)))
    links = keep(links_in_blocks(in_block_pairs(star.withColumn("root", F.col("c")), SET_BLOCK), percent, 0, k), "links")
    groups = components(links, made)
    placed = keep(shared.select("h", "c").join(groups, "c", "left").select("h", "c", F.coalesce("root", "c").alias("root")), "placed")
    several = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    mixed = keep(placed.join(several, "h").join(classes.select("c", "n", "sig"), "c").withColumnRenamed("h", "k").withColumn("w", F.lit(1)), "mixed")
    near = keep(links_in_blocks(in_block_pairs(with_rest(mixed), SIGNATURE_BLOCK), percent, likely, None), "near")
    families = components(near, made).withColumnRenamed("root", "k")
    kin = families.join(groups, "c", "left").join(texts, "c").withColumn("root", F.coalesce("root", "c"))
    kin = keep(kin, "kin")
    more = links_in_blocks(in_block_pairs(with_rest(kin), SET_BLOCK), percent, likely, k)
    links = keep(links.unionByName(more), "links")
    groups = components(links, made)
    ids = classes.select("c", F.col("least.doc_id").alias("least"), "rows").join(groups, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1").select("root", "component_id")
    named = cut(ids.select("c", "root").join(least, "root").select("c", "root", "component_id"), "named")
    release(*made)
    out = signed.select("doc_id", "a", "b", "n", "c").join(named, "c", "left")
    out = out.withColumn("component", F.when(F.col("n") > 0, F.coalesce("root", "c")))
    out = out.select("doc_id", "a", "b", "component", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir).select("doc_id", "text"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


__all__ = ["components", "near_groups", "op2_near_duplicates", "super_min_hash"]
