"""Periodic runs of words, found through Lyndon roots, and texts with each run collapsed to its first period."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import documents, map_batches, prepare

#: Words that are searched together, so that short texts share the fixed cost of array operations; a longer text is searched alone.
CHUNK_WORDS = 250_000


class Suffixes:
    """Suffix array, inverse and common prefixes of many sequences at once; ``lce`` answers how far two suffixes agree.

    ``symbols`` are the sequences' items one after another, ``ends`` the end of the sequence of each place. Suffixes stop at the
    end of their sequence. Ranks are refined by doubling; only suffixes that still share their rank are sorted again.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        n = len(symbols)
        self.n, self.ends = n, ends
        key = ends.astype(np.int64) * (int(symbols.max(initial=0)) + 1) + symbols
        self.sa = np.argsort(key, kind="stable").astype(np.int64)
        first = np.ones(n, bool)
        first[1:] = np.diff(key[self.sa]) != 0
        heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[self.sa] = heads
        apart = np.zeros(n, np.int64)
        levels, h = [rank.astype(np.int32)], 1
        slots = self._shared_slots(np.arange(n), heads)
        while len(slots):
            at = self.sa[slots]
            beyond = at + h
            inside = beyond < ends[at]
            second = np.where(inside, rank[np.where(inside, beyond, 0)] + 1, 0)
            pair = rank[at] * np.int64(n + 1) + second
            order = np.argsort(pair, kind="stable")
            self.sa[slots] = at[order]
            pair = pair[order]
            new = np.ones(len(slots), bool)
            new[1:] = np.diff(pair) != 0
            old_head = np.ones(len(slots), bool)
            old_head[1:] = np.diff(pair // np.int64(n + 1)) != 0
            apart[slots[new & ~old_head]] = h
            heads = np.maximum.accumulate(np.where(new, slots, 0))
            rank[self.sa[slots]] = heads
            levels.append(rank.astype(np.int32))
            slots = self._shared_slots(slots, heads)
            h *= 2
        self.rank = rank
        self._table([self._common(apart, levels)])

    @staticmethod
    def _shared_slots(slots: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Slots whose rank is not theirs alone; ``heads`` is sorted."""
        if len(slots) == 0:
            return slots
        same = np.diff(heads) == 0
        return slots[np.concatenate([same, [False]]) | np.concatenate([[False], same])]

    def _common(self, apart: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix with the one before it: they were told apart when ``apart`` items were known to agree, and what follows is read off earlier levels."""
        lcp = apart.copy()
        open_ = np.flatnonzero(apart >= 2)
        if len(open_):
            x, y, limit = self.sa[open_ - 1], self.sa[open_], apart[open_]
            got = limit.copy()
            for k in range(len(levels) - 1, -1, -1):
                step = 1 << k
                may = (step < limit) & (x + got + step <= self.ends[x]) & (y + got + step <= self.ends[y])
                i = np.flatnonzero(may)
                i = i[levels[k][x[i] + got[i]] == levels[k][y[i] + got[i]]]
                got[i] += step
            lcp[open_] = got
        return lcp.astype(np.int32)

    def _table(self, rows: list[np.ndarray]) -> None:
        """Sparse table: row k holds the minima of 2^k neighbours."""
        while 1 << len(rows) <= self.n:
            half = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1][: self.n - 2 * half + 1], rows[-1][half : self.n - half + 1]))
        self.minima = rows

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Items that the suffixes at ``i`` and ``j`` (different places) share at their beginnings."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for level in np.unique(k):
            m = k == level
            row = self.minima[level]
            out[m] = np.minimum(row[low[m]], row[high[m] - (1 << int(level))])
        return out


def next_smaller(rank: np.ndarray, ends: np.ndarray, rounds: int = 24) -> np.ndarray:
    """The next place of the same sequence with a smaller rank, or the sequence's end.

    Between a place and its pointer every rank is larger, so a pointer whose rank is still larger jumps to that one's pointer. All
    places jump at once for some rounds; the few still open are then settled from right to left, which takes linear time.
    """
    n = len(rank)
    to = np.arange(1, n + 1)
    active = np.flatnonzero(to < ends)
    active = active[rank[to[active]] > rank[active]]
    for _ in range(rounds):
        if not len(active):
            return to
        to[active] = to[to[active]]
        active = active[to[active] < ends[active]]
        active = active[rank[to[active]] > rank[active]]
    if len(active):
        ranks, pointers, stops = rank.tolist(), to.tolist(), ends.tolist()
        for i in active[::-1].tolist():
            j, r, stop = pointers[i], ranks[i], stops[i]
            while j < stop and ranks[j] > r:
                j = pointers[j]
            pointers[i] = j
        to = np.array(pointers, np.int64)
    return to


def runs_of(symbols: np.ndarray, starts: np.ndarray, min_words: int, min_repeats: int) -> np.ndarray:
    """Runs of several sequences as rows (sequence, start, length, period), by sequence, start, period.

    A run's Lyndon root, under the order of its symbols or the opposite one, is the longest Lyndon word at its place
    (runs theorem); that word ends before the next smaller rank of the inverse suffix array, or the next larger one for the opposite
    order. So two roots at each place are all candidates. Each is extended to the right and, on the reversed sequences, to the
    left. The leftmost root of a run begins in its first period, hence only roots that go on for ``min_repeats - 2`` periods matter.
    """
    n = int(starts[-1])
    if n == 0:
        return np.zeros((0, 4), np.int64)
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = starts[1:][doc]
    forward = Suffixes(symbols, ends)
    place = np.arange(n)
    i = np.concatenate([place, place])
    p = np.concatenate([next_smaller(forward.rank, ends) - place, next_smaller(-forward.rank, ends) - place])
    fits = i + p + max(0, min_repeats - 2) * p <= ends[i]
    i, p = i[fits], p[fits]
    right = np.zeros(len(i), np.int64)
    inside = np.flatnonzero(i + p < ends[i])
    inside = inside[symbols[i[inside]] == symbols[i[inside] + p[inside]]]
    right[inside] = forward.lce(i[inside], i[inside] + p[inside])
    going_on = right >= (min_repeats - 2) * p
    i, p, right = i[going_on], p[going_on], right[going_on]
    if not len(i):
        return np.zeros((0, 4), np.int64)

    used = np.unique(doc[i])
    back_starts = np.concatenate([[0], np.cumsum(sizes[used])])
    back = np.concatenate([symbols[starts[d] : starts[d + 1]][::-1] for d in used])
    slot = np.searchsorted(used, doc[i])
    backward = Suffixes(back, np.repeat(back_starts[1:], sizes[used]))
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > starts[doc[i]])
    mirror = back_starts[slot[inner]] + ends[i[inner]] - 1
    left[inner] = backward.lce(mirror - (i[inner] - 1), mirror - (i[inner] + p[inner] - 1))
    begin, length = i - left, p + right + left
    whole = length >= np.maximum(min_words, min_repeats * p)
    rows = np.stack([doc[i], begin - starts[doc[i]], length, p], 1)[whole]
    rows = np.unique(rows, axis=0)
    # where the opposite order meets a sequence's end, its word may be a power of the root: of one stretch the smallest period is the run's
    first = np.ones(len(rows), bool)
    first[1:] = np.any(np.diff(rows[:, :3], axis=0) != 0, axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapse(words: list, runs: np.ndarray) -> list:
    """``words`` without those that a run (rows start, length, period) contains after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [w for w, lost in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not lost]


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _search(texts: list[list[bytes]], min_words: int, min_repeats: int) -> list[np.ndarray]:
    """Runs of each text, in chunks."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_WORDS):
            size += len(texts[stop])
            stop += 1
        chunk = texts[at:stop]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in chunk])]).astype(np.int64)
        numbers: dict[bytes, int] = {}
        symbols = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in chunk for w in ws), np.int64, size)
        rows = runs_of(symbols, starts, min_words, min_repeats)
        bounds = np.searchsorted(rows[:, 0], np.arange(len(chunk) + 1))
        out.extend(rows[bounds[k] : bounds[k + 1], 1:] for k in range(len(chunk)))
        at = stop
    return out


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """Runs of periodic words of whole texts: doc_id, n_words, runs (by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period q, at least
    ``max(min_words, min_repeats * q)`` words long, that no neighbouring word extends keeping the period. ``collapsed`` is the text's
    words, joined by one space, without those that any run contains after its first q words. Null or empty text has no words, no runs and an
    empty ``collapsed``. Rows are independent: repeated or null doc_ids give a row each. Other columns are ignored. No rows give no rows.
    """
    if min_repeats < 2:
        raise ValueError("a run repeats at least twice")
    prepare(docs.sparkSession)

    def run(b):
        texts = [_split(t) for t in b.column(1).to_pylist()]
        found = _search(texts, min_words, min_repeats)
        return {
            "doc_id": b.column(0),
            "n_words": [len(w) for w in texts],
            "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in found],
            "collapsed": [b" ".join(collapse(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(texts, found, strict=True)],
        }

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text: a tenth of the documents, by the crc32 of their doc_id, end in a repeated stretch of their own words.

    Null doc_ids and texts without words stay as they are.
    """
    prepare(docs.sparkSession)

    def tail(doc_id, text):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        words = _split(text) if h % 10 == 0 else []
        if not words:
            return text
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        piece = words[a : a + p]
        whole = words[:a] + (piece * ((n - a) // p + 1))[: n - a]
        return b" ".join(whole).decode("utf-8", "surrogatepass")

    def run(b):
        return {"doc_id": b.column(0), "text": [tail(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs``: the number of runs, the one of greatest length over period (ties: smallest start, then period), and hashes of runs and kept words."""

    def more_repeats(x, y):
        d = y["length"] * x["period"] - x["length"] * y["period"]
        return F.when(d != 0, F.signum(d)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")

    best = F.get(F.array_sort("runs", more_repeats), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_tails(documents(spark, sf_dir))))
