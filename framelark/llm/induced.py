"""Suffixes in order by external induced sorting: queues of suffix tuples on disk, common prefixes carried along.

A suffix is L or S: greater or less than the one that follows it. The leftmost S of each stretch are seeds: substrings between seeds get names,
pairs of names get names in turn until all differ (or span ``width`` bytes), and so the seeds are in order. A pass upwards induces L suffixes from
seeds, a pass downwards S suffixes from those. Each pass pops chunks of tuples (place, common prefix with the one popped before) from a queue for
each first byte and pushes the places before them; the prefix of two pushed is one more than the least of those popped in between. A queue keeps
``HELD`` tuples in memory and the rest in a nameless file in Spark's own spill folders, which goes with the task: a task that runs again starts anew.

In memory stay the text (under 2 GiB), some eleven bytes for each of its places, and some fifty for each seed (a third of the places or so, half at most).
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CHUNK, HELD = 1 << 16, 1 << 14
_LOW = np.uint64(255)


class Queue:
    """Tuples in the order they came, place and common prefix in one number each; read by position from either end."""

    def __init__(self, held: int = HELD):
        self.held, self.pieces, self.n, self.on_disk, self.file = held, [], 0, 0, None

    def append(self, at: np.ndarray, prefix: np.ndarray) -> None:
        self.pieces.append((at.astype(np.uint64) << np.uint64(8)) | prefix)
        self.n += len(at)
        if self.n - self.on_disk > self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            self.file.seek(8 * self.on_disk)
            self.file.write(b"".join(p.tobytes() for p in self.pieces))
            self.pieces, self.on_disk = [], self.n

    def read(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        if lo < self.on_disk:
            self.file.seek(8 * lo)
            parts.append(np.frombuffer(self.file.read(8 * (min(hi, self.on_disk) - lo)), np.uint64))
        if hi > self.on_disk:
            if len(self.pieces) > 1:
                self.pieces = [np.concatenate(self.pieces)]
            parts.append(self.pieces[0][max(0, lo - self.on_disk) : hi - self.on_disk])
        x = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return (x >> np.uint64(8)).astype(np.int64), (x & _LOW).astype(np.uint8)

    def forwards(self):
        for lo in range(0, self.n, CHUNK):
            yield self.read(lo, min(self.n, lo + CHUNK))

    def backwards(self):
        """From the last to the first; each prefix is the one with the tuple given before."""
        after = np.zeros(1, np.uint8)
        for hi in range(self.n, 0, -CHUNK):
            at, prefix = self.read(max(0, hi - CHUNK), hi)
            yield at[::-1], np.concatenate([after, prefix[:0:-1]])
            after = prefix[:1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _least_between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of ``x[lo:hi + 1]`` for each pair (a table of powers of two)."""
    k = np.log2(hi - lo + 1).astype(np.int64)
    table = np.full((int(k.max(initial=0)) + 1, len(x)), 255, np.uint8)
    table[0] = x
    for j in range(1, len(table)):
        half = 1 << (j - 1)
        table[j, : len(x) - 2 * half + 1] = np.minimum(table[j - 1, : len(x) - 2 * half + 1], table[j - 1, half : len(x) - half + 1])
    return np.minimum(table[k, lo], table[k, hi - (1 << k) + 1])


def _induce(text: np.ndarray, wanted: np.ndarray, same: np.ndarray, given, firsts, width: int, held: int, start: bool) -> list[Queue]:
    """One pass over the first bytes ``firsts``: a queue for each, of the suffixes that are ``wanted``.

    ``given(byte)``: chunks of the suffixes that stand behind the induced ones of this byte; ``same``: how often each byte repeats from its place on.
    """
    queues = [Queue(held) for _ in range(256)]
    pending = np.zeros(256, np.uint8)

    def pop(at: np.ndarray, prefix: np.ndarray) -> None:
        i = np.flatnonzero((at > 0) & wanted[at - 1])
        every = prefix.min()
        if not len(i):
            np.minimum(pending, every, out=pending)
            return
        c = text[at[i] - 1]
        order = np.argsort(c, kind="stable")
        i, c = i[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        end = np.append(begin[1:], len(c))
        low = np.empty(len(i), np.uint8)
        later = np.ones(len(i), bool)
        later[begin] = False
        later = np.flatnonzero(later)
        if len(later):
            low[later] = _least_between(prefix, i[later - 1] + 1, i[later])
        low[begin] = np.minimum(pending[c[begin]], np.minimum.accumulate(prefix)[i[begin]])
        low = np.minimum(low, width - 1) + np.uint8(1)
        np.minimum(pending, every, out=pending)
        behind = np.append(np.minimum.accumulate(prefix[::-1])[::-1], np.uint8(255))
        pending[c[begin]] = behind[i[end - 1] + 1]
        before = at[i] - 1
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            q = queues[c[b]]
            if not q.n:
                low[b] = 0
            q.append(before[b:e], low[b:e])

    if start:
        queues[text[-1]].append(np.array([len(text) - 1]), np.zeros(1, np.uint8))
    for byte in firsts:
        q, done, last = queues[byte], 0, None
        while done < q.n:
            at, prefix = q.read(done, min(q.n, done + CHUNK))
            done += len(at)
            last = at[-1]
            pop(at, prefix)
        for at, prefix in given(byte):
            if last is not None:
                prefix = prefix.copy()
                # c..c and less against c..c and more: they agree as far as the shorter stretch of c
                prefix[0] = min(same[last], same[at[0]])
                last = None
            pop(at, prefix)
    return queues


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one big-endian number; zeros behind the end."""
    padded, w = np.concatenate([text, np.zeros(8, np.uint8)]), np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        w <<= np.uint64(8)
        w |= padded[i : i + len(w)]
    return w


def _refine(rank: np.ndarray, key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """``rank`` with ties among ``some`` broken by ``key``; a rank is the number of those before. Returns who still ties."""
    order = some[np.lexsort((key[some], rank[some]))].astype(np.int32)
    r, k = rank[order], key[order]
    group = np.concatenate([[True], r[1:] != r[:-1]])
    new = group | np.concatenate([[True], k[1:] != k[:-1]])
    del k
    here = np.arange(len(order), dtype=np.int32)
    r += np.maximum.accumulate(np.where(new, here, 0))
    r -= np.maximum.accumulate(np.where(group, here, 0))
    rank[order] = r
    alone = new & np.append(new[1:], True)
    return order[~alone]


def _seeds(text: np.ndarray, word: np.ndarray, seeds: np.ndarray, width: int) -> np.ndarray:
    """``seeds`` in the order of their suffixes, as far as ``width`` bytes."""
    size = (np.append(seeds[1:], len(text)) - seeds + 1).astype(np.int32)
    rank = np.zeros(len(seeds), np.int32)
    tie = np.arange(len(seeds), dtype=np.int32)
    # names: the bytes up to the next seed and its first, 0xFF behind; a longer substring comes before its prefix
    for o in range(0, width, 8):
        key = np.full(len(seeds), ~np.uint64(0))
        left = np.clip(size[tie] - o, 0, 8).astype(np.uint64)
        w = word[np.minimum(seeds[tie] + o, len(text))]
        fill = np.where(left < 8, ~np.uint64(0) >> (np.minimum(left, np.uint64(7)) * np.uint64(8)), np.uint64(0))
        key[tie] = np.where(left > 0, w | fill, ~np.uint64(0))
        tie = _refine(rank, key, tie)
        if not len(tie) or size[tie].max() <= o + 8:
            break
    if len(tie):
        tie = _refine(rank, -np.minimum(size, width + 1), tie)
    # names of pairs of names, of pairs of those ...: a name spans at least two bytes
    span = 1
    while len(tie) and 2 * span < width + 2:
        follow = np.full(len(seeds), -1, np.int32)
        follow[:-span] = rank[span:]
        tie = _refine(rank, follow, tie)
        span *= 2
    return seeds[np.argsort(rank, kind="stable")]


def sorted_suffixes(text: np.ndarray, width: int = 254, held: int = HELD):
    """Chunks (places, common prefixes) of all suffixes of ``text`` (uint8) in order of their first ``width`` bytes.

    A common prefix is the one with the suffix before, counted to ``width`` at most (254 is the most); suffixes equal in ``width`` bytes come in any
    order. The end counts as less than every byte. An empty text gives nothing.
    """
    n = len(text)
    if not n:
        return
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1).astype(np.int32)
    lengths = np.diff(change, prepend=np.int32(-1))
    up = np.append(text[change[:-1] + 1] > text[change[:-1]], False)
    small, same = np.repeat(up, lengths), np.repeat(change, lengths)
    same -= np.arange(-1, n - 1, dtype=np.int32)
    same = np.minimum(same, width).astype(np.uint8)
    del change, lengths, up
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    given = [Queue(held) for _ in range(256)]
    if len(seeds):
        word = _words(text)
        seeds = _seeds(text, word, seeds, width)
        prefix, open_ = np.zeros(len(seeds), np.int64), np.ones(len(seeds), bool)
        open_[0] = False
        for o in range(0, width, 8):
            a, b = seeds[:-1] + o, seeds[1:] + o
            i = np.flatnonzero(open_[1:] & (a < n) & (b < n))
            if not len(i):
                break
            differ = word[a[i]] ^ word[b[i]]
            equal = np.full(len(i), 8)
            for k in range(8):
                equal[(equal == 8) & ((differ >> np.uint64(56 - 8 * k)) & _LOW > 0)] = k
            equal = np.minimum(equal, n - np.maximum(a[i], b[i]))
            prefix[1:][i] += equal
            open_[1:] = False
            open_[1:][i[equal == 8]] = True
        prefix = np.minimum(prefix, width).astype(np.uint8)
        edges = np.searchsorted(text[seeds], np.arange(257))
        for c in np.flatnonzero(edges[1:] > edges[:-1]):
            own = prefix[edges[c] : edges[c + 1]]
            own[0] = 0
            given[c].append(seeds[edges[c] : edges[c + 1]], own)
        del word, prefix
    large = _induce(text, ~small, same, lambda c: given[c].forwards(), range(256), width, held, True)
    less = _induce(text, small, same, lambda c: large[c].backwards(), range(255, -1, -1), width, held, False)
    for c in range(256):
        last = None
        for at, prefix in large[c].forwards():
            last = at[-1]
            yield at, prefix
        for at, prefix in less[c].backwards():
            if last is not None:
                prefix = prefix.copy()
                prefix[0] = min(same[last], same[at[0]])
                last = None
            yield at, prefix
    for q in [*given, *large, *less]:
        q.close()


__all__ = ["Queue", "sorted_suffixes"]
