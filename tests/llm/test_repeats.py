"""Periodic runs against the definition, tried for every period and place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from framelark.llm import repeats

WS = " \t\n\x0b\x0c\r"


def split(t):
    return "".join(" " if c in WS else c for c in t or "").split(" ") if t else []


def words(t):
    return [w for w in split(t) if w]


def brute(ws, min_words=24, min_repeats=3):
    out = {}
    for q in range(1, len(ws) // min_repeats + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            n = j + q - i
            if n >= max(min_words, min_repeats * q) and (i, n) not in out:
                out[i, n] = q
            i = j
    return sorted((i, n, q) for (i, n), q in out.items())


def planted(d, ws):
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def expected(d, t):
    ws = planted(d, words(t))
    runs = brute(ws)
    lost = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(ws) if i not in lost)
    return (d, len(runs), *head, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("seed", range(6))
def test_every_run_is_found(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        ws = [rng.choice("ab" if rng.random() < 0.5 else "abc") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            piece = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
            ws += piece * rng.randint(1, 6) + piece[: rng.randint(0, len(piece))]
        texts.append(ws)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    symbols = np.array([ord(w) - 97 for t in texts for w in t], np.int64)
    for least, times in ((24, 3), (2, 2), (6, 3), (1, 4)):
        got = repeats.runs_of(symbols, starts, least, times)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute(t, least, times)]


@pytest.mark.parametrize("rounds", [0, 1, 24])
def test_next_smaller(rounds):
    rng = np.random.default_rng(rounds)
    for rank in (rng.permutation(500), np.arange(500)[::-1].copy(), np.concatenate([[0], np.arange(499, 0, -1)])):
        ends = np.where(np.arange(500) < 200, 200, 500)
        want = [next((j for j in range(i + 1, ends[i]) if rank[j] < rank[i]), ends[i]) for i in range(500)]
        assert repeats.next_smaller(rank, ends, rounds).tolist() == want


def test_documents(spark):
    rng = random.Random(5)
    line = "the quick brown fox jumps over the lazy dog and runs"
    texts = [(d, " ".join(rng.choices(["a", "b", "the", "über", "Über"], k=rng.randint(0, 90)))) for d in range(80)]
    texts += [(100, None), (101, ""), (102, " \t\n "), (None, "x " * 30), (None, None), (103, "na na na " * 500), (104, line + "\n" + "\n".join([line] * 40)), (104, line), (105, "z" * 50000), (9007199254740993, "tra la " * 15)]
    texts += [(106, " ".join(["a b c"] * 12 + ["q"] + ["a b c a b d"] * 8 + ["r"] + ["h"] * 24 + ["g"] * 23)), (106, "u v " * 40)]
    docs = spark.createDataFrame([(d, t, 1, "r", "c") for d, t in texts], "doc_id long, text string, n_words int, runs string, collapsed string")
    got = sorted(map(tuple, repeats.digests(repeats.periodic_runs(repeats.with_tails(docs))).collect()), key=repr)
    assert got == sorted((expected(d, t) for d, t in texts), key=repr)
    assert sum(r[1] > 0 for r in got) >= 6 and any(r[1] > 2 for r in got)
    assert repeats.digests(repeats.periodic_runs(docs.limit(0))).collect() == []


def test_long_periodic_text_in_linear_memory():
    ws = [b"a", b"b"] * 150_000 + [b"c"]
    (found,) = repeats._search([ws], 24, 3)
    assert found.tolist() == [[0, 300_000, 2]]
    assert len(repeats.collapse(ws, found)) == 3
