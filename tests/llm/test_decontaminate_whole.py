"""Seeds and verification of op10_decontaminate miss nothing that its own rule accepts."""

import itertools
import math

import numpy as np

from framelark.llm import decontaminate


def most_equal_without_hit(masks, upto):
    """For each length, the most equal words that a stretch can have without a hit of any mask; over all placements of the others."""
    size = 1 << (max(map(len, masks)) - 1)
    last = np.arange(2 * size)
    hit = np.logical_or.reduce([(last & int(m, 2)) == int(m, 2) for m in masks])
    most = np.full(size, -1)
    most[0] = 0
    for _ in range(upto):
        new = np.full(size, -1)
        for bit in (0, 1):
            x = (np.arange(size) << 1) | bit
            np.maximum.at(new, x & (size - 1), np.where((most >= 0) & ~hit[x], most + bit, -1))
        most = new
        yield int(most.max())


def test_every_accepted_overlap_holds_a_hit():
    for words, share in ((12, 0.8), (20, 0.9), (8, 0.8), (12, 0.7), (5, 0.5)):
        for n, equal in enumerate(most_equal_without_hit(decontaminate.masks_for(words, share), 300), 1):
            assert equal < words or equal < share * n - 1e-9, (words, share, n, equal)
    for period in (5, 6):  # every 5th or 6th word replaced
        same = np.arange(200) % period != 0
        assert any(all(same[o + i] for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for o in range(200 - len(m)))


def test_every_accepted_short_item_holds_a_hit():
    for n in range(1, 15):
        k, masks = decontaminate.item_masks(n)
        assert n - k == math.ceil(0.8 * n - 1e-9)
        for out in itertools.combinations(range(n), k):
            assert any(not any(m[i] == "1" for i in out) for m in masks)


def test_sparse_overlaps_and_short_items_are_found(spark):
    item = [f"w{i}" for i in range(200)]
    short = [f"s{i}" for i in range(10)]
    fifth = ["other" if i % 5 == 4 else w for i, w in enumerate(item)]
    three = [f"t{i}" for i in range(15)]
    docs = [(1, fifth), (2, ["x", *short[:3], "y", *short[4:6], "z", *short[7:]]), (3, short[:7] + ["a", "b", "c"]), (4, ["x" if i % 4 == 3 else w for i, w in enumerate(three)]), (5, short[2:])]
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, " ".join(three))], "item_id long, text string")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.decontaminate(frame, bench).collect()}
    assert got == {1: [1], 2: [2], 3: [], 4: [3], 5: [2]}


def brute_overlaps(doc, item, words=12, share=0.8):
    """Whether any stretch of any alignment holds."""
    need = min(words, 0.8 * len(item))
    for g in range(-len(item) + 1, len(doc)):
        same = [doc[i + g] == w for i, w in enumerate(item) if 0 <= i + g < len(doc)]
        for i in range(len(same)):
            equal = 0
            for j in range(i, len(same)):
                equal += same[j]
                if equal >= need and equal >= share * (j - i + 1) - 1e-9:
                    return True
    return False


def test_decontamination_matches_brute_force(spark):
    r = np.random.default_rng(5)
    items = [[f"i{k}w{i}" for i in range(n)] for k, n in enumerate((38, 32, 15, 16, 20, 25, 59, 120, 5, 10, 12, 13, 14))]
    docs = []
    for item in items:
        for share in (0.1, 0.15, 0.2, 0.25, 0.3):
            for _ in range(8):
                lo, hi = (0, len(item)) if r.random() < 0.5 else sorted(r.integers(0, len(item) + 1, 2).tolist())
                own = ["other" if r.random() < share else w for w in item[lo:hi]]
                docs.append(["before"] * int(r.integers(0, 3)) + own + ["after"] * int(r.integers(0, 3)))
    weak = ["other" if i in (6, 7, 8, 9, *range(12, 18)) else w for i, w in enumerate(items[0])]
    docs += [weak, items[1][:2] + ["other"] * 16 + items[1][18:]]
    assert brute_overlaps(docs[-2], items[0]) and brute_overlaps(docs[-1], items[1])
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {x.doc_id: list(x.item_ids) for x in decontaminate.decontaminate(frame, bench).collect()}
    want = {d: [k for k, item in enumerate(items) if brute_overlaps(t, item)] for d, t in enumerate(docs)}
    assert got == want and 50 < sum(map(bool, want.values())) < len(docs) - 50
