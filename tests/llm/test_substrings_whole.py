"""op7_repeated_bytes where one passage stands in very many documents with different surroundings, and at the ends of the ids."""

import hashlib

import numpy as np

from framelark.llm import substrings


def check(spark, rows):
    out = substrings.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in out} == substrings.brute_force(rows)


def test_many_surroundings_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 700)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 2000)
    r = np.random.default_rng(3)
    word = lambda k: "".join(map(chr, r.integers(97, 123, k)))
    passage, other = word(90), word(70)
    rows = [(d, word(int(r.integers(0, 60))) + (passage if d % 3 else other) + word(int(r.integers(0, 60)))) for d in range(150)]
    rows += [(200 + d, rows[d][1][5:] + word(8)) for d in range(5)] + [(300, None), (301, ""), (302, "ab " * 400), (303, "x" + "ab " * 300), (304, word(49)), (305, "é" * 60), (306, "né" + "é" * 60)]
    check(spark, rows)


def test_one_passage_reaches_its_bucket_once_a_shard(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4000)
    sizes, sort = [], substrings._sorted_bucket
    r = np.random.default_rng(4)
    word = lambda k: "".join(map(chr, r.integers(97, 123, k)))
    passage = word(80)
    rows = [{"shard": b"s", "doc": list(range(40)), "sizes": [200] * 40, "data": "".join(word(60) + passage + word(60) for _ in range(40)).encode()}]
    s = substrings.Shard(rows[0])
    hot = np.zeros(len(s.valid), bool)
    for d in range(40):
        hot[d * 200 + 60 : d * 200 + 91] = True
    anchor, begin, count = substrings.contexts(s, hot)
    assert count.sum() == 40 * 31 and len({s.data[b : b + c + 49].tobytes() for b, c in zip(begin, count)}) == len(begin) // 40
    assert sort and not sizes


def test_largest_id_stays(spark):
    top = (1 << 63) - 1
    rows = [(1, "y" * 60), (top, "some text of more than fifty bytes that stands in one place " + "y" * 55), (top - 1, "z")]
    check(spark, rows)
    out = substrings.repeated_bytes(spark.createDataFrame([*rows, (None, "y" * 60)], "doc_id long, text string")).collect()
    assert sorted((x.doc_id is None, x.n_removed) for x in out) == [(False, 0), (False, 0), (False, 55), (True, 60)]


def test_bytes_decide_where_hashes_are_equal(monkeypatch):
    r = np.random.default_rng(5)
    texts = [bytes(r.integers(97, 99, 60).astype(np.uint8)) for _ in range(30)]
    texts += texts[:10]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.full(40, 60)
    doc, first = np.arange(40)[::-1].copy(), {}
    for d, t in zip(doc, texts):
        for i in range(11):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], 99), d)
    want = [first[t[i : i + 50]] for t in texts for i in range(11)]
    for h in (substrings.mix, lambda x: x & np.uint64(3)):
        monkeypatch.setattr(substrings, "mix", h)
        assert substrings.least_docs(data, np.cumsum(sizes) - sizes, sizes - 49, doc).tolist() == want
