"""Votes of op5: more support never lowers a probability; input columns stay; many matches in one text take linear time."""

import time

from pyspark.sql import functions as F

from framelark.llm import pii

#: Counts of (kind, votes) as found on sf0.1; bits from the right: strict, gazetteer, assigned, alphabet, apart.
SEEN = {(0, 0b10001): 186, (1, 0b10001): 1, (1, 0b11001): 179, (2, 0b11001): 174, (3, 0b11001): 157, (4, 0b11001): 2, (5, 0b11111): 166}


def test_unanimous_secrets_are_found():
    p = pii.reliabilities(SEEN)
    assert p[5, 0b11111] > 0.9


def test_a_yes_never_lowers_a_probability():
    for counts in (SEEN, SEEN | {(5, 0): 5000, (5, 0b10000): 900, (5, 0b11000): 40, (6, 0b00001): 70}, {(5, 0): 10, (5, 31): 3}):
        p = pii.reliabilities(counts)
        assert all(p[k, v | 1 << i] >= p[k, v] - 1e-12 for k, v in p for i in range(len(pii.LABELERS)))


def test_many_unsupported_candidates_stay_out():
    p = pii.reliabilities(SEEN | {(5, 0): 5000, (5, 0b10000): 900})
    assert p[5, 0b11111] > 0.5 > p[5, 0] and p[5, 0b10000] < 0.5


def test_columns_stay(spark):
    rows = spark.createDataFrame([(1, "mail a@b.co", "t", "m", "a", "r", "f")], "doc_id long, text string, _t string, more string, anchor string, row string, found string")
    got = pii.personal_data(rows).collect()[0]
    assert (got["_t"], got["more"], got["anchor"], got["row"]) == ("t", "m", "a", "r") and [x.text for x in got["found"]] == ["a@b.co"]


def test_places_of_many_matches(spark):
    text = "".join(f"ü{i} u{i}@mail.example.com," for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = df.select(pii.find(F.col("text"), pii.BASE["email"]).alias("m")).collect()[0]["m"]
    assert len(got) == 3000 and all(text[x.start : x.end] == x.text for x in got)
    assert time.time() - began < 20


def test_many_mixed_matches_take_linear_time(spark):
    """Candidates are held against base spans by halving, and what stands before a span is put together from its neighbours."""
    n = 6000
    text = "".join(f"u{i}@m.example.com, +1 555 010 {i:04d}; 4111 1111 1111 1111 key=AKIAABCDEFGH{i:08d} " for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (r,) = pii.personal_data(df).collect()
    assert time.time() - began < 60 and len(r.base) == 3 * n and len(r.found) == 4 * n
    assert all(text[s.start : s.end] == s.text for s in r.found)


def test_what_stands_before(spark):
    """The 32 code points before a match, through matches and gaps of any length, adjacent ones too."""
    text = "ü1.2.3.4," * 3 + "5.6.7.8 " + "x" * 50 + " a@b.c%d@e.f+g@h.i%j@k.l_m@n.o-%p@q.r+s@t.u%v@w.x+y@z.aé+b@c.d 9.9.9.9"
    for kind in ("email", "ip"):
        (got,) = spark.createDataFrame([(text,)], "t string").select(pii.find(F.col("t"), pii.BASE[kind]).alias("m")).collect()
        assert got.m and all(text[s.start : s.end] == s.text and s.before == text[max(0, s.start - 32) : s.start] for s in got.m)


def test_touching_spans(spark):
    import random

    rng = random.Random(4)
    spans, at = [], 0
    for _ in range(40):
        a = at + rng.randint(0, 4)
        at = a + rng.randint(1, 5)
        spans.append((a, at))
    asked = [(a, a + rng.randint(1, 4)) for a in range(0, at + 6)]
    kind = "array<struct<start: int, end: int>>"
    df = spark.createDataFrame([(spans, asked), ([], asked)], f"spans {kind}, asked {kind}")
    for r, have in zip(df.select(F.transform("asked", lambda s: pii.touches(s, F.col("spans"))).alias("t")).collect(), (spans, []), strict=True):
        assert r.t == [any(x < b and a < y for x, y in have) for a, b in asked]
