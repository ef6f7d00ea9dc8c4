"""Spelling variants against brute force over all pairs, and the odd cases."""

import random
import re
import zlib
from collections import Counter

import pytest

from framelark.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count: dict[str, int], ratio: int = 2) -> dict:
    near = {w: [x for x in count if x != w and one_edit(w, x)] for w in count}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out


def rows(df) -> dict:
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("seed,least,most", [(1, 5, 8), (2, 1, 4)])
def test_all_near_words_are_found(spark, seed, least, most):
    rng = random.Random(seed)
    letters = "abé\U0001f600" if least == 1 else "abcé"
    count = {"".join(rng.choices(letters, k=rng.randint(least, most))): int(2 ** rng.uniform(0, 12)) for _ in range(250)}
    assert rows(spelling.spelling_variants(spark.createDataFrame(list(count.items()), "word string, n long"))) == brute(count)


def test_long_chains_and_ties(spark):
    count = {"a" * 5 + "b" * i: 2**i for i in range(1, 20)} | {"zebra": 7, "zebrb": 14, "zebrc": 14, "zebré": 14}
    got = rows(spelling.spelling_variants(spark.createDataFrame(list(count.items()), "word string, n long")))
    assert got == brute(count) and got["aaaaab"][1] == "a" * 5 + "b" * 19 and got["zebra"][0] == "zebrb"


def test_hot_segment_spreads(spark):
    """Thousands of words that share one half and are not near stay few pairs."""
    words = spark.range(4000).select(spelling.F.concat(spelling.F.lit("common"), spelling.F.lpad(spelling.F.conv(spelling.F.col("id") * 16807 % 2147483647, 10, 26), 6, "x")).alias("word"), spelling.F.lit(3).alias("n"))
    got = {r.word: r.n_near for r in spelling.spelling_variants(words).collect()}
    assert len(got) == 4000 and all(n == sum(one_edit(w, x) for x in got) for w, n in list(got.items())[:40])


def test_documents(spark):
    texts = [(d, " ".join(random.Random(d).choices(["Hello", "hello", "hallo", "wörld", "world", "World", "straße", "strasse", "ab", "x1y2zzzzz", "naïveté"], k=60))) for d in range(60)]
    texts += [(60, None), (61, ""), (None, "Hello hello HELLO"), (62, "É" * 4000), (62, "É" * 4000), (62, "É" * 4000), (63, "日本語 hello×world"), (-5, "hello. hello-hello")]
    docs = spark.createDataFrame([(d, t, "w", "n", "key") for d, t in texts], "doc_id long, text string, word string, n string, key string")
    count: Counter = Counter()
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            if d is not None and (h := zlib.crc32(f"{d}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    assert any(len(w) == 4000 for w in count)
    assert rows(spelling.document_variants(docs, every=97)) == brute({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})
    assert spelling.document_variants(docs.limit(0)).collect() == []


def test_a_ratio_without_end_is_refused(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([("hello", 1)], "word string, n long"), ratio=1)
