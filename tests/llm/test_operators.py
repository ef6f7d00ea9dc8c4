"""Each operator against brute force, a round trip or held-out labels; nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from framelark.llm import decontaminate, language, lines, near, packing, pii, quality, substrings, tokenfiles, toxicity
from framelark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "Ünï ça va?"), (5, BASE), (5, BASE), (6, BASE.upper()), (None, "no id at all"), (7, "x" * 5000), (8, "a b " * 3000), (9, BASE.replace("one ", "")), (10, "1 2 3 4 5 6 7 8 9 " * 400)]


@pytest.fixture(scope="module")
def odd(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, a long, kept string, score string, c string, h string, base string"
    return spark.createDataFrame([(d, t, None, "s", None, 1, "k", "s", "c", "h", "b") for d, t in ODD], kind)


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def own_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_pack_is_whole_and_gapless(spark, odd, texts):
    for out, n in ((packing.pack(odd.select("doc_id", "text", "a"), capacity=64), len(ODD)), (QUERIES["op1_pack_sequences"](spark, SF), len(texts))):
        rows = out.collect()
        by: dict = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for pieces in by.values():
            at = 0
            for o, k in sorted(pieces):
                assert o == at
                at += k
            assert at <= 2048
        assert sum(r.start == 0 for r in rows) == n
    assert packing.pack(odd.limit(0)).count() == 0


def test_tournament_tree_is_first_fit_decreasing():
    sizes = np.random.default_rng(1).integers(1, 100, 300)
    bins, _ = packing.first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [100] * (k == len(room))
        room[k] -= sizes[i]
        assert bins[i] == k


def components(sets, percent):
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d in sets}


def test_near_duplicates_match_brute_force(spark, odd, texts):
    sets = {}
    for d, t in texts.items():
        w = own_words(t.translate(LOWER))
        sets[d] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    want = components(sets, 80)
    got = {r.doc_id: r for r in QUERIES["op2_near_duplicates"](spark, SF).collect()}
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    rows = {(r.doc_id, r.component_id) for r in near.near_groups(odd, k=2).collect()}
    assert {(1, 1), (2, 2), (3, 3), (5, 5), (6, 5), (9, 5), (None, None)} <= rows
    assert near.near_groups(odd.limit(0)).count() == 0


def test_super_min_hash_estimates_similarity():
    r = np.random.default_rng(0)
    shared, a, b = (r.integers(0, 1 << 63, n).astype(np.uint64) for n in (300, 100, 100))
    items = np.concatenate([shared, a, shared, b])
    sig = near.super_min_hash(items, np.repeat([0, 1], 400), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    assert sorted(sig[0] >> np.uint64(40)) == sorted(sig[0] >> np.uint64(40)) and (sig != ~np.uint64(0)).all()


def test_lines_match_brute_force(spark, odd, texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where: dict = {}
    for d, t in texts.items():
        for x in t.split("\n"):
            where.setdefault(key(x), set()).add(d)
    for r in QUERIES["op3_line_dedup"](spark, SF).collect():
        ls = texts[r.doc_id].split("\n")
        stay = [x for x in ls if not (len(key(x)) >= 20 and len(where[key(x)]) >= 3 and r.doc_id != max(where[key(x)]))]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(ls), len(ls) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    assert lines.drop_repeated_lines(odd).count() == len(ODD)
    assert lines.drop_repeated_lines(odd.limit(0)).count() == 0


def test_token_files_round_trip(spark, texts):
    from tokenizers import Tokenizer

    from framelark.llm.tokens import default_path

    t, at = Tokenizer.from_file(default_path()), 0
    for r in sorted(QUERIES["op4_token_files"](spark, SF).collect(), key=lambda r: r.doc_id):
        ids = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_blocks_are_checked():
    ids = np.random.default_rng(0).integers(0, 50, 5000)
    block = tokenfiles.encode_block(ids, 100)
    assert (tokenfiles.decode_block(block, 100) == ids).all() and len(block) < 4 * len(ids) / 2
    with pytest.raises(ValueError):
        tokenfiles.decode_block(block[:-9] + bytes([block[-9] ^ 255]) + block[-8:], 100)


def base_spans(t):
    def luhn(s):
        d = [int(c) for c in s[::-1]]
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    out = []
    for k, (kind, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data_base_matches_brute_force(spark, odd):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in QUERIES["op5_personal_data"](spark, "/root/testdata/sf0.01").collect():
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""} and r.n_ip == sum(x.startswith("ip") for x in want)
    hard = [(1, "a@b@c.de_f@g.hi x@y"), (2, "1.2.3.4.5.6.7 1.2.3.256 00001.2.3.4"), (3, "4111 1111-1111 1111 and 4111111111111111 5"), (4, "+1 (743) 555-3824+49 30.123456789 +1"), (5, None), (6, "ü" * 9 + "z@y.co"), (7, "1 " * 4000), (8, "token=\"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"")]
    rows = pii.personal_data(spark.createDataFrame(hard, "doc_id long, text string")).select("doc_id", pii.joined("base").alias("b")).collect()
    assert {r.doc_id: r.b for r in rows} == {d: ",".join(base_spans(t or "")) for d, t in hard}
    assert pii.personal_data(odd).count() == len(ODD)
    assert pii.personal_data(odd.limit(0)).count() == 0


def test_reliable_votes_win():
    p = pii.reliabilities({(0, 31): 500, (5, 0b11111): 100, (5, 0b01000): 300, (5, 0): 300})
    assert p[5, 0b11111] > 0.5 > p[5, 0]


def test_quality_counts_match_brute_force(spark, odd, texts):
    for r in QUERIES["op6_quality_rules"](spark, SF).collect():
        t = texts[r.doc_id]
        w = own_words(t)
        grams = list(zip(w, w[1:], w[2:]))
        many = {g for g in grams if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
        ls = [x for x in t.split("\n") if own_words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(odd, labels).count() == len(ODD)


def test_upper_bound_is_exact():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    assert quality.upper_bound(5, 5, 0.05) == 1 and quality.upper_bound(0, 0, 0.1) == 1


def test_repeated_bytes_match_brute_force(spark, odd, texts):
    want = substrings.brute_force(list(texts.items()))
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_repeated_bytes"](spark, SF).collect()} == want
    assert substrings.repeated_bytes(odd).count() == len(ODD)
    assert substrings.repeated_bytes(odd.limit(0)).count() == 0


def test_toxicity_on_labels(spark, odd):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    said = {r.doc_id: r.toxic for r in QUERIES["op8_toxicity"](spark, sf).collect() if r.doc_id in truth}
    assert sum(said[d] for d in said if not truth[d]) <= 0.002 * len(said)
    assert sum(said[d] for d in said if truth[d]) > 0.8 * sum(truth.values())
    none = toxicity.toxicity(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == len(ODD) and none.where("toxic").count() == 0


def test_language_on_held_out(spark, odd):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert language.identify(odd, None).where("lang_pred = 'und'").count() == len(ODD)


def test_decontamination_with_substitutions(spark, odd):
    item = " ".join(f"word{i}" for i in range(40))
    swapped = item.split()
    for i in (5, 19, 33):
        swapped[i] = "other"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"x y z {' '.join(swapped)} more"), (3, " ".join(f"else{i}" for i in range(60))), (4, None), (5, "word1 word2 word3")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == corpus_pipeline.COLUMNS and 0.5 * n < out.count() <= n
            docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in docs.collect()}
