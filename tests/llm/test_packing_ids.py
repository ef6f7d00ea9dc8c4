"""Ids come back as they were, and a group holds whole documents."""

from collections import defaultdict

import numpy as np

import corpus_pipeline
from framelark.llm import packing
from framelark.llm.tokens import default_path, encoder

IDS = [None, None, 9007199254740993, 9007199254740995, -9223372036854775808, 9223372036854775807, 0, 7]


def docs(spark):
    return spark.createDataFrame([(d, f"document number {i} " * (400 if i % 3 == 0 else 3), "en", "s", 1) for i, d in enumerate(IDS)], "doc_id long, text string, lang string, source string, n_chars long")


def key(x):
    return (x is not None, x or 0)


def test_large_and_null_ids(spark):
    rows = packing.pack(docs(spark), capacity=256).collect()
    assert sorted({r.doc_id for r in rows}, key=key) == sorted(set(IDS), key=key)
    enc = encoder(default_path())
    want = sorted((enc.ids(r.text) + b"\x01\x00\x00\x00" for r in docs(spark).collect()))
    groups = defaultdict(set)
    texts = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            groups[r.doc_id].add(r.sequence_id >> 32)
        texts[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    assert all(len(g) == 1 for g in groups.values())
    assert sorted(b"".join(x for _, x in sorted(t)) for t in texts.values()) == want


def test_pipeline_stage(spark):
    stage = dict(corpus_pipeline.STAGES)["packing"]
    rows = stage(spark, docs(spark), "/root/testdata/sf0.001").collect()
    assert sorted({r.doc_id for r in rows}, key=key) == sorted(set(IDS), key=key)
    again = [(r.doc_id, r.start, r.length) for r in rows]
    assert len(set(again)) == len(again) or None in {d for d, _, _ in again}


def test_long_documents_are_dealt_in_parts(spark):
    long = spark.createDataFrame([(1, "word " * 60_000)], "doc_id long, text string")
    rows = packing.pack(long, capacity=16, group_docs=1, group_chars=20_000).collect()
    assert sum(r.length for r in rows) == rows[0].doc_tokens and len({r.sequence_id >> 32 for r in rows}) > 1


def test_ids_of_mixed_texts_are_the_librarys(spark):
    texts = ["The harbour, the lamps; it's a naïve list of 12 (twelve) things.", None, "", " \n", "İstanbul <|endoftext|> 一二", "2 × 3 ÷ 4 'Re're"]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), default_path(), 4, 1).collect()
    whole = encoder(default_path()).tokenizer
    for i, t in enumerate(texts):
        got = b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.start) if r.doc_id == i)
        assert np.frombuffer(got, "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 1]
