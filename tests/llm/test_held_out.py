"""What is promised about unseen documents, measured on documents that took no part: op8 on labels kept out, op6's bound in simulations, op1 against the tokenizers library."""

import zlib

import numpy as np

from framelark.llm import packing, quality, toxicity
from framelark.llm.tokens import default_path, splits_as_here

SF = "/root/testdata/sf0.1"


def test_toxicity_on_labels_kept_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.toxicity(docs, labels.where("pmod(xxhash64(doc_id), 3) <> 0")).select("doc_id", "toxic")
    rows = out.join(labels.where("pmod(xxhash64(doc_id), 3) = 0").selectExpr("doc_id", "toxic = 1 AS truth"), "doc_id").collect()
    toxic = [r for r in rows if r.truth]
    assert len(rows) > 1000 and sum(r.toxic for r in toxic) >= 0.75 * len(toxic)
    assert sum(r.toxic for r in rows if not r.truth) <= 0.01 * len(rows)


def test_bound_holds_in_simulations():
    r = np.random.default_rng(11)
    risk, wrong, bad, chosen = 0.03, 0.1, 0, 0
    everyone = r.beta(1, 12, 200_000)
    for _ in range(400):
        fit, held = r.choice(everyone, 300), r.choice(everyone, 300)
        cutoffs = [(q := np.quantile(fit, level)) + (1 - q) * m for level, m in quality.LEVELS]
        n = quality.passing([int((held > c).sum()) for c in cutoffs], len(held), risk, wrong)
        chosen += n > 0
        bad += n > 0 and (everyone > cutoffs[n - 1]).mean() > risk
    assert chosen > 100 and bad <= 400 * wrong


def test_packed_ids_are_the_library_s(spark):
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    t, at, rows = Tokenizer.from_file(default_path()), {}, packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert splits_as_here(default_path())
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert zlib.crc32(r.ids) == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
    assert set(at) == set(texts) and all(at[r.doc_id] == r.doc_tokens for r in rows)
    full = sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows}))
    assert full > 0.98
