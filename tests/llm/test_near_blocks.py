"""Groups of near duplicates whose pairs lie close to the threshold, against brute force, with small blocks and few edges a task."""

import numpy as np
import pytest

from framelark.llm import near

from test_operators import components


def family(r, n, kept, d0):
    """``n`` documents of 120 words, each with a share of about ``kept`` of a common text's words."""
    base = [f"w{x}" for x in r.integers(0, 10**6, 120)]
    return [(d0 + i, " ".join(w if r.random() < kept else f"x{r.integers(0, 10**6)}" for w in base)) for i in range(n)]


@pytest.mark.parametrize("likely", [near.LIKELY, 0.0])
def test_many_pairs_near_the_threshold(spark, monkeypatch, likely):
    for name, n in (("SET_BLOCK", 3000), ("SIGNATURE_BLOCK", 16), ("LAST_EDGES", 10)):
        monkeypatch.setattr(near, name, n)
    r = np.random.default_rng(5)
    rows = family(r, 40, 0.97, 0) + family(r, 40, 0.93, 100) + family(r, 40, 0.9, 200) + family(r, 12, 0.5, 300)
    rows += [(d + 1000, t) for d, t in rows[:30]]
    sets = {d: {tuple(t.split()[i : i + 2]) for i in range(119)} for d, t in rows}
    out = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2, likely=likely).collect()
    assert {x.doc_id: x.component_id for x in out} == components(sets, 80)


def test_links_are_fewer_than_rows(spark, monkeypatch):
    sizes, links = [], near.links_in_blocks
    monkeypatch.setattr(near, "links_in_blocks", lambda dealt, *a: sizes.append((dealt.count(), (got := links(dealt, *a)).count())) or got)
    rows = family(np.random.default_rng(6), 150, 0.9, 0)
    assert near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).count() == 150
    assert all(found <= seen for seen, found in sizes)
