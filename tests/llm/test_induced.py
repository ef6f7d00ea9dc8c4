import random

import numpy as np
import pytest

from framelark.llm import induced


def check(data: bytes, width: int, held: int) -> None:
    out = list(induced.sorted_suffixes(np.frombuffer(data, np.uint8), width, held))
    at = [int(i) for x, _ in out for i in x]
    prefix = [int(i) for _, x in out for i in x]
    assert sorted(at) == list(range(len(data)))
    keys = [data[i : i + width] for i in at]
    assert keys == sorted(keys)
    for a, b, p in zip(keys, keys[1:], prefix[1:], strict=False):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert p == same


@pytest.mark.parametrize("chunk, held", [(1 << 16, 1 << 18), (7, 16)])
def test_suffixes_and_common_prefixes(monkeypatch, chunk, held):
    """Small chunks and queues go to disk again and again; the order and the prefixes are those of plain sorting."""
    monkeypatch.setattr(induced, "CHUNK", chunk)
    rng = random.Random(3)
    for _ in range(250):
        letters = rng.choice([[0], [0, 1], [254, 255], [7, 0, 255], list(range(256))])
        piece = bytes(rng.choices(letters, k=rng.randint(1, 40)))
        data = b"".join(rng.choice([piece, piece[:5], bytes([rng.choice(letters)])]) for _ in range(rng.randint(1, 60)))[:300]
        check(data, rng.choice([3, 10, 50, 254]), held)


def test_long_runs_and_nothing():
    check(b"a" * 300 + b"b" + b"a" * 300, 50, 64)
    assert list(induced.sorted_suffixes(np.zeros(0, np.uint8), 50)) == []
