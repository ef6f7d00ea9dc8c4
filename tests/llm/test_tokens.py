"""Ids of the fast path are the tokenizer's own."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framelark.llm import tokens
from framelark.llm.tokens import Encoder, default_path, encoder

ALPHABET = "aBZz09'stÀ×ß÷ÿªé́ \n\t<|>$.,-İΣ一\U0001f600\x7f\x00\xa0re've"


@settings(max_examples=500, deadline=None)
@given(st.text(ALPHABET, max_size=20) | st.text(max_size=20))
def test_ids_are_the_librarys(text):
    enc = encoder(default_path())
    text = text.encode("utf-8", "replace").decode()
    assert enc.ids(text) == np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(ALPHABET, max_size=20) | st.text("aBz9'strevlmd.,;×÷Éé \n", max_size=20), max_size=8), st.sampled_from([5, 1000]))
def test_ids_of_texts_encoded_together_are_the_librarys(texts, chars):
    whole, most = encoder(default_path()), tokens.CHARS
    tokens.CHARS = chars
    try:
        got = whole.many(texts, b"end.")
    finally:
        tokens.CHARS = most
    assert got == [np.array(whole.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() + b"end." for t in texts]


def test_texts_encoded_together_are_cut_to_pieces_and_looked_up_once():
    class Asked(Encoder):
        looks = 0

        def get(self, *a):
            self.looks += 1
            return super().get(*a)

        def __getitem__(self, word):
            self.looks += 1
            return super().__getitem__(word)

    enc = Asked(default_path(), 100)
    texts = [f"The harbour, the Lamps; harbour's lamps. ({i}) harbour!" for i in range(200)]
    assert enc.many(texts) == [encoder(default_path()).ids(t) for t in texts]
    assert set(enc) == {b"the", b"harbour", b"lamps", b"'s", *b", ; . ( ) !".split(), *(b"%d" % i for i in range(10))}
    assert enc.looks == len(enc)


def test_many_texts_keep_the_memory_bounded():
    enc = Encoder(default_path(), 100)
    for i in range(50):
        texts = ["harbour " + " ".join(f"zq{'abcdefghij'[i % 10]}{'klmno'[i // 10]}{'uvwxy'[j % 5]}{'abcdefgh'[j // 5]}" for j in range(20))] * 2
        assert enc.many(texts) == [encoder(default_path()).ids(t) for t in texts]
        assert len(enc) + len(enc.older) <= 200 and b"harbour" in {*enc, *enc.older}


def test_pieces_of_a_vocabulary_without_ends():
    enc = Encoder(default_path(), 100)
    enc.last[:] = False
    assert enc.many(["The harbour, 12"]) == [encoder(default_path()).ids("The harbour, 12")]


def test_words_in_use_stay_in_a_bounded_memory():
    enc = Encoder(default_path(), 100)
    model, asked = enc.model, []

    class Counting:
        def tokenize(self, piece):
            asked.append(piece)
            return model.tokenize(piece)

    enc.model = Counting()
    whole = encoder(default_path()).tokenizer
    for i in range(200):
        text = "The harbour, the lamps " + " ".join(f"zq{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxy'[j % 5]}{'abcdefgh'[j // 5]}{i}" for j in range(20))
        assert enc.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(enc) + len(enc.older) <= 200
    assert asked.count("harbour") == asked.count("lamps") == 1


def test_payloads_stay_as_they_were():
    from framelark.llm import tokenfiles

    ids = np.random.default_rng(5).zipf(1.3, 60_000) % 900
    block = tokenfiles.encode_block(ids, 900)
    assert (len(block), zlib.crc32(block)) == (53_920, 2_201_962_325)
    assert (tokenfiles.decode_block(block, 900) == ids).all()


def test_ids_are_found_among_many_rare_ones():
    from framelark.llm import tokenfiles

    m = tokenfiles.Model(3000, 400)
    for t in range(60):
        m.predict(400)
        m.learn(np.random.default_rng(t).zipf(1.2, 400) % 3000)
        if t % 7 == 0:
            u = np.arange(m.total)
            assert (m.find(u) == np.repeat(np.arange(3000), m.count)).all()
            assert m.find(np.array([m.total, 5 * m.total])).tolist() == [3000, 3000]
