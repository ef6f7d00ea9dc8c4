"""Word-piece ids from a tokenizer file, with a bounded memory of words seen before."""

from __future__ import annotations

import codecs
import functools
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa

#: Words of these characters alone (ASCII without ``<``, letters of Latin-1) look the same in every normal form and hold no added token.
PLAIN = re.compile("[!-;=-~\u00c0-\u00ff]+")
PLAIN_TEXT = re.compile("[\t-\r !-;=-~\u00c0-\u00ff]+")
#: Marks that are a piece of their own after a letter at a word's end.
MARKS = frozenset(b"%c" % c for c in b".,;:!?)")
#: What the tokenizer splits a lower-case plain word into before merging.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


#: Plain text in UTF-8, where bytes from 80 on stand behind C3: its small letters, and for each of them white space (0), letter (1), digit (2) or other (3).
#: The signs of multiplication and division (C3 97, C3 B7) are no letters.
BLANKS = b"\t\n\x0b\x0c\r "
SMALL = bytes(c + 32 if 65 <= c <= 90 or 0x80 <= c <= 0x9E and c != 0x97 else c for c in range(256))
CLASS = bytes(0 if c in BLANKS else 1 if 97 <= c <= 122 or c >= 0x80 else 2 if 48 <= c <= 57 else 3 for c in range(256))
#: Second letters of the endings that ``PIECES`` splits off after an apostrophe, by the first.
ENDINGS = {b"s": b"", b"t": b"", b"m": b"", b"d": b"", b"r": b"e", b"v": b"e", b"l": b"l"}
#: So many pieces go to the library at once; about so many characters of texts are cut at once.
AT_ONCE, CHARS = 1000, 8_000_000

#: Packs so many ids as little-endian unsigned 32-bit bytes.
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]

#: The normalizer and the splitting that ``PLAIN`` and ``PIECES`` stand for.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_as_here(path: str) -> bool:
    """Whether a tokenizer file normalizes and splits as ``PLAIN`` and ``PIECES`` do; any other goes through the library whole."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    split = [p["pattern"].get("Regex") for p in before.get("pretokenizers", []) if p.get("type") == "Split"]
    return normal.get("normalizers") == NORMALIZER and split == [SPLIT] and spec["model"]["type"] == "BPE"


def cut_plain(texts: list[str]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The pieces of plain texts, in order and in small letters, and how many of them each text and those before it have."""
    raw = [t.encode() for t in texts]
    joined = b"\n".join([*raw, b"\n"]).translate(SMALL)
    u, kind = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(CLASS), np.uint8)
    if not joined.isascii():
        kind, at = kind.copy(), np.flatnonzero((u == 0x97) | (u == 0xB7))
        kind[at] = kind[at - 1] = 3
    start = np.empty(len(u), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == 2
    if b"'" in joined:
        at = np.flatnonzero((u == 39) & start)
        for a, b in ENDINGS.items():
            here = at[u[at + 1] == a[0]]
            here = here[u[here + 2] == b[0]] if b else here
            start[here + 1] = False
            start[here + 2 + len(b)] = True
    keep = kind != 0
    kept = joined.translate(None, BLANKS)
    begins = np.flatnonzero(start[keep])
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    first = np.cumsum(sizes) - sizes
    upto = np.searchsorted(begins, np.cumsum(np.add.reduceat(keep, first, dtype=np.int64)))
    offsets = np.append(begins, len(kept)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), upto


class Encoder(dict):
    """Word or piece of a word (bytes, no ASCII white space) -> ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids in
    order. Plain words are split once more, so that ``the,`` and ``The`` share ``the``; their pieces need
    no normalizing and go to the tokenizer's model at once. A piece splits into itself, so words and pieces share
    one memory. When it holds ``limit`` entries it becomes the older one and the older one before is forgotten: what is in use stays.
    """

    def __init__(self, path: str, limit: int = 600_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.older = Tokenizer.from_file(path), limit, {}
        self.split, self.model = splits_as_here(path), self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the model's letter for each byte of a plain piece in UTF-8: ASCII as it is, C3 and what may follow it
        self.letters = [chr(c) for c in range(256)]
        for c in range(0xC0, 0x100):
            self.letters[0xC3], self.letters[c - 0x40] = level.pre_tokenize_str(chr(c))[0][0]
        self.letters = "".join(self.letters)
        # the model alone, for pieces between spaces, and the ids that end a piece
        self.spaced = Tokenizer(self.model)
        self.spaced.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def library(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, p: bytes) -> bytes:
        ids = [t.id for t in self.model.tokenize(codecs.charmap_decode(p, "strict", self.letters)[0])]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, "<u4").tobytes()

    def fresh(self, word: bytes) -> bytes:
        """The ids of a word that isn't remembered."""
        if not self.split:
            return self.library(word)
        low, last = word.lower(), word[-1:]
        if low.isalpha():
            # ASCII letters alone: one piece
            return self.piece(word) if low == word else self[low]
        if last in MARKS and low[:-1].isalpha():
            return self[low[:-1]] + self[last]
        text = word.decode("utf-8", "replace")
        if not PLAIN.fullmatch(text):
            return self.library(word)
        text = text.lower()
        pieces = [text] if text.isalpha() else PIECES.findall(text)
        if len(pieces) > 1:
            return b"".join([self[p.encode()] for p in pieces])
        low = text.encode()
        return self.piece(word) if low == word else self[low]

    def __missing__(self, word: bytes) -> bytes:
        got = self.older.pop(word, None)
        return self.keep(word, self.fresh(word) if got is None else got)

    def keep(self, word: bytes, ids: bytes) -> bytes:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces; those that aren't remembered go to the library's model together."""
        got = list(map(self.get, pieces))
        new = []
        for i in [i for i, x in enumerate(got) if x is None]:
            if (x := self.older.pop(pieces[i], None)) is None:
                new.append(i)
            else:
                got[i] = self.keep(pieces[i], x)
        parts = [new[k : k + AT_ONCE] for k in range(0, len(new), AT_ONCE)]
        spaced = [codecs.charmap_decode(b" ".join([pieces[i] for i in part]), "strict", self.letters)[0] for part in parts]
        for part, found in zip(parts, self.spaced.encode_batch_fast(spaced, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends, ids = (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), ids.tobytes()
            whole = len(ends) == len(part)
            for i, a, b in zip(part, [0, *ends], ends, strict=False) if whole else zip(part, part, part, strict=True):
                got[i] = self.keep(pieces[i], ids[a:b] if whole else self.piece(pieces[i]))
        return got

    def many(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """The ids of each text, and ``end``. Plain texts are cut together, and a piece that they share is looked up once."""
        out, held, size = [b""] * len(texts), [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            if not (self.split and PLAIN_TEXT.fullmatch(t)):
                out[i] = self.ids(t)
                continue
            if held and size + len(t) > CHARS:
                self.together(texts, held, out)
                held, size = [], 0
            held.append(i)
            size += len(t)
        if held:
            self.together(texts, held, out)
        return [x + end for x in out]

    def together(self, texts: list[str | None], plain: list[int], out: list[bytes]) -> None:
        """Put the ids of the plain texts at these places in ``out``."""
        cut, upto = cut_plain([texts[i] for i in plain])
        if not len(cut):
            return
        cut = cut.dictionary_encode()
        ids = pa.array(self.pieces(cut.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(cut.indices)
        at, raw = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[upto].tolist(), memoryview(ids.buffers()[2])
        for i, a, b in zip(plain, [0, *at], at, strict=False):
            out[i] = bytes(raw[a:b])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.split:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if PLAIN_TEXT.fullmatch(text):
            # no letter composes with another: small letters from the start, and words are remembered once
            text = text.lower()
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
