"""Token ids of whole texts by public tokenizers, with a bounded memory of chunks that were met before.

Both tokenizers split a text before merging, and never merge across the cuts made here, so the ids of a text are
the concatenated ids of its chunks. Latin-1 texts are cut just as the tokenizers do it, others at white space. For
the word tokenizer the Latin-1 texts of a group are cut as arrays of bytes, and a chunk that is met often in the group
becomes a Python object once.
Texts with white space outside ASCII's four usual characters, or with a ``<|``, go to the tokenizer whole, so that
the names of special tokens in a text become what the library makes of them (their ids).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute

from .common import remembered

#: White space that the chunk patterns don't cover, and the start of special tokens' names.
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]|<\\|")
BYTE_CHUNK = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?=[ \t\n\r][^ \t\n\r])|[ \t\n\r]+")
WORD_CHUNK = re.compile(r"[^ \t\n\r]+")
#: The tokenizers' own cuts, with the letters and numbers of Latin-1 spelled out; for the second one in lower case.
SMALL, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
BIG = "A-ZÀ-ÖØ-Þ" + SMALL
ENDS = "'(?:s|t|re|ve|m|ll|d)"
LATIN_BYTE = re.compile(rf"{ENDS}| ?[{BIG}]+| ?[{DIGITS}]+| ?[^\s{BIG}{DIGITS}]+|\s+(?!\S)|\s+")
LATIN_WORD = re.compile(rf"{ENDS}|[{SMALL}]+|[{DIGITS}]|[^\s{SMALL}{DIGITS}]+")
#: White space beside the usual four characters, in Latin-1.
RARE_BYTES = b"\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
#: By kind of tokenizer: how Latin-1 texts and how others are cut, and what stands between chunks that are encoded together.
KINDS = {"byte": (LATIN_BYTE, BYTE_CHUNK, "\n"), "word": (LATIN_WORD, WORD_CHUNK, " ~ ")}
#: For Latin-1 bytes: their lower case, and the classes whose runs LATIN_WORD's chunks are (of digits, each one).
LOWER = bytes(ord(chr(b).lower()) for b in range(256))
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASSES = bytes(SPACE if c.isspace() else LETTER if re.match(f"[{SMALL}]", c) else DIGIT if re.match(f"[{DIGITS}]", c) else OTHER for c in map(chr, range(256)))


def word_cuts(data: bytes) -> np.ndarray:
    """Where the chunks of LATIN_WORD, and the runs of white space between them, begin and end in lower-case Latin-1
    text. The text ends with two characters of white space."""
    kind, raw = np.frombuffer(data.translate(CLASSES), np.uint8), np.frombuffer(data, np.uint8)
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at = np.flatnonzero(raw[:-2] == ord("'"))
    at = at[edge[at]]  # within a run, an apostrophe begins no ending
    a, b = raw[at + 1], raw[at + 2]
    short = at[np.isin(a, np.frombuffer(b"stmd", np.uint8))]
    long = at[np.isin(a, np.frombuffer(b"rv", np.uint8)) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
    edge[short + 1] = edge[long + 1] = False
    edge[short + 2] = edge[long + 3] = True
    return np.flatnonzero(edge).astype(np.int32)


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes texts to little-endian ids of type ``dtype`` (16 bits if the vocabulary fits), as bytes; ``numbers`` gives
    them as 32 bits. At most 2 * ``generation`` chunks are remembered."""

    def __init__(self, path: str, kind: str, generation: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.latin, self.cut, self.between = KINDS[kind]
        self.lower = kind == "word"
        #: Ids that end a word (word tokenizer) or begin with a space (byte tokenizer).
        self.edge = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.edge[[i for t, i in self.tokenizer.get_vocab().items() if (t.endswith("</w>") if self.lower else t.startswith("Ġ"))]] = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.generation, self.young, self.old = generation, {}, {}
        mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        assert len(mark) == 1
        self.mark = mark[0]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without the separator in them: encoded as one text, then cut at the separator's id."""
        ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(ids == self.mark)
        if len(ends) != len(chunks) - 1:
            return self._plain(chunks)
        w = self.dtype.itemsize
        data, at = ids.tobytes(), [0, *((ends + 1) * w).tolist()]
        return [data[a : b - w] for a, b in zip(at, [*at[1:], len(data) + w])]

    def _glued(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that are cut apart by their own ids: words, or runs that begin with their only space."""
        ids = np.array(self.tokenizer.encode_batch_fast([(" " if self.lower else "").join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(chunks):
            return self._joined(chunks)
        data = ids.tobytes()
        w = self.dtype.itemsize
        at = [0, *((at + 1) * w).tolist()] if self.lower else [*(at * w).tolist(), len(data)]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _words(self, raw: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts by the word tokenizer: all are cut at once, and each different chunk is looked up once."""
        data = b"\n".join(raw).translate(LOWER) + b"\n\n"
        cuts = word_cuts(data)
        chunks = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        different = pa.ListArray.from_arrays(pa.array([0, len(chunks.dictionary)], pa.int32()), chunks.dictionary)
        names = pa.compute.binary_join(different, b"\x1c")[0].as_py().decode("latin-1").split("\x1c")  # a rare character, in no chunk
        known = list(map(self.young.get, names))
        self._learn([c for c, ids in zip(names, known) if ids is None])
        ids = pa.array([self.young[c] if x is None else x for c, x in zip(names, known)], pa.binary()).take(chunks.indices)
        _, places, out = ids.buffers()
        ends = np.searchsorted(cuts, np.cumsum([len(x) + 1 for x in raw]) - 1)  # the white space behind a text has no ids
        at = [0, *np.frombuffer(places, np.int32, len(ids) + 1)[ends].tolist()]
        out = out.to_pybytes() if out else b""
        return [out[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, chunks: Iterable[str]) -> None:
        if len(self.young) > self.generation:
            self.old, self.young = self.young, {}
        old, young, new = self.old, self.young, []
        for c in [c for c in chunks if c not in young]:  # a difference of keys would go through all that is remembered
            if (ids := old.get(c)) is None:
                new.append(c)
            else:
                young[c] = ids
        sign = self.between.strip() or self.between
        glued, easy, hard = [], [], []
        for c in new:
            if c.isalpha() and c.islower() if self.lower else c[0] == " " and c[1:].isalpha():
                glued.append(c)
            elif sign not in c and not c.isspace():
                easy.append(c)
            else:
                hard.append(c)
        for kind, encode in ((glued, self._glued), (easy, self._joined)):
            for i in range(0, len(kind), 512):
                young.update(zip(kind[i : i + 512], encode(kind[i : i + 512])))
        if hard:
            young.update(zip(hard, self._plain(hard)))

    def numbers(self, data: bytes, end: int | None = None) -> np.ndarray:
        """The ids of encoded bytes, and the end id behind them."""
        n = len(data) // self.dtype.itemsize
        out = np.empty(n + (end is not None), "<u4")
        out[:n] = np.frombuffer(data, self.dtype)
        if end is not None:
            out[n] = end
        return out

    def chunks(self, text: str | None) -> list[str] | bytes | None:
        """The chunks of a text, or its bytes if ``_words`` cuts it; None if it is empty or goes whole."""
        if not text:
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None if RARE.search(text) else self.cut.findall(text)
        if b"<|" in raw or len(raw.translate(None, RARE_BYTES)) != len(raw):
            return None
        return raw if self.lower else self.latin.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.chunks(t) for t in texts]
        whole = [t for t, c in zip(texts, cuts) if c is None and t]
        whole_ids = iter(self._plain(whole) if whole else ())
        raw = [c for c in cuts if isinstance(c, bytes)]
        raw_ids = iter(self._words(raw) if raw else ())
        self._learn(set(chain.from_iterable(c for c in cuts if isinstance(c, list))))
        get = self.young.__getitem__
        return [b"".join(map(get, c)) if isinstance(c, list) else next(raw_ids) if c else next(whole_ids) if t else b"" for t, c in zip(texts, cuts)]


@remembered(2)
def encoder(path: str, kind: str, generation: int = 300_000) -> ChunkEncoder:
    """One encoder for all tasks that a Python worker runs, with what it remembers."""
    return ChunkEncoder(path, kind, generation)
