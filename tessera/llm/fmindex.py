"""Op 6: benchmark decontamination with an FM-index for each shard of the corpus.

A shard is a run of whole documents of about CHUNK_CHARS characters (a longer document is a shard of its own). Over
all its word numbers, a separator after each document, stand a suffix array (only while building), the
Burrows-Wheeler transform in a wavelet matrix with rank blocks, and suffix positions sampled at documents' beginnings
and every SAMPLE words. ``index`` gives the indexes as a table of one row a shard, which can be kept and searched for
other benchmarks without reading the corpus again. All windows are searched backwards at once, their occurrences
located by walking to a sampled suffix, and the spans of each document merged. Items come in blocks of at most
BLOCK_WORDS words, each broadcast and searched in turn, so a benchmark of any size is covered.

Nulls: a null text has no words; a null item text no windows; a null item_id is written as the empty text. Texts are
indexed whole, however long. A window that several items share counts for each of them; overlapping spans are merged.
Repeated rows count one by one, repeated items once; with an empty benchmark nothing is hit; empty tables give empty
results; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import re
from functools import cached_property
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches, stored, with_only

WINDOW, SAMPLE, BLOCK_WORDS = 10, 8, 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of words stay, A-Z in lower case; others become spaces. All bytes from 0x80 on belong to words.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Wavelet:
    """A wavelet matrix over integers: rank of a symbol before a place, for many at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n, self.levels = len(symbols), []
        s = symbols
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            b = (s >> bit) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = b
            packed = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            self.levels.append((bit, packed, before, self.n - int(before[-1])))
            s = np.concatenate([s[b == 0], s[b == 1]])

    @staticmethod
    def _ones(packed, before, i):
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros(len(i), np.int64)
        for bit, packed, before, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            a, b = self._ones(packed, before, start), self._ones(packed, before, i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling. Only suffixes that still tie with a neighbour are sorted again; separators differ, so it
    ends by the longest repeated run."""
    n = len(seq)
    sa = np.argsort(seq)
    x = seq[sa]
    heads = np.concatenate([[True], x[1:] != x[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(heads, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank[sa] = group  # a suffix's rank: the first row of those it ties with
    k, tied = 1, np.flatnonzero(~(heads & np.concatenate([heads[1:], [True]]))) if n else np.zeros(0, np.int64)
    while len(tied):
        at = sa[tied]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        order = np.argsort(rank[at] * (n + 2) + after)
        at, first, after = at[order], rank[at][order], after[order]
        sa[tied] = at  # tied rows are ascending, and so are the groups
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (after[1:] != after[:-1])])
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    return sa


class FMIndex:
    """Over runs of word numbers (from 1); each run is followed by a separator of its own, lower than all words."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, top: int):
        seps, size = len(sizes), np.asarray(sizes, np.int64) + 1
        self.start = np.cumsum(size) - size
        last = self.start + size - 1
        seq = np.zeros(int(size.sum()), np.int64)
        inner = np.ones(len(seq), bool)
        inner[last] = False
        seq[inner] = ids + seps
        seq[last] = np.arange(seps)
        sa = suffix_array(seq)
        word = np.where(seq < seps, 0, seq - seps)
        self._over(word[sa - 1], np.bincount(word, minlength=top + 1), top)
        inside = np.arange(len(seq)) - np.repeat(self.start, size)
        self.sampled = inside[sa] % SAMPLE == 0
        self.positions = sa[self.sampled]
        self.place = np.cumsum(self.sampled) - 1

    def _over(self, bwt: np.ndarray, counts: np.ndarray, top: int) -> None:
        self.bwt, self.n, self.top, self.counts = bwt, len(bwt), top, counts
        self.first = np.concatenate([[0], np.cumsum(counts)])[: top + 1]

    @cached_property
    def wavelet(self) -> Wavelet:
        return Wavelet(self.bwt, self.top)

    def dump(self, **more: np.ndarray) -> bytes:
        """The index as bytes, with further arrays."""
        small = np.uint16 if self.top < 1 << 16 else np.uint32
        out = io.BytesIO()
        np.savez(out, bwt=self.bwt.astype(small), counts=self.counts.astype(np.uint32), start=self.start, sampled=np.packbits(self.sampled), positions=self.positions.astype(np.uint32), **more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[FMIndex, dict[str, np.ndarray]]:
        z = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self._over(z["bwt"].astype(np.int64), z["counts"].astype(np.int64), len(z["counts"]) - 1)
        self.start, self.positions = z["start"], z["positions"].astype(np.int64)
        self.sampled = np.unpackbits(z["sampled"], count=self.n).astype(bool)
        self.place = np.cumsum(self.sampled) - 1
        return self, {k: z[k] for k in z.files}

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns, which are right-aligned in the matrix; a word number of 0 is none."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width - 1, -1, -1):
            hi[(lengths >= width - k) & (patterns[:, k] == 0)] = 0
            on = np.flatnonzero((lengths >= width - k) & (lo < hi))
            if len(on):
                c = patterns[on, k]
                lo[on], hi[on] = self.first[c] + self.wavelet.rank(c, lo[on]), self.first[c] + self.wavelet.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            at = self.sampled[rows[todo]]
            done = todo[at]
            out[done] = self.positions[self.place[rows[done]]] + steps
            todo = todo[~at]
            c = self.bwt[rows[todo]]
            rows[todo] = self.first[c] + self.wavelet.rank(c, rows[todo])
            steps += 1
        return out


def windows(items: list[tuple[str, str | None]], size: int = WINDOW) -> dict:
    """Vocabulary, right-aligned window matrix, lengths, and the items of each window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], dict[str, None]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + size]), {})[item] = None
    matrix = np.zeros((len(found), size), np.int64)
    for r, w in enumerate(found):
        matrix[r, size - len(w) :] = w
    return {"words": list(vocabulary), "matrix": matrix, "lengths": np.array([len(w) for w in found], np.int64), "items": [list(x) for x in found.values()]}


def blocks_of(benchmark: DataFrame, size: int = WINDOW) -> list:
    """Broadcast blocks of windows, one after the other held on the driver."""
    out, held, n = [], [], 0
    sc = benchmark.sparkSession.sparkContext
    for r in with_only(benchmark, item_id="string", text="string").toLocalIterator():
        k = len(words_of(r["text"]))
        if held and n + k > BLOCK_WORDS:
            out.append(sc.broadcast(windows(held, size)))
            held, n = [], 0
        held.append((r["item_id"] or "", r["text"]))
        n += k
    return [*out, sc.broadcast(windows(held, size))] if held else out


class Numbers(dict):
    """Words to numbers from 1, in the order that they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def build(texts: list[str | None]) -> tuple[FMIndex, dict[bytes, int], list[int]]:
    """(index, the numbers of its words, words of each text) of a shard."""
    numbers = Numbers()
    words = [words_of(t) for t in texts]
    sizes = [len(w) for w in words]
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
    return FMIndex(ids, np.array(sizes, np.int64), len(numbers)), numbers, sizes


def find(index: FMIndex, numbers: dict[bytes, int], sizes: list[int], blocks: list) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Of each document of a shard: merged spans of hit words, items with occurring windows."""
    mark = np.zeros(index.n + 1, np.int64)
    items: list[set[str]] = [set() for _ in sizes]
    for shared in blocks:
        b = shared.value
        if len(b["items"]) and index.n:
            number = np.array([0, *(numbers.get(w, 0) for w in b["words"])], np.int64)
            lo, hi = index.search(number[b["matrix"]], b["lengths"])
            hit = np.flatnonzero(hi > lo)
            count = hi[hit] - lo[hit]
            which = np.repeat(hit, count)
            at = index.locate(np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))
            np.add.at(mark, at, 1)
            np.add.at(mark, at + b["lengths"][which], -1)
            doc = np.searchsorted(index.start, at, side="right") - 1
            for d, w in set(zip(doc.tolist(), which.tolist())):
                items[d].update(b["items"][w])
        if len(blocks) > 1:
            del b, shared._value  # read again from disk when next needed
    on = np.cumsum(mark[:-1]) > 0
    spans = []
    for d, (a, n) in enumerate(zip(index.start.tolist(), sizes)):
        if items[d]:
            flips = np.flatnonzero(np.diff(np.concatenate([[0], on[a : a + n].astype(np.int8), [0]])))
            spans.append(list(zip(flips[::2].tolist(), flips[1::2].tolist())))
        else:
            spans.append([])
    return spans, items


def index(docs: DataFrame) -> DataFrame:
    """doc_ids (of a shard's documents, in order), words (of the shard, joined by spaces), payload: one row a shard."""

    def make():
        def kernel(c):
            fm, numbers, sizes = build(c["text"])
            yield {"doc_ids": [c["doc_id"]], "words": [b" ".join(numbers)], "payload": [fm.dump(sizes=np.array(sizes, np.int64))]}

        return kernel

    return map_batches(with_only(docs, doc_id="long", text="string"), make, "doc_ids array<long>, words binary, payload binary")


def search(shards: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words, end exclusive) and items, from the indexes."""
    blocks = blocks_of(benchmark, size)

    def make():
        def kernel(c):
            for ids, words, payload in zip(c["doc_ids"], c["words"], c["payload"]):
                fm, more = FMIndex.load(payload)
                sizes = more["sizes"].tolist()
                spans, items = find(fm, {w: i for i, w in enumerate(words.split(b" "), 1)} if words else {}, sizes, blocks)
                names = [sorted(i) for i in items]
                hit = [sum(e - a for a, e in s) for s in spans]
                yield {
                    "doc_id": ids, "n_words": sizes, "n_hit": hit, "n_items": [len(i) for i in names], "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in names],
                    "contaminated": [h > 0 for h in hit], "spans": [[{"start": a, "end": e} for a, e in s] for s in spans], "items": names,
                }

        return kernel

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>, items array<string>"
    return map_batches(shards, make, schema, text="payload")


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """What ``search`` gives, by way of a table of the shards' indexes."""
    return search(stored(index(docs)), benchmark, size)


def remove(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents (with the columns of documents) without the merged spans; a text of which nothing is left goes.
    Each shard's index is built, searched and dropped beside its texts, which so need no shuffle."""
    blocks = blocks_of(benchmark, size)

    def make():
        def kernel(c):
            out = {k: [] for k in c}
            for i, spans in enumerate(find(*build(c["text"]), blocks)[0]):
                text = c["text"][i]
                if spans:
                    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
                    for a, e in reversed(spans):
                        text = text[: places[a][0]] + "\n" + text[places[e - 1][1] :]
                    if not WORD.search(text.translate(LOWER)):
                        continue
                for k in c:
                    out[k].append(c[k][i])
                out["text"][-1] = text
                if spans and c["n_chars"][i] is not None:
                    out["n_chars"][-1] = len(text)
            yield out

        return kernel

    d = with_only(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long")
    return map_batches(d, make, "doc_id long, text string, lang string, source string, n_chars long")


LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
