"""MD5 of many texts at once: each step of the hash is taken for thousands of texts as an array of numbers.

``Walks`` are the texts that follow a step of a graph, as columns of words, so that a text's words are looked up and
moved by its prefix's length, never written out. Texts of one prefix and first step share the hash of their first 64
bytes where these are the same."""

from __future__ import annotations

import math

import numpy as np

#: Texts that are hashed at once: so many that a step's overhead is small, so few that its arrays stay in the cache.
LANES = 24_576
#: Texts and bytes that the columns of all walks from steps have at most.
TABLED, TABLED_BYTES = 1_000_000, 96_000_000

_INIT = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_K = [np.array(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF, np.uint32) for i in range(64)]
_LEFT = [np.array(r, np.uint32) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
_RIGHT = [np.array(32 - int(r), np.uint32) for r in _LEFT]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]


def compress(state: list[np.ndarray], words: list[np.ndarray | None]) -> list[np.ndarray]:
    """The state after a block of 16 words, None: zeros."""
    add, xor, and_, or_, left, right = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.left_shift, np.right_shift
    a, b, c, d = (x.copy() for x in state)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            xor(c, d, f)
            and_(f, b, f)
            xor(f, d, f)
        elif i < 32:
            xor(b, c, f)
            and_(f, d, f)
            xor(f, c, f)
        elif i < 48:
            xor(b, c, f)
            xor(f, d, f)
        else:
            np.invert(d, f)
            or_(f, b, f)
            xor(f, c, f)
        add(a, f, a)
        if (w := words[_WORD[i]]) is not None:
            add(a, w, a)
        add(a, _K[i], a)
        left(a, _LEFT[i], g)
        right(a, _RIGHT[i], a)
        or_(a, g, a)
        add(a, b, a)
        a, b, c, d = d, a, b, c
    for x, y in zip((a, b, c, d), state):
        add(x, y, x)
    return [a, b, c, d]


def _columns(texts: list[bytes]) -> list[np.ndarray]:
    wide = -(-max(map(len, texts), default=0) // 4) * 4
    return list(np.ascontiguousarray(np.frombuffer(b"".join([x.ljust(wide, b"\0") for x in texts]), "<u4").reshape(len(texts), wide // 4).T))


class Walks:
    """Of each depth k below ``depth``: texts, the walks of k statements that begin with a step, by step; first and
    count: those of a step; size: their lengths; columns: their words with the end mark."""

    def __init__(self, graph, depth: int):
        edges, start, end, target = graph.edges, graph.start, graph.end, graph.target.tolist()
        n = len(graph.steps)
        self.texts, self.first, self.count = [[], graph.steps], [np.zeros(n, np.int64), np.arange(n)], [np.zeros(n, np.int64), np.ones(n, np.int64)]
        for k in range(2, depth):
            texts: list[bytes] = []
            before, first, count, at = self.texts[-1], self.first[-1].tolist(), self.count[-1].tolist(), [0]
            for step, node in zip(graph.steps, target):
                if node >= 0:
                    step += b"->"
                    for t in edges[start[node] : end[node]].tolist():
                        texts += [step + x for x in before[first[t] : first[t] + count[t]]]
                at.append(len(texts))
            self.texts.append(texts)
            self.first.append(np.array(at[:-1]))
            self.count.append(np.diff(at))
        self.size = [np.array([len(x) for x in t], np.int64) for t in self.texts]
        self.columns = [_columns([x + b"\x80" for x in t]) for t in self.texts]
        self.open = _columns([x + b"->" for x in graph.steps])

    @staticmethod
    def fit(graph, depth: int) -> bool:
        most = max(map(len, graph.steps), default=0) + 2
        n = [float(c.sum()) for c in graph.counts[1:depth]]
        return not graph.null and sum(n) <= TABLED and sum(k * most * x for k, x in enumerate(n, 1)) <= TABLED_BYTES


def _words(block: int, columns: list[np.ndarray], ids, prefix: list[np.ndarray], pair, length: int) -> list[np.ndarray | None]:
    """The block's words of the texts: ``length`` bytes of prefix (by pair), then columns (by id)."""
    whole, over = divmod(length, 4)
    up, down = np.array(8 * over, np.uint32), np.array(32 - 8 * over, np.uint32)
    out: list[np.ndarray | None] = []
    last = None
    for g in range(16 * block, 16 * block + 16):
        w, j = None, g - whole
        if g < whole or (g == whole and over):
            w = prefix[g].take(pair)
        if over and 0 < j <= len(columns):
            x = np.right_shift(columns[j - 1].take(ids) if last is None else last, down)
            w = x if w is None else w | x
        last = columns[j].take(ids) if 0 <= j < len(columns) else None
        if last is not None:
            x = last << up if over else last
            w = x if w is None else w | x
        out.append(w)
    return out


def _hashed(state, block: int, columns, ids, size, prefix, pair, length: int) -> np.ndarray:
    """The first 8 bytes of the hashes, as numbers, of texts of ``size`` bytes, from the state before the block on."""
    last = (size + 8) // 64
    words = _words(block, columns, ids, prefix, pair, length)
    ends = last == block
    if ends.any():
        bits = np.where(ends, 8 * size, 0).astype(np.uint32)
        words[14] = bits if words[14] is None else words[14] | bits
    state = compress(state, words)
    top = (state[0].byteswap().astype(np.uint64) << np.uint64(32)) | state[1].byteswap()
    if not ends.all():
        more = np.flatnonzero(~ends)
        top[more] = _hashed([x.take(more) for x in state], block + 1, columns, ids.take(more), size.take(more), prefix, pair.take(more), length)
    return top


def _begin(n: int) -> list[np.ndarray]:
    return [np.full(n, x, np.uint32) for x in _INIT]


def hashes(walks: Walks, depths: list[int], prefixes: list[bytes], steps: np.ndarray, pair: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of prefixes of one length, each followed by steps (pair: a step's prefix): for each depth of the walks that begin
    with these, their prefix, their number in ``walks`` and the first 8 bytes of their hash as a number."""
    length = len(prefixes[0])
    prefix = _columns([x.ljust(length // 4 * 4 + 4, b"\0") for x in prefixes])
    reach = length + walks.size[1][steps]
    shared = reach + 2 >= 64 if length < 64 and max(depths) > 1 else np.zeros(len(steps), bool)
    state = [np.empty(len(steps), np.uint32) for _ in _INIT]
    at = np.flatnonzero(shared)
    for i in range(0, len(at), LANES):
        some = at[i : i + LANES]
        for x, y in zip(state, compress(_begin(len(some)), _words(0, walks.open, steps[some], prefix, pair[some], length))):
            x[some] = y
    out = {}
    for k in depths:
        if k == 1:
            origin, ids, known = np.arange(len(steps)), steps, shared & (reach >= 64)
        else:
            n = walks.count[k].take(steps)
            origin = np.repeat(np.arange(len(steps)), n)
            ids = np.arange(len(origin)) + np.repeat(walks.first[k].take(steps) - np.cumsum(n) + n, n)
            known = shared.take(origin)
        size, owner = length + walks.size[k].take(ids), pair.take(origin)
        top = np.empty(len(ids), np.uint64)
        for block in (0, 1):
            at = np.flatnonzero(known if block else ~known)
            for i in range(0, len(at), LANES):
                some = at[i : i + LANES]
                begin = [x.take(origin.take(some)) for x in state] if block else _begin(len(some))
                top[some] = _hashed(begin, block, walks.columns[k], ids.take(some), size.take(some), prefix, owner.take(some), length)
        out[k] = owner, ids, top
    return out
