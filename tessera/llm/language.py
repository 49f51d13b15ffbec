"""Op 2: language identification by segmentation-marginalised unigrams.

Texts are lower-cased and cut into runs of letters. Over all letter pieces of a fixed public vocabulary each language
has piece probabilities; a word's probability is the sum over all its segmentations (forward algorithm), and a text's
the product over its words. Learning is expectation-maximisation over the counted words of each language: from equal
piece probabilities, forward and backward sums give each piece's expected count, until a step raises the
log-likelihood by less than SETTLED of it. The model has (languages x vocabulary) numbers, so it is collected and
broadcast; the words are counted once and stay distributed.

Nulls and texts without a letter get ``und`` and score 0. A null lang is not learned from. Without any labelled text
all are ``und``. Whole texts and whole words count, however long: sums over words of more than LINEAR letters are
taken in logarithms. Of equally likely languages the first by name is predicted. Repeated rows count one by one;
empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property
from itertools import groupby, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, held_out, map_batches, remembered, stored, with_only
from .tokens import tokenizer_path

LETTERS = re.compile(r"[^\W\d_]+")
#: A character that is no piece: as likely in each language.
UNKNOWN, SMOOTH, SETTLED = 1e-8, 0.1, 1e-3
LINEAR, BLOCK, MEMORY = 30, 8_000, 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = 18


@remembered()
def letters() -> np.ndarray:
    """Whether LETTERS takes a character, by its code."""
    out = np.zeros(0x110000, bool)
    for run in LETTERS.findall("".join(map(chr, range(0x110000)))):
        out[ord(run[0]) : ord(run[0]) + len(run)] = True
    return out


def words_of(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """What LETTERS finds in the lower-cased texts, in a row, and the place in it where each text begins, with the end."""
    texts = [(t or "").lower() for t in texts]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    joined = "\n".join(texts)
    del texts
    try:
        coding, codes = "latin-1", np.frombuffer(joined.encode("latin-1"), "u1")
    except UnicodeEncodeError:
        coding, codes = "utf-32-le", np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    del joined
    good = letters()[codes]
    codes = np.where(good, codes, codes.dtype.type(32))
    joined = str(codes, coding, "surrogatepass")
    del codes
    good[1:] &= ~good[:-1]  # the words' first letters
    at = np.searchsorted(np.flatnonzero(good), begin)
    return joined.split(), at


class Pieces:
    """The letters-only pieces of a public SentencePiece vocabulary. All spans of many words are looked up at once by
    rolling hashes, in a table of the pieces' beginnings with open addressing, as long as they begin a piece; that no
    two beginnings share a hash is checked."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        known = list(dict.fromkeys(p for i in range(sp.get_piece_size()) if LETTERS.fullmatch((p := sp.id_to_piece(i).lower()).removeprefix("▁"))))
        self.pieces, self.n, self.longest = known, len(known), max(map(len, known))
        begins = [*sorted({w[:k] for w in known for k in range(1, len(w) + 1)}, key=len), ""]  # the last one stands for none
        number, at, going = {w: i for i, w in enumerate(known)}, {w: i for i, w in enumerate(begins)}, {w[:-1] for w in begins[:-1]} - {""}
        #: Of each beginning: the piece that it is (-1: none), whether it begins a longer one.
        self.piece_at, self.goes_on = np.array([number.get(w, -1) for w in begins]), np.array([w in going for w in begins])
        self.hashes = h = np.zeros(len(begins), np.uint64)
        for _, level in groupby(begins[:-1], len):
            level = list(level)
            h[[at[w] for w in level]] = self.roll(h[[at[w[:-1]] for w in level]], np.array([ord(w[-1]) for w in level], np.uint64))
        assert len(np.unique(h)) == len(begins)
        self.table, self.probes = np.full((1 << BITS) + 64, -1, np.int32), 1
        for i, slot in enumerate((h[:-1] >> np.uint64(64 - BITS)).tolist()):
            k = next(k for k in range(64) if self.table[slot + k] < 0)
            self.table[slot + k], self.probes = i, max(self.probes, k + 1)

    @staticmethod
    def roll(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * MIX
        return (h ^ (h >> np.uint64(29))) * MIX

    def find(self, h: np.ndarray) -> np.ndarray:
        """The beginnings with these hashes, -1 for none."""
        slot = (h >> np.uint64(64 - BITS)).astype(np.int64)
        found = self.table[slot]
        other = self.hashes[found] != h
        out = np.where(other, np.int32(-1), found)
        todo = np.flatnonzero(other & (found >= 0))
        for k in range(1, self.probes):
            found = self.table[slot[todo] + k]
            good = (found >= 0) & (self.hashes[found] == h[todo])
            out[todo[good]] = found[good]
            todo = todo[(found >= 0) & ~good]
        return out

    def lattice(self, words: list[str]) -> Lattice:
        """Of words with their start mark. Nodes are the places before, between and after the characters of each word,
        numbered by place, then by word from the longest to the shortest."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.array([len(w) for w in words])
        order = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        with_place = len(size) - np.cumsum(np.bincount(size + 1))  # how many words have a place
        place_at = np.cumsum([0, *with_place])[: len(with_place)]
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        node = place_at[place] + rank[word]
        first, last = rank, place_at[size] + rank
        code = np.zeros(len(codes) + len(size), np.uint64)
        after = np.full(len(code), -1)
        of = np.empty(len(code), np.int32)
        code[node], after[node], of[node], of[last] = codes, place_at[place + 1] + rank[word], word, np.arange(len(size))
        source = here = np.flatnonzero(after >= 0)
        h = np.zeros(len(here), np.uint64)
        edges = []
        for n in range(1, self.longest + 1):
            h, here = self.roll(h, code.take(here)), after.take(here)
            begins = self.find(h)
            piece = self.piece_at[begins]
            if n == 1:  # a character that is no piece
                piece[piece < 0] = self.n
            good = np.flatnonzero(piece >= 0)
            edges.append((source.take(good), here.take(good), piece.take(good)))
            on = np.flatnonzero(self.goes_on[begins] & (after.take(here) >= 0))
            if not len(on):
                break
            source, here, h = source.take(on), here.take(on), h.take(on)
        return Lattice(first, last, of, place_at, edges)


@remembered(2)
def pieces_of(path: str) -> Pieces:
    """One table for all tasks that a Python worker runs."""
    return Pieces(path)


class Lattice:
    """Edges from node to node, each with a piece: by the piece's length, then by source."""

    def __init__(self, first, last, of, place_at, edges):
        self.first, self.last, self.nodes = first, last, len(of)
        self.source, self.target, self.piece = (np.concatenate(x) for x in zip(*edges))
        self.word, self.length, self.place_at = of[self.source], np.repeat(np.arange(1, len(edges) + 1), [len(x[0]) for x in edges]), place_at
        self.by_length = [len(x[0]) for x in edges]

    @cached_property
    def runs(self) -> list[tuple[int, int]]:
        """(start, end) of the edges of one source place and one length, by place: no two share a source or a target."""
        a, cuts = 0, []
        for n in self.by_length:
            cuts.append((a + np.searchsorted(self.source[a : a + n], [*self.place_at, self.nodes])).tolist())
            a += n
        return [(c[i], c[i + 1]) for i in range(len(self.place_at)) for c in cuts if c[i] < c[i + 1]]

    def sums(self, p: np.ndarray, logs: bool, back: bool = False) -> np.ndarray:
        """For each node and column of p: the sum over all segmentations of its word before it (back: after it)."""
        here, there = (self.target, self.source) if not back else (self.source, self.target)
        f = np.full((self.nodes, p.shape[1]), -np.inf if logs else 0.0)
        f[self.last if back else self.first] = 0.0 if logs else 1.0
        if not logs:
            flat = f[:, 0] if p.shape[1] == 1 else f
            p = p[:, 0] if p.shape[1] == 1 else p
            for a, b in self.runs[:: -1 if back else 1]:
                flat[here[a:b]] = flat.take(here[a:b], axis=0) + flat.take(there[a:b], axis=0) * p.take(self.piece[a:b], axis=0)
            return f
        depth = np.searchsorted(self.place_at, self.source, "right") - 1
        level = depth + self.length if not back else -depth
        order = np.argsort((level - level.min(initial=0)) * self.nodes + here)  # by level, then by node
        here, there, piece, level = here[order], there[order], self.piece[order], level[order]
        cut = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]])) if len(level) else []
        new = np.concatenate([[True], here[1:] != here[:-1]])
        for a, b in zip(cut, [*cut[1:], len(level)]):
            heads = np.flatnonzero(new[a:b])
            to = here[a:b][heads]
            x = f[there[a:b]] + p[piece[a:b]]
            top = np.maximum.reduceat(x, heads)
            f[to] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff([*heads, b - a]), axis=0)), heads))
        return f


def blocks_of(words: list[str]):
    """(numbers of the words, whether in logarithms): words of LINEAR letters at most in blocks of like lengths, longer
    ones in others."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    cut = int(np.searchsorted(size[order], LINEAR, "right"))
    for which, logs in ((order[:cut], False), (order[cut:], True)):
        for a in range(0, len(which), BLOCK):
            yield which[a : a + BLOCK], logs


def expected(pieces: Pieces, words: list[str], counts: list[int], p: np.ndarray) -> tuple[np.ndarray, float]:
    """(expected uses of each piece over all segmentations of the words, log-likelihood) under p."""
    total, likely = np.zeros(pieces.n + 1), 0.0
    p, numbers = np.append(p, UNKNOWN)[:, None], np.array(counts, float)
    for which, logs in blocks_of(words):
        x = pieces.lattice(["▁" + words[i] for i in which])
        q = np.log(p) if logs else p
        f, b = x.sums(q, logs)[:, 0], x.sums(q, logs, back=True)[:, 0]
        n, end = numbers[which], f[x.last]
        if logs:
            uses = np.exp(f[x.source] + q[x.piece, 0] + b[x.target] - end[x.word]) * n[x.word]
        else:
            uses = f[x.source] * q[x.piece, 0] * b[x.target] * (n / end)[x.word]
            end = np.log(end)
        likely += float((n * end).sum())
        total += np.bincount(x.piece, uses, minlength=pieces.n + 1)
    return total[:-1], likely


def learn(docs: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by language) from rows with a text and a lang."""

    def make_counts():
        words: dict[str, Counter] = {}

        def out():
            for lang, counter in words.items():
                yield {"lang": [lang] * len(counter), "word": list(counter), "n": list(counter.values())}
                counter.clear()

        class Kernel:
            def __call__(self, c):
                found, at = words_of(c["text"])
                for lang, a, b in zip(c["lang"], at, at[1:]):
                    words.setdefault(lang, Counter()).update(found[a:b])
                if sum(map(len, words.values())) > MEMORY:
                    yield from out()

            def close(self):
                return out()

        return Kernel()

    sc = docs.sparkSession.sparkContext
    counted = stored(map_batches(docs.select("text", "lang"), make_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    n = pieces_of(path).n
    if not langs:
        return [], np.full((1, n), 1.0 / n)
    p, before = np.full((len(langs), n), 1.0 / n), None
    while True:
        model = sc.broadcast((langs, p))

        def make(model=model):
            pieces, (langs, p) = pieces_of(path), model.value
            sums = {lang: np.zeros(pieces.n) for lang in langs}
            likely = dict.fromkeys(langs, 0.0)
            held: dict[str, tuple[list, list]] = {lang: ([], []) for lang in langs}
            chars = dict.fromkeys(langs, 0)

            def add(lang):
                words, counts = held[lang]
                if words:
                    total, x = expected(pieces, words, counts, p[langs.index(lang)])
                    sums[lang] += total
                    likely[lang] += x
                    held[lang], chars[lang] = ([], []), 0

            class Kernel:
                def __call__(self, c):
                    for lang, word, k in zip(c["lang"], c["word"], c["n"]):
                        words, counts = held[lang]
                        words.append(word)
                        counts.append(k)
                        chars[lang] += len(word)
                    much = sum(chars.values()) > CHUNK_CHARS
                    for lang in langs:
                        if much or len(held[lang][0]) >= BLOCK:
                            add(lang)
                    return ()

                def close(self):
                    for lang, total in sums.items():
                        add(lang)
                        at = np.flatnonzero(total)
                        yield {"lang": [lang] * (len(at) + 1), "piece": [-1, *at.tolist()], "n": [likely[lang], *total[at].tolist()]}

            return Kernel()

        rows = map_batches(counted, make, "lang string, piece int, n double", text="word").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        p, now = np.full((len(langs), n), SMOOTH), 0.0
        for r in rows:
            if r["piece"] < 0:
                now += r["n"]
            else:
                p[langs.index(r["lang"]), r["piece"]] += r["n"]
        p /= p.sum(axis=1, keepdims=True)
        if before is not None and now - before < SETTLED * abs(before):
            return langs, p
        before = now


class Rows(dict):
    """The rows of words; a new word gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Scorer:
    """Log-probabilities of words by language; the words met last are remembered as rows of a matrix."""

    def __init__(self, path: str, p: np.ndarray):
        self.pieces = pieces_of(path)
        self.p = np.vstack([p.T, np.full((1, len(p)), UNKNOWN)])
        self.log_p = np.log(self.p)
        self.rows = Rows()
        self.logs = np.zeros((0, len(p)))

    def learn(self, words: list[str]) -> None:
        logs = np.zeros((len(words), self.p.shape[1]))
        for which, in_logs in blocks_of(words):
            x = self.pieces.lattice(["▁" + words[i] for i in which])
            f = x.sums(self.log_p if in_logs else self.p, in_logs)[x.last]
            logs[which] = f if in_logs else np.log(f)
        self.logs = np.concatenate([self.logs, logs])

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        words, at = words_of(texts)
        if len(self.rows) > 1.5 * MEMORY:
            self.rows, self.logs = Rows(), self.logs[:0]
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        self.learn(list(islice(reversed(self.rows), len(self.rows) - len(self.logs)))[::-1])
        return [self.logs.take(rows[a:b], axis=0).sum(axis=0) if a < b else None for a, b in zip(at, at[1:])]


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score beside doc_id and the ``keep`` columns."""
    model = docs.sparkSession.sparkContext.broadcast((langs, p))
    names = ["doc_id", "text", *(k for k in keep if k not in ("doc_id", "text"))]
    out = ["doc_id", *keep]

    def make():
        langs, p = model.value
        scorer = Scorer(path, p)

        def kernel(c):
            pred, score = [], []
            for s in scorer.texts(c["text"]) if langs else [None] * len(c["text"]):
                if s is None:
                    pred.append("und")
                    score.append(0.0)
                else:
                    best = int(np.argmax(s))
                    pred.append(langs[best])
                    score.append(float(1.0 / np.exp(s - s[best]).sum()))
            yield {k: c[k] for k in out} | {"lang_pred": pred, "score": score}

        return kernel

    df = docs.select(*names)
    types = dict(df.dtypes)
    return map_batches(df, make, ", ".join(f"{k} {types[k]}" for k in out) + ", lang_pred string, score double")


def fit(docs: DataFrame, path: str | None = None):
    train = with_only(docs, doc_id="long", text="string", lang="string").filter(~held_out()).filter("text is not null and lang is not null")
    path = path or tokenizer_path("piece_bpe_32k.model")
    return (*learn(train, path), path)


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    langs, p, path = fit(docs, path)
    d = predict(with_only(docs, doc_id="long", text="string"), langs, p, path)
    return d.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, path: str | None = None) -> DataFrame:
    """The documents (with their columns) whose language is identified with a score of ``least`` or more."""
    langs, p, path = fit(docs, path)
    d = predict(with_only(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long"), langs, p, path, keep=("text", "lang", "source", "n_chars"))
    return d.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
