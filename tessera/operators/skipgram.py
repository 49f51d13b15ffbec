"""Skip-gram vectors with negative sampling, of a vocabulary that no machine holds whole.

Sentences are dealt to blocks by a key. Each block trains its own words, from vectors that the words' hashes give, and a
word's vectors are averaged over the blocks that have it, weighted by its occurrences there; the next iteration begins with
the averages. So a word of one block's sentences only is trained as by a single worker. Noise words come from the block's
words with the power 3/4 of their counts: ``negative`` a pair, drawn for a batch of pairs together and weighted to that
number. Null words and null sentences are left out; a sentence of one word gives its word its first vector."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored

#: Sentences of a block, pairs of a batch, noise words of a batch.
BLOCK, BATCH, NOISE = 100_000, 16, 64
#: Of a word that a batch has often, the sum of its learning rates there at most; more at once would not converge.
STEP = 2.0


def first_vectors(words: list[str], size: int, seed: int) -> np.ndarray:
    """Uniform in +-0.5 / size, the same for a word wherever it is."""
    h = np.array([int.from_bytes(md5(f"{seed} {w}".encode()).digest()[:8], "little") for w in words], np.uint64)
    with np.errstate(over="ignore"):
        x = h[:, None] + (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((((x ^ (x >> np.uint64(31))) >> np.uint64(40)) / (1 << 24) - 0.5) / size).astype(np.float32)


def pairs(sentence: np.ndarray, window: int, random) -> tuple[np.ndarray, np.ndarray]:
    """Places of words and of their neighbours in the same sentence, within a width by chance of 1 to ``window``."""
    n = len(sentence)
    width = random.integers(1, window + 1, n)
    words, near = [], []
    for k in range(1, min(window, n - 1) + 1):
        same = sentence[k:] == sentence[:-k]
        for word, other in ((np.arange(n - k), np.arange(k, n)), (np.arange(k, n), np.arange(n - k))):
            on = same & (width[word] >= k)
            words.append(word[on])
            near.append(other[on])
    words, near = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, near))
    by = np.argsort(words, kind="stable")
    return words[by], near[by]


def _add(to: np.ndarray, at: np.ndarray, what: np.ndarray, weight: np.ndarray) -> None:
    """Adds rows to those at ``at``; where the weights of a word's rows sum up to more than STEP, scaled down to it."""
    by = np.argsort(at, kind="stable")
    at = at[by]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[first]] += np.add.reduceat(what[by], first) * np.minimum(1, STEP / np.add.reduceat(weight[by], first))[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(ids: np.ndarray, sentence: np.ndarray, inner: np.ndarray, outer: np.ndarray, window: int, negative: int, rates: tuple[float, float], random) -> None:
    """Changes inner and outer, the words' vectors, by one pass over the words ``ids`` of the sentences."""
    words, near = pairs(sentence, window, random)
    words, near = ids[words], ids[near]
    noise = np.cumsum(np.bincount(ids, minlength=len(inner)) ** 0.75)
    for a in range(0, len(words), BATCH):
        rate = rates[0] + (rates[1] - rates[0]) * a / len(words)
        w, x = words[a : a + BATCH], near[a : a + BATCH]
        no = np.minimum(np.searchsorted(noise, random.random(NOISE) * noise[-1], "right"), len(noise) - 1)
        v, u, un = inner[x], outer[w], outer[no]
        g = (rate * (1 - _sigmoid(np.einsum("ij,ij->i", v, u))))[:, None]
        gn = (-rate * negative / NOISE) * _sigmoid(v @ un.T) * (w[:, None] != no[None, :])
        _add(inner, x, g * u + gn @ un, np.full(len(x), rate * (1 + negative)))
        _add(outer, np.concatenate([w, no]), np.concatenate([g * v, gn.T @ v]), np.repeat([rate, rate * negative * len(w) / NOISE], [len(w), len(no)]))


def skipgram(sentences: DataFrame, by: str, size: int = 16, window: int = 5, iterations: int = 1, negative: int = 15, seed: int = 7, rates: tuple[float, float] = (0.025, 0.0001)) -> DataFrame:
    """word, vec, first (if a sentence begins with it) of the words of sentences (tokens, and the key ``by``)."""
    n = max(1, -(-sentences.count() // BLOCK))
    dealt = sentences.select(F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias("block"), "tokens")
    step = (rates[0] - rates[1]) / iterations
    schema = "word string, count long, first boolean, inner array<float>, outer array<float>"

    def block(k, key, table, known=None):
        import pyarrow as pa

        tokens = table.column("tokens").combine_chunks()
        flat = tokens.flatten()
        places = np.repeat(np.arange(len(tokens)), np.asarray(tokens.value_lengths().fill_null(0)))
        there = np.asarray(flat.is_valid())
        coded, places = flat.drop_null().dictionary_encode(), places[there]
        words, ids = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
        inner, outer = first_vectors(words, size, seed).reshape(-1, size), np.zeros((len(words), size), np.float32)
        if known is not None:
            at = {w: i for i, w in enumerate(words)}
            rows = [at[w] for w in known.column("word").to_pylist()]
            for to, c in ((inner, "inner"), (outer, "outer")):
                to[rows] = np.array(known.column(c).to_pylist(), np.float32).reshape(-1, size)
        if len(words):
            train(ids, places, inner, outer, window, negative, (rates[0] - k * step, rates[0] - (k + 1) * step), np.random.default_rng([seed, k, key]))
        first = np.zeros(len(words), bool)
        first[ids[np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))] if len(ids) else []] = True
        ends = pa.array(np.arange(len(words) + 1) * size, pa.int32())
        vectors = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (inner, outer)]
        return pa.table({"word": pa.array(words, pa.string()), "count": pa.array(np.bincount(ids, minlength=len(words)), pa.int64()), "first": pa.array(first), "inner": vectors[0], "outer": vectors[1]})

    def mean(c, what):
        return F.array(*[F.sum(F.col(c)[i].cast("double") * F.col("count")) / F.sum("count") for i in range(size)]).cast(what).alias(c)

    def later(k):
        return lambda key, table, known: block(k, key[0].as_py(), table, known)

    last = None
    for k in range(iterations):
        if k == 0:
            out = dealt.groupBy("block").applyInArrow(lambda key, t: block(0, key[0].as_py(), t), schema)
        else:
            words = dealt.select((F.col("block") + 0).alias("home"), F.explode("tokens").alias("word")).distinct().join(last, "word")
            out = dealt.groupBy("block").cogroup(words.groupBy("home")).applyInArrow(later(k), schema)
        if k == iterations - 1:
            out = out.groupBy("word").agg(mean("inner", "array<double>"), F.bool_or("first").alias("first"))
            return out.select("word", F.col("inner").alias("vec"), "first")
        before, last = last, stored(out.groupBy("word").agg(mean("inner", "array<float>"), mean("outer", "array<float>")))
        if before is not None:
            discard(before)
    raise ValueError("iterations must be 1 at least")
