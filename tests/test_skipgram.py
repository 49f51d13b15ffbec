"""Skip-gram vectors in blocks."""

import random

import numpy as np

from tessera.operators import skipgram as S
from tessera.plans import registry


def corpus(spark, n=6_000):
    r = random.Random(5)
    rows = [(f"s{k}", [f"{'ab'[k % 2]}{r.randrange(6)}" for _ in range(4)]) for k in range(n)]
    return spark.createDataFrame([*rows, ("x", ["a0", None, "a1"]), ("y", None), ("z", ["alone"])], "key string, tokens array<string>").repartition(3)


def apart(rows):
    v = {r["word"]: np.array(r["vec"]) for r in rows}
    unit = {w: x / np.linalg.norm(x) for w, x in v.items()}
    same = [unit[f"{g}{i}"] @ unit[f"{g}{j}"] for g in "ab" for i in range(6) for j in range(i)]
    other = [unit[f"a{i}"] @ unit[f"b{j}"] for i in range(6) for j in range(6)]
    return np.mean(same) - np.mean(other)


def test_words_of_a_kind_are_near(spark, monkeypatch):
    for block, iterations in ((100_000, 1), (2_000, 1), (2_000, 3)):
        monkeypatch.setattr(S, "BLOCK", block)
        rows = S.skipgram(corpus(spark), "key", size=16, iterations=iterations, rates=(0.05, 0.0001)).collect()
        assert len(rows) == 13 and all(len(r["vec"]) == 16 and np.isfinite(r["vec"]).all() for r in rows)
        assert apart(rows) > 0.5, (block, iterations, apart(rows))
        alone = next(r for r in rows if r["word"] == "alone")
        assert alone["first"] and np.allclose(alone["vec"], S.first_vectors(["alone"], 16, 7)[0])


def test_pairs_stay_in_their_sentence():
    place = np.array([0, 0, 0, 1, 1, 2])
    w, x = S.pairs(place, 5, np.random.default_rng(1))
    assert (place[w] == place[x]).all() and (w != x).all()
    w, x = S.pairs(np.zeros(3, int), 1, np.random.default_rng(1))
    assert sorted(zip(w.tolist(), x.tolist())) == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_vocabulary_stays_off_the_driver(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    def fit(*_):
        raise AssertionError("the whole vocabulary on the driver")

    monkeypatch.setattr(Word2Vec, "fit", fit)
    got = registry.QUERIES["word2vec_vectors"](spark, "/root/testdata/sf0.001")
    walks = registry.QUERIES["walk_sentences"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("entity", "string"), ("vec", "array<double>")] and got.count() == walks.count() == got.select("entity").distinct().count()
