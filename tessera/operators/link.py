"""The linker: windows, detection, candidates, priors, a collective choice, pruning, and results for every mention."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stored
from . import detect as D
from .windows import windows


#: Groups of documents that the joint choice is made in, one document after the other.
GROUPS = 2_048
#: Words of forms that are sent to the workers, at most.
KNOWN = 200_000


def with_fallback(left: DataFrame, key: str, right: DataFrame, value: str) -> DataFrame:
    """left with right's value (right: key, value): by the key, else by its percent-decoded form, else null."""
    own = right.select(F.col("key").alias("_a"), F.col(value).alias("_va"))
    decoded = right.select(F.col("key").alias("_b"), F.col(value).alias("_vb"))
    plain = F.coalesce(F.try_url_decode(F.col(key)), F.col(key))
    out = left.join(own, F.col(key) == F.col("_a"), "left").join(decoded, plain == F.col("_b"), "left")
    return out.withColumn(value, F.coalesce("_va", "_vb")).drop("_a", "_b", "_va", "_vb")


def with_rank(candidates: DataFrame, ranks: DataFrame) -> DataFrame:
    """candidates with pr: the rank (id, pr) of the entity in lower case, percent-decoded if that has none, else 0.
    Ranks of ids that are equal in lower case are summed."""
    folded = ranks.groupBy(F.lower("id").alias("key")).agg(F.sum("pr").alias("pr"))
    out = with_fallback(candidates.withColumn("_low", F.lower("entity")), "_low", folded, "pr").drop("_low")
    return out.withColumn("pr", F.coalesce("pr", F.lit(0.0)))


def detected(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, offset, text, sf of each window (of one and two segments) whose words of three letters or more, without
    stop words, are a surface form, as they are or in lower case. While the forms are few, windows without any of their
    words are dropped where they are cut: a window's key consists of the words of its form."""
    forms = dictionary.select(F.explode(F.split(F.lower("sf"), " ")).alias("w")).distinct().limit(KNOWN + 1).collect()
    w = windows(docs, "bounded", known=None if len(forms) > KNOWN else [r["w"] for r in forms]).withColumn("key", T.key(F.col("text"))).filter("key <> ''")
    return D.detect(w, dictionary, "key").select("doc_id", "offset", "text", "sf")


def collective(candidates: DataFrame) -> DataFrame:
    """doc_id, entity: the entities that the candidates (doc_id, sf, entity, vec; vec may be null) choose jointly. Every
    candidate votes, with its similarity, for its best partner in each other form and for itself; the best one of each
    form with a positive sum is chosen. A document's candidates are its forms' alone, and are compared in blocks."""

    def choose(forms, entities, vecs):
        size = max((len(v) for v in vecs if v is not None), default=1)
        v = np.array([x if x is not None else np.zeros(size) for x in vecs], float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        new = np.concatenate([[True], forms[1:] != forms[:-1]])
        first, form = np.flatnonzero(new), np.cumsum(new) - 1
        votes = np.zeros(len(v))
        ends = np.concatenate([first[1:], [len(v)]])
        for a in range(0, len(v), 2_000):
            sims = np.abs(v[a : a + 2_000] @ v.T).round(6)
            best = np.maximum.reduceat(sims, first, axis=1)
            best[np.arange(len(sims)), form[a : a + 2_000]] = 0.0
            votes[a : a + 2_000] += best.sum(axis=1)
            for k, (i, j) in enumerate(zip(first, ends)):
                who = np.flatnonzero(form[a : a + 2_000] != k)
                np.add.at(votes, i + np.argmax(sims[who, i:j], axis=1), best[who, k])
        votes = votes.round(6)
        best = [i + int(np.argmax(votes[i:j])) for i, j in zip(first, ends)]
        return [entities[k] for k in best if votes[k] > 0]

    def kernel(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "sf", "entity"])
        doc, forms, entities, vecs = (pdf[c].to_numpy() for c in ("doc_id", "sf", "entity", "vec"))
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        docs, chosen = [], []
        for i, j in zip(starts, [*starts[1:], len(doc)]):
            got = choose(forms[i:j], entities[i:j], vecs[i:j])
            docs += [doc[i]] * len(got)
            chosen += got
        return pd.DataFrame({"doc_id": docs, "entity": pd.Series(chosen, dtype=object)})

    d = candidates.select("doc_id", "sf", "entity", "vec").filter("doc_id is not null")
    return d.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).alias("g")).applyInPandas(kernel, "doc_id long, entity string").distinct()


class Scorer(Protocol):
    """A score of candidates (doc_id, sf, entity, pr) and the weight that it enters the sum with."""

    weight: float

    def score(self, candidates: DataFrame) -> Column: ...


@dataclass(frozen=True)
class RankScorer:
    weight: float = 10.0

    def score(self, candidates: DataFrame) -> Column:
        return F.sqrt("pr")


@dataclass(frozen=True)
class ChosenScorer:
    """1 for entities of the document's joint choice, whichever mention they are a candidate of."""

    weight: float = 20.0

    def score(self, candidates: DataFrame) -> Column:
        return F.col("chosen").cast("double")


def scored(candidates: DataFrame, scorers=(RankScorer(), ChosenScorer())) -> DataFrame:
    """candidates with score, the weighted sum."""
    return candidates.withColumn("score", F.round(sum((F.lit(s.weight) * s.score(candidates) for s in scorers), F.lit(0.0)), 6))


def pruned(choices: DataFrame, theta: float = 1.0, weight: float = 10.0) -> DataFrame:
    return choices.filter(F.col("score") >= weight * theta)


def link(docs: DataFrame, dictionary: DataFrame, ranks: DataFrame, vectors: DataFrame, theta: float = 1.0) -> DataFrame:
    """doc_id, offset, text, sf, entity, score of every mention that is linked. dictionary: sf, entity; ranks: id, pr;
    vectors: key, vec. Each form of a document is scored once, and the result copied to all of its mentions."""
    links = stored(with_rank(dictionary.select("sf", "entity").distinct(), ranks))
    mentions = stored(detected(docs, links))  # read four times below
    missing = mentions.join(D.at_hand(links.select("sf").distinct()), "sf", "left_anti")
    forms = mentions.select("doc_id", "sf").distinct()
    cand = forms.join(D.at_hand(with_fallback(links, "entity", vectors, "vec")), "sf")
    chosen = collective(cand).withColumn("chosen", F.lit(True))
    cand = cand.drop("vec").join(chosen, ["doc_id", "entity"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    best = pruned(D.best(scored(cand).withColumn("rank", F.struct("score", "pr")), ["doc_id", "sf"], "rank", "entity"), theta)
    return mentions.join(best.select("doc_id", "sf", "entity", "score"), ["doc_id", "sf"]).unionByName(missing.select("doc_id", "sf", "offset", "text", F.raise_error(F.concat(F.lit("no candidate for "), "sf")).cast("string").alias("entity"), F.lit(0.0).alias("score")))


def pipeline(*steps):
    """One function of several, each fed with what the one before gave."""

    def run(x):
        for s in steps:
            x = s(x)
        return x

    return run
