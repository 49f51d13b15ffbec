"""Vector operators: similarity, sums, and the pickers that disambiguate all mentions of a document jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """|cosine|; 0 where either vector is missing or has no length."""
    return F.coalesce(F.abs(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))), F.lit(0.0))


def sum_normalised(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), total))


def vector_sum(d: DataFrame, key: str, vec: str) -> DataFrame:
    """key, dim, total: element-wise sums, as rows."""
    return d.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(F.sum(F.col("x").cast("double")).alias("total"))


def clusters(d: DataFrame, k: int) -> DataFrame:
    """doc_id, sf, entity, vec: the first k candidates of each surface form."""
    w = Window.partitionBy("doc_id", "sf").orderBy("entity")
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def pairs(c: DataFrame) -> DataFrame:
    """doc_id, sf, entity, sf2, entity2, sim of candidates of different forms of a document."""
    o = c.select("doc_id", F.col("sf").alias("sf2"), F.col("entity").alias("entity2"), F.col("vec").alias("vec2"))
    return c.join(o, "doc_id").filter("sf <> sf2").select("doc_id", "sf", "entity", "sf2", "entity2", F.round(similarity(F.col("vec"), F.col("vec2")), 6).alias("sim"))


#: How repeated choices of a candidate are folded.
COMBINE = {"occurrence": lambda x: F.count(x).cast("double"), "max": F.max, "add": F.sum, "square": lambda x: F.sum(x * x)}


def pairwise(p: DataFrame, how: str = "add") -> DataFrame:
    """doc_id, sf, entity, score: every candidate votes, with its similarity, for its best partner in each other form
    and for itself; the best candidate of each form with a positive score."""
    w = Window.partitionBy("doc_id", "sf", "entity", "sf2").orderBy(F.desc("sim"), "entity2")
    b = p.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    votes = b.select("doc_id", "sf", "entity", "sim").unionAll(b.select("doc_id", F.col("sf2").alias("sf"), F.col("entity2").alias("entity"), "sim"))
    s = votes.groupBy("doc_id", "sf", "entity").agg(F.round(COMBINE[how](F.col("sim")), 6).alias("score")).filter("score > 0")
    w = Window.partitionBy("doc_id", "sf").orderBy(F.desc("score"), "entity")
    return s.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def sub_pagerank(p: DataFrame, all_: DataFrame, rounds: int = 5, threshold: float = 0.5, normalised: bool = False) -> DataFrame:
    """doc_id, sf, entity, pr on the graph of similar candidates of a document (edges both ways, weight = similarity).
    ``normalised``: strict threshold and (1 - d) / N."""
    e = p.filter(F.col("sim") > threshold if normalised else F.col("sim") >= threshold)
    e = e.join(e.groupBy("doc_id", "entity").agg(F.count("*").alias("out")), ["doc_id", "entity"])
    v = all_.select("doc_id", "sf", "entity").withColumn("base", F.lit(0.15) / F.count("*").over(Window.partitionBy("doc_id")) if normalised else F.lit(0.15))
    e = stored(e.select("doc_id", "entity", "entity2", "sim", "out"))
    pr = v.withColumn("pr", F.lit(0.1))
    for _ in range(rounds):
        got = e.join(pr.select("doc_id", "entity", "pr"), ["doc_id", "entity"]).groupBy("doc_id", F.col("entity2").alias("entity")).agg(F.sum(F.col("sim") * F.col("pr") / F.col("out")).alias("in"))
        pr = v.join(got, ["doc_id", "entity"], "left").select("doc_id", "sf", "entity", "base", (F.col("base") + 0.85 * F.coalesce("in", F.lit(0.0))).alias("pr"))
    return pr.drop("base")


def added(a: Column, b: Column) -> Column:
    """Element-wise sum; a null leaves the other; different lengths are an error."""
    same = F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("array<double>"))
    return F.when(b.isNull(), a.cast("array<double>")).when(a.isNull(), b.cast("array<double>")).otherwise(same)


def combined(d: DataFrame, key: str, vec: str, combine) -> DataFrame:
    """key, combined: what ``combine`` makes of the list of a key's vectors."""
    return d.groupBy(key).agg(F.collect_list(vec).alias("_v")).select(key, combine(F.col("_v")).alias("combined"))


def matrix(d: DataFrame, names: list) -> DataFrame:
    """entity and a column c<name> for each of the named entities: their similarities."""
    o = d.select(F.col("entity").alias("o"), F.col("vec").alias("o_vec"))
    each = [F.max(F.when(F.col("o") == n, F.round(similarity(F.col("vec"), F.col("o_vec")), 6))).alias(f"c{n}") for n in names]
    return d.crossJoin(F.broadcast(o)).groupBy("entity").agg(*each)


def most_similar(d: DataFrame, queries: DataFrame, k: int, block: int = 2_000) -> DataFrame:
    """q, id, sim: the k nearest of all vectors to each query vector (id, vec), itself left out. Queries are taken in
    blocks, each broadcast and multiplied with each batch of vectors; every batch keeps its best k before they meet."""
    spark, out = d.sparkSession, None
    n = queries.count()
    ranges = queries.repartitionByRange(max(1, -(-n // block)), "id").select("id", "vec", F.spark_partition_id().alias("block")).persist()
    for part in range(max(1, -(-n // block))):
        rows = ranges.filter(F.col("block") == part).select("id", "vec").collect()  # a block
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows]), unit(np.array([r["vec"] for r in rows], float))))

        def run(batches, shared=shared):
            import pyarrow as pa

            ids, q = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy()
                sims = np.abs(q @ unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)).T)
                sims[ids[:, None] == own[None]] = -1.0
                top = np.lexsort((np.broadcast_to(own, sims.shape), -sims.round(12)), axis=1)[:, :k]
                x = np.take_along_axis(sims, top, 1)
                keep = x >= 0
                yield pa.RecordBatch.from_pydict({"q": np.repeat(ids, top.shape[1])[keep.ravel()], "id": own[top][keep], "sim": x[keep]})

        best = d.select("id", "vec").mapInArrow(run, "q long, id long, sim double")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "q long, id long, sim double")
    w = Window.partitionBy("q").orderBy(F.desc(F.round("sim", 6)), "id")
    return out.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def abstain(choices: DataFrame, repeats: int = 500, share: float = 0.4) -> DataFrame:
    """Drops choices that less than a share of the restarts ended in."""
    return choices.filter(F.col("score") >= repeats * share)


def strategy(name: str, c: DataFrame, rounds: int = 5, threshold: float = 0.5) -> DataFrame:
    """Ranks of candidates by the named way: map, naive, or optimized (all pairs of forms are edges, the out-degree is
    the number of candidates of other forms)."""
    p = pairs(c)
    if name in ("map", "naive"):
        return sub_pagerank(p, c, rounds, threshold, normalised=name == "naive")
    if name != "optimized":
        raise ValueError(f"no strategy {name!r}")
    return sub_pagerank(p, c, rounds, 0.0)


def hill_climb(c: DataFrame, repeats: int = 500, seed: int = 1337, continuous: bool = False) -> DataFrame:
    """doc_id, sf, entity, score: seeded hill-climbing over one choice for each form of a document.

    Each restart moves a form to the candidate nearest to another chosen one if the sum of similarities doesn't fall;
    how often a candidate ends as the choice is its score. ``continuous``: the form of the weakest choice is dropped
    and the rest climbed again, until one is left. A document with one form has no choice."""

    def climb(vecs: list[np.ndarray], rng) -> np.ndarray:
        unit = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in vecs]
        votes = [np.zeros(len(v)) for v in vecs]
        known: dict[tuple[int, int, int], tuple[list[float], int]] = {}

        def near(i: int, j: int, k: int) -> tuple[list[float], int]:
            """Similarities of form i's candidates to candidate k of form j, and the nearest one."""
            if (found := known.get((i, j, k))) is None:
                sims = np.abs(unit[i] @ unit[j][k])
                found = known[i, j, k] = sims.tolist(), int(np.argmax(sims))
            return found

        for _ in range(repeats):
            pick = [int(rng.integers(len(v))) for v in vecs]
            for _ in range(200):
                old = list(pick)
                for _ in range(max(1, min(20, int(len(vecs) ** 0.5)))):
                    for i in rng.permutation(len(vecs)):
                        j = int((i + 1 + rng.integers(len(vecs) - 1)) % len(vecs))
                        new = near(i, j, pick[j])[1]
                        if new != pick[i]:
                            rest = [near(i, k, pick[k])[0] for k in range(len(vecs)) if k != i]
                            if sum(x[new] for x in rest) >= sum(x[pick[i]] for x in rest):
                                pick[i] = new
                if pick == old:
                    break
            for i, k in enumerate(pick):
                votes[i][k] += 1
        return votes

    def kernel(pdf):
        import pandas as pd

        doc = pdf["doc_id"].iloc[0]
        rng = np.random.default_rng([seed, int(doc) & 0xFFFFFFFF])
        groups = {sf: g.sort_values("entity") for sf, g in pdf.sort_values("sf").groupby("sf")}
        names = sorted(groups)
        ents = {s: groups[s]["entity"].tolist() for s in names}
        vecs = {s: np.array(groups[s]["vec"].tolist(), float) for s in names}
        scores: dict = {}
        left = list(names)
        while len(left) > 1:
            votes = climb([vecs[s] for s in left], rng)
            for s, v in zip(left, votes):
                k = int(np.argmax(v))
                scores[s, ents[s][k]] = scores[s, ents[s][k]] + (len(names) - len(left)) * v[k] if (s, ents[s][k]) in scores else 1.0 if continuous else v[k]
            if not continuous:
                break
            left.remove(min(left, key=lambda s: (votes[left.index(s)].max(), s)))
        best = {}
        for (s, e), x in sorted(scores.items(), key=lambda t: (-t[1], t[0])):
            best.setdefault(s, (e, float(x)))
        return pd.DataFrame([(doc, s, e, x) for s, (e, x) in best.items()], columns=["doc_id", "sf", "entity", "score"])

    return c.groupBy("doc_id").applyInPandas(kernel, "doc_id long, sf long, entity long, score double")
