"""Vector and disambiguation queries: a document is a run of DOC vec_ids, so that their number grows with the table; a
surface form the label, a candidate the vec_id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import embed as E
from ..sources.kg import table
from .registry import query


def _dot(a, b):
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _sim(a, b):
    return f"coalesce(abs({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))), 0)"


DOC = 40
C = f"c AS (SELECT vec_id // {DOC} AS doc_id, CAST(label AS BIGINT) AS sf, vec_id AS entity, embedding AS vec FROM embeddings)"
P = "p AS MATERIALIZED (SELECT a.doc_id AS doc_id, a.sf AS sf, a.entity AS entity, b.sf AS sf2, b.entity AS entity2, round(" + _sim("a.vec", "b.vec") + ", 6) AS sim FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.sf <> b.sf)"


def _clusters(spark, d, forms=1 << 30):
    e = table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / DOC).alias("doc_id"), (F.col("label") % forms).cast("long").alias("sf"), F.col("vec_id").alias("entity"), F.col("embedding").alias("vec"))


@query("cosine_pairs", "WITH " + C + ", " + P + " SELECT doc_id, entity, entity2, sim FROM p WHERE sim >= 0.2")
def cosine_pairs(spark, d):
    return E.pairs(_clusters(spark, d)).filter("sim >= 0.2").select("doc_id", "entity", "entity2", "sim")


@query("vector_sum", "SELECT label, CAST(i - 1 AS INTEGER) AS dim, round(sum(CAST(embedding[i] AS DOUBLE)), 5) AS total FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2")
def vector_sum(spark, d):
    return E.vector_sum(table(spark, d, "embeddings"), "label", "embedding").select("label", "dim", F.round("total", 5).alias("total"))


@query("sum_normalise", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round(CAST(embedding[i] AS DOUBLE) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS x FROM embeddings, range(1, 65) r(i)")
def sum_normalise(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(E.sum_normalised(F.col("embedding"))).alias("dim", "x")).select("vec_id", "dim", F.round("x", 4).alias("x"))


@query("most_similar_topk", "SELECT q, vec_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS r FROM (SELECT a.vec_id AS q, b.vec_id AS vec_id, round(" + _sim("a.embedding", "b.embedding") + ", 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)) WHERE r <= 5")
def most_similar_topk(spark, d):
    """The query set is ids divisible by 100."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return E.most_similar(e, e.filter("id % 100 = 0"), 5).select("q", F.col("id").alias("vec_id"), F.round("sim", 6).alias("sim"))


def _pairwise_sql(fold):
    return "WITH " + C + ", " + P + f", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sf, entity, sf2 ORDER BY sim DESC, entity2) AS r FROM p) WHERE r = 1), votes AS (SELECT doc_id, sf, entity, sim FROM b UNION ALL SELECT doc_id, sf2, entity2, sim FROM b), s AS (SELECT doc_id, sf, entity, round({fold}, 6) AS score FROM votes GROUP BY 1, 2, 3) SELECT doc_id, sf, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sf ORDER BY score DESC, entity) AS r FROM s WHERE score > 0) WHERE r = 1"


for _how, _fold in (("occurrence", "CAST(count(sim) AS DOUBLE)"), ("max", "max(sim)"), ("add", "sum(sim)"), ("square", "sum(sim * sim)")):

    @query(f"pairwise_picker_{_how}", _pairwise_sql(_fold))
    def pairwise_picker(spark, d, how=_how):
        return E.pairwise(E.pairs(_clusters(spark, d)), how)


def _sub_sql(rounds, strict, base):
    ctes = [C, P, f"e AS (SELECT doc_id, entity, entity2, sim FROM p WHERE sim {'>' if strict else '>='} 0.25), o AS (SELECT doc_id, entity, count(*) AS n FROM e GROUP BY 1, 2), v AS (SELECT doc_id, sf, entity, {base} AS base FROM c)", "p0 AS (SELECT doc_id, sf, entity, base, 0.1 AS pr FROM v)"]
    for k in range(rounds):
        ctes.append(f"p{k + 1} AS MATERIALIZED (SELECT v.doc_id AS doc_id, v.sf AS sf, v.entity AS entity, base, base + 0.85 * coalesce(x, 0) AS pr FROM v LEFT JOIN (SELECT e.doc_id AS gd, entity2, sum(sim * pr / n) AS x FROM e JOIN o USING (doc_id, entity) JOIN (SELECT doc_id, entity, pr FROM p{k}) q USING (doc_id, entity) GROUP BY 1, 2) g ON g.gd = v.doc_id AND g.entity2 = v.entity)")
    return f"WITH {', '.join(ctes)} SELECT doc_id, sf, entity, round(pr, 6) AS pr FROM p{rounds}"


@query("sub_pagerank_map", _sub_sql(5, False, "0.15"))
def sub_pagerank_map(spark, d):
    c = _clusters(spark, d)
    return E.sub_pagerank(E.pairs(c), c, threshold=0.25).select("doc_id", "sf", "entity", F.round("pr", 6).alias("pr"))


@query("sub_pagerank_naive", _sub_sql(5, True, "0.15 / count(*) OVER (PARTITION BY doc_id)"))
def sub_pagerank_naive(spark, d):
    c = _clusters(spark, d)
    return E.sub_pagerank(E.pairs(c), c, threshold=0.25, normalised=True).select("doc_id", "sf", "entity", F.round("pr", 6).alias("pr"))


@query("greedy_optimal", "WITH c AS (SELECT doc_id, sf, entity, vec FROM (SELECT vec_id // 40 AS doc_id, label % 3 AS sf, vec_id AS entity, embedding AS vec, row_number() OVER (PARTITION BY vec_id // 40, label % 3 ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 4), t AS (SELECT x.doc_id AS doc_id, x.entity AS e0, y.entity AS e1, z.entity AS e2, round(" + _sim("x.vec", "y.vec") + ", 6) + round(" + _sim("x.vec", "z.vec") + ", 6) + round(" + _sim("y.vec", "z.vec") + ", 6) AS s FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.sf = 0 AND y.sf = 1 JOIN c z ON x.doc_id = z.doc_id AND z.sf = 2) SELECT doc_id, e0, e1, e2, round(s, 5) AS total FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 5) DESC, e0, e1, e2) AS r FROM t) WHERE r = 1")
def greedy_optimal(spark, d):
    """The best of all combinations of the first four candidates of three forms (labels modulo 3): the operator is
    exponential in the forms, and how many candidates of each it takes is its parameter."""
    c = E.clusters(_clusters(spark, d, 3), 4)
    x, y, z = (c.filter(F.col("sf") == k).select("doc_id", F.col("entity").alias(f"e{k}"), F.col("vec").alias(f"v{k}")) for k in range(3))
    sims = [F.round(E.similarity(F.col(a), F.col(b)), 6) for a, b in (("v0", "v1"), ("v0", "v2"), ("v1", "v2"))]
    t = x.join(y, "doc_id").join(z, "doc_id").select("doc_id", "e0", "e1", "e2", F.round(sims[0] + sims[1] + sims[2], 5).alias("total"))
    return t.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("total"), "e0", "e1", "e2"))).filter("r = 1").drop("r")


@query("pr_topk_clusters", "SELECT sf, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY sf ORDER BY n DESC, entity) AS r FROM (SELECT p_name AS sf, p_partkey AS entity, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE r <= 3")
def pr_topk_clusters(spark, d):
    return _priors(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("sf").orderBy(F.desc("n"), "entity"))).filter("r <= 3").drop("r")


def _priors(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("n"))
    return table(spark, d, "part").select(F.col("p_name").alias("sf"), F.col("p_partkey").alias("entity")).join(n, "entity", "left").select("sf", "entity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("score_combine", "WITH pr AS (SELECT p_name AS sf, p_partkey AS entity, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2), b AS (SELECT sf, entity FROM (SELECT *, row_number() OVER (PARTITION BY sf ORDER BY n DESC, entity) AS r FROM pr) WHERE r = 1) SELECT pr.sf AS sf, pr.entity AS entity, round(10 * sqrt(n / 1000.0) + CASE WHEN b.entity IS NULL THEN 0 ELSE 20 END, 6) AS score FROM pr LEFT JOIN b ON pr.sf = b.sf AND pr.entity = b.entity")
def score_combine(spark, d):
    p = _priors(spark, d)
    top = F.row_number().over(Window.partitionBy("sf").orderBy(F.desc("n"), "entity")) == 1
    return p.withColumn("top", top).select("sf", "entity", F.round(10 * F.sqrt(F.col("n") / 1000.0) + F.when(F.col("top"), 20).otherwise(0), 6).alias("score"))


@query("threshold_prune", "SELECT p_partkey AS entity, round(10 * sqrt(count(*) / 20.0), 6) AS score FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING round(10 * sqrt(count(*) / 20.0), 6) >= 10.0")
def threshold_prune(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("n")).join(table(spark, d, "part").select(F.col("p_partkey").alias("entity")), "entity", "left_semi")
    return n.select("entity", F.round(10 * F.sqrt(F.col("n") / 20.0), 6).alias("score")).filter("score >= 10")


@query("hill_climb")
def hill_climb(spark, d):
    return E.hill_climb(_clusters(spark, d))


@query("hill_climb_continuous")
def hill_climb_continuous(spark, d):
    return E.hill_climb(_clusters(spark, d), continuous=True)


@query("hill_climb_abstain")
def hill_climb_abstain(spark, d):
    """Choices that fewer than two fifths of the restarts end in are dropped."""
    return E.abstain(E.hill_climb(_clusters(spark, d)))


@query("sub_pagerank_optimized", f"WITH {C}, {P}, n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1), k AS (SELECT doc_id, sf, count(*) AS k FROM c GROUP BY 1, 2), p0 AS (SELECT doc_id, sf, entity, 0.1 AS pr FROM c), " + ", ".join(f"p{i + 1} AS MATERIALIZED (SELECT c.doc_id AS doc_id, c.sf AS sf, c.entity AS entity, 0.15 + 0.85 * coalesce(x, 0) AS pr FROM c LEFT JOIN (SELECT p.doc_id AS gd, entity2, sum(sim * pr / (n - k)) AS x FROM p JOIN n USING (doc_id) JOIN k USING (doc_id, sf) JOIN (SELECT doc_id, entity, pr FROM p{i}) q USING (doc_id, entity) GROUP BY 1, 2) g ON g.gd = c.doc_id AND g.entity2 = c.entity)" for i in range(5)) + " SELECT doc_id, sf, entity, round(pr, 6) AS pr FROM p5")
def sub_pagerank_optimized(spark, d):
    c = _clusters(spark, d)
    return E.strategy("optimized", c).select("doc_id", "sf", "entity", F.round("pr", 6).alias("pr"))


@query("ssp_score", f"WITH {C}, {P}, a AS (SELECT doc_id, sf, min(entity) AS entity FROM c GROUP BY 1, 2) SELECT p.doc_id AS doc_id, round(20 * sum(sim), 4) AS total FROM p JOIN a x ON x.doc_id = p.doc_id AND x.entity = p.entity JOIN a y ON y.doc_id = p.doc_id AND y.entity = p.entity2 GROUP BY 1")
def ssp_score(spark, d):
    """Twice the similarities of all pairs of assigned entities, here the least candidate of each form."""
    c = _clusters(spark, d)
    assigned = c.join(c.groupBy("doc_id", "sf").agg(F.min("entity").alias("entity")), ["doc_id", "sf", "entity"], "left_semi")
    return E.pairs(assigned).groupBy("doc_id").agg(F.round(20 * F.sum("sim"), 4).alias("total"))


@query("similarity_matrix", "WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 4) SELECT a.vec_id AS vec_id, " + ", ".join(f"max(CASE WHEN b.vec_id = {k} THEN round({_sim('a.embedding', 'b.embedding')}, 6) END) AS c{k}" for k in range(4)) + " FROM e a, e b GROUP BY 1")
def similarity_matrix(spark, d):
    """The named entities' similarities to one another; the list of entities is the operator's parameter."""
    e = table(spark, d, "embeddings").filter("vec_id < 4").select(F.col("vec_id").alias("entity"), F.col("embedding").alias("vec"))
    return E.matrix(e, list(range(4))).withColumnRenamed("entity", "vec_id")


@query("similar_top5", "WITH " + C + ", " + P + " SELECT doc_id, entity, entity2, sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity ORDER BY sim DESC, entity2) AS r FROM p) WHERE r <= 5")
def similar_top5(spark, d):
    w = Window.partitionBy("doc_id", "entity").orderBy(F.desc("sim"), "entity2")
    return E.pairs(_clusters(spark, d)).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("doc_id", "entity", "entity2", "sim")


@query("with_embedding", "SELECT p_partkey AS entity, vec_id IS NOT NULL AS known FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def with_embedding(spark, d):
    """Coverage of entities by vectors; the filter of candidates keeps the known ones."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity"), F.lit(True).alias("known"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity")).join(e, "entity", "left").select("entity", F.coalesce("known", F.lit(False)).alias("known"))


@query("clusters_first_form", "SELECT vec_id // 40 AS doc_id, CAST(label AS BIGINT) AS sf, array_to_string(list_sort(list(vec_id)), ' ') AS entities, count(*) AS n FROM embeddings GROUP BY 1, 2")
def clusters_first_form(spark, d):
    c = _clusters(spark, d).groupBy("doc_id", "sf").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    return c.select("doc_id", "sf", F.array_join(F.col("e").cast("array<string>"), " ").alias("entities"), F.size("e").cast("long").alias("n"))


@query("initial_scores", "SELECT vec_id // 40 AS doc_id, CAST(label AS BIGINT) AS sf, vec_id AS entity, CAST(0.1 AS DOUBLE) AS score FROM embeddings")
def initial_scores(spark, d):
    return _clusters(spark, d).select("doc_id", "sf", "entity", F.lit(0.1).alias("score"))


@query("topk_min_score", "SELECT sf, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY sf ORDER BY n DESC, entity) AS r FROM (SELECT p_name AS sf, p_partkey AS entity, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE r <= 3 AND n >= 30")
def topk_min_score(spark, d):
    w = Window.partitionBy("sf").orderBy(F.desc("n"), "entity")
    return _priors(spark, d).filter("n >= 30").withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@query("best_target", "WITH " + C + ", " + P + " SELECT doc_id, entity, entity2 AS target, sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity ORDER BY sim DESC, entity2) AS r FROM p) WHERE r = 1")
def best_target(spark, d):
    best = F.max_by(F.struct(F.col("entity2"), "sim"), F.struct("sim", -F.col("entity2"))).alias("b")
    return E.pairs(_clusters(spark, d)).groupBy("doc_id", "entity").agg(best).select("doc_id", "entity", F.col("b.entity2").alias("target"), "b.sim")


@query("vector_add", "SELECT a.vec_id AS vec_id, round(CAST(a.embedding[1] AS DOUBLE) + coalesce(CAST(b.embedding[1] AS DOUBLE), 0), 4) AS first, round(CAST(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE))) + coalesce(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 0) AS DOUBLE), 4) AS total FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 400")
def vector_add(spark, d):
    """Element-wise sums with the vector 400 ids on; one that isn't there leaves the other as it is."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 400).alias("vec_id"), F.col("embedding").alias("other"))
    v = E.added(F.col("embedding"), F.col("other"))
    return e.join(o, "vec_id", "left").select("vec_id", F.round(v[0], 4).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("combined_by_function", "SELECT label, round(max(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS greatest FROM embeddings GROUP BY 1")
def combined_by_function(spark, d):
    """A combiner of a group's vectors given as a function of columns (here: the vector of the greatest sum)."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return E.combined(table(spark, d, "embeddings"), "label", "embedding", lambda vs: F.array_max(F.transform(vs, total))).select("label", F.round("combined", 4).alias("greatest"))
