"""Walks over the catalog graph, their samples and sentences, and embeddings of what they meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bgp
from ..operators import walks as W
from ..operators.skipgram import skipgram
from ..sources.kg import catalog, catalog_sql
from .registry import query

SKIP = ("contains", "suppliedBy", "by")
KG = f"WITH kg AS (SELECT s, p, o, o_kind FROM ({catalog_sql()}) WHERE p NOT IN ('contains', 'suppliedBy', 'by'))"
SQL = {
    1: "SELECT a.s AS entity, a.s || '->' || a.p || '->' || a.o AS walk FROM kg a WHERE a.o_kind <> 'literal'",
    2: "SELECT a.s AS entity, a.s || '->' || a.p || '->' || a.o || '->' || b.p || '->' || b.o AS walk FROM kg a JOIN kg b ON a.o = b.s WHERE b.o_kind <> 'literal'",
    3: "SELECT a.s AS entity, a.s || '->' || a.p || '->' || a.o || '->' || b.p || '->' || b.o || '->' || c.p || '->' || c.o AS walk FROM kg a JOIN kg b ON a.o = b.s JOIN kg c ON b.o = c.s WHERE c.o_kind <> 'literal'",
}


def walks(spark, d, depth: int):
    c = bgp.chain(catalog(spark, d), depth, SKIP)
    return c.select(F.col("s").alias("entity"), F.concat_ws("->", *c.columns).alias("walk"))


for _k in SQL:

    @query(f"walks_depth{_k}", f"{KG} {SQL[_k]}")
    def walks_depth(spark, d, k=_k):
        return walks(spark, d, k)


ALL = f"{KG}, w AS ({SQL[1]} UNION ALL {SQL[2]})"


def _all(spark, d):
    return walks(spark, d, 1).unionByName(walks(spark, d, 2))


HASH = "CAST('0x' || left(md5('7' || walk), 6) AS BIGINT)"


def _sample_sql(source: str, percent: str, by: str, least: int, most: int) -> str:
    """Statements of the sampling rule over ``source``: drawn ones first, filled up to ``least``, cut after ``most``."""
    drawn = f"SELECT *, {HASH} % 100 > {percent} AS missed FROM {source}"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY missed, md5('7' || walk), walk) AS r FROM ({drawn})"
    return f"SELECT * FROM ({ranked}) WHERE (NOT missed OR r <= {least}) AND r <= {most}"


@query("walk_sample", f"{ALL} SELECT entity, walk FROM ({_sample_sql('w', '30', 'entity', 1, 1000)})")
def walk_sample(spark, d):
    """A share of each entity's walks by a hash, one at least and 1,000 at most: sampling is the operator."""
    return W.sampled(_all(spark, d).withColumn("depth", F.lit(1)), (0.3,), 1).select("entity", "walk")


def _grown_sql(depth: int) -> str:
    """All walks over all predicates to a depth, ``w(entity, depth, walk, e)``."""
    return f"""WITH RECURSIVE kg AS MATERIALIZED (SELECT s, p, o FROM ({catalog_sql()}) WHERE o_kind <> 'literal'),
    w AS (SELECT s AS entity, 1 AS depth, s || '->' || p || '->' || o AS walk, o AS e FROM kg
    UNION ALL SELECT w.entity, w.depth + 1, w.walk || '->' || kg.p || '->' || kg.o, kg.o FROM w JOIN kg ON w.e = kg.s WHERE w.depth < {depth})"""


DIGEST = "SELECT entity, depth, count(*) AS n_walks, md5(string_agg(walk, ' ' ORDER BY walk)) AS walks_md5 FROM"
PERCENT = "(CASE depth WHEN 1 THEN 100 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 2 END)"


@query("walks_decreasing", f"{_grown_sql(6)} {DIGEST} ({_sample_sql('w', PERCENT, 'entity, depth', 50, 1000)}) GROUP BY 1, 2")
def walks_decreasing(spark, d):
    """Walks of one to six statements over every predicate, with a share that falls with the depth."""
    return W.digests(catalog(spark, d), {k: (p, 50, 1_000) for k, p in enumerate((100, 10, 5, 2, 2, 2), 1)})


DIRECT = f"SELECT s AS entity, 0 AS depth, s || '->' || p || '->' || o AS walk FROM ({catalog_sql()}) WHERE o_kind <> 'literal'"


@query("walks_random", f"""{_grown_sql(3)}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, depth ORDER BY md5('7' || walk), walk) AS r FROM w WHERE depth = 3)
    {DIGEST} (SELECT entity, depth, walk FROM r WHERE r <= 20 UNION ALL {DIRECT}) GROUP BY 1, 2""")
def walks_random(spark, d):
    """Twenty walks of three statements by chance for each entity, and its direct properties that are nodes as depth 0."""
    return W.digests(catalog(spark, d), {0: None, 3: (-1, 20, 20)})


@query("walk_sentences", f"{ALL} SELECT entity, string_agg(walk, ' ' ORDER BY walk) AS sentence FROM w GROUP BY 1")
def walk_sentences(spark, d):
    return _all(spark, d).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("walk")), " ").alias("sentence"))


@query("walk_clean", f"{ALL} SELECT DISTINCT entity, replace(CASE WHEN regexp_matches(walk, '->(rdf:type)->[^>]*$') THEN regexp_replace(walk, '->rdf:type->[^>]*$', '') ELSE walk END, '->', ' ') AS walk FROM w")
def walk_clean(spark, d):
    return _all(spark, d).select("entity", F.replace(F.regexp_replace("walk", "->rdf:type->[^>]*$", ""), F.lit("->"), F.lit(" ")).alias("walk")).distinct()


@query("walk_namespaces", f"{KG} SELECT entity, replace(replace(walk, 'nation:', 'n:'), 'cls:', 'c:') AS walk FROM ({SQL[1]})")
def walk_namespaces(spark, d):
    return walks(spark, d, 1).select("entity", reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("nation:", "n:"), ("cls:", "c:")), F.col("walk")).alias("walk"))


@query("id_map", f"{KG} SELECT tok, CAST(dense_rank() OVER (ORDER BY tok) AS INTEGER) AS id FROM (SELECT DISTINCT p AS tok FROM kg)")
def id_map(spark, d):
    return catalog(spark, d).filter(~F.col("p").isin(*SKIP)).select(F.col("p").alias("tok")).distinct().withColumn("id", F.dense_rank().over(Window.orderBy("tok")))


@query("word2vec_vectors")
def word2vec_vectors(spark, d):
    """entity, vec: skip-gram vectors of the entities that walks begin with."""
    s = _all(spark, d).select("entity", F.split("walk", "->").alias("tokens"))
    v = skipgram(s, "entity", size=16, window=5, iterations=1, seed=7)
    return v.filter("first").select(F.col("word").alias("entity"), "vec")
