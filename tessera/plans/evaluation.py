"""Evaluation, exports and their reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.kg import anchors, anchors_sql, table
from .registry import query

#: Gold: the links of a page. Predicted: every anchor word of three letters or more is linked to its lower-case path.
GOLD = f"gold AS (SELECT DISTINCT page_id AS doc_id, anchor AS mention, href AS uri FROM ({anchors_sql()})), pred AS (SELECT DISTINCT page_id AS doc_id, anchor AS mention, '/' || lower(anchor) AS uri FROM ({anchors_sql()}) WHERE length(anchor) > 2)"
PRF = f"WITH {GOLD}, f AS (SELECT doc_id, count(g) FILTER (WHERE p IS NOT NULL) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM (SELECT doc_id, mention, uri, max(g) AS g, max(p) AS p FROM (SELECT *, 1 AS g, NULL AS p FROM gold UNION ALL SELECT *, NULL, 1 FROM pred) GROUP BY 1, 2, 3) GROUP BY 1), m AS (SELECT doc_id, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS re FROM f)"


def _prf(spark, d):
    a = anchors(spark, d)
    gold = a.select(F.col("page_id").alias("doc_id"), F.col("anchor").alias("mention"), F.col("href").alias("uri")).distinct().withColumn("g", F.lit(1))
    pred = a.filter(F.length("anchor") > 2).select(F.col("page_id").alias("doc_id"), F.col("anchor").alias("mention"), F.concat(F.lit("/"), F.lower("anchor")).alias("uri")).distinct().withColumn("p", F.lit(1))
    both = gold.unionByName(pred, allowMissingColumns=True).groupBy("doc_id", "mention", "uri").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    f = both.groupBy("doc_id").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    pr, re = (F.coalesce(F.try_divide("tp", F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    return f.select("doc_id", "tp", "fp", "fn", pr.alias("pr"), re.alias("re"))


def _f1(p="pr", r="re"):
    return F.coalesce(F.try_divide(2 * F.col(p) * F.col(r), F.col(p) + F.col(r)), F.lit(0.0))


@query("eval_prf_doc", PRF + " SELECT doc_id, tp, fp, fn, round(pr, 6) AS pr, round(re, 6) AS re, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM m")
def eval_prf_doc(spark, d):
    return _prf(spark, d).select("doc_id", "tp", "fp", "fn", F.round("pr", 6).alias("pr"), F.round("re", 6).alias("re"), F.round(_f1(), 6).alias("f1"))


@query("eval_macro", PRF + " SELECT round(avg(pr), 6) AS pr, round(avg(re), 6) AS re, round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS f1 FROM m")
def eval_macro(spark, d):
    return _prf(spark, d).agg(F.round(F.avg("pr"), 6).alias("pr"), F.round(F.avg("re"), 6).alias("re"), F.round(F.avg(_f1()), 6).alias("f1"))


@query("eval_macro_filtered", PRF + " SELECT round(avg(pr), 6) AS pr, round(avg(re), 6) AS re FROM m WHERE floor(100 * pr) > 0 OR floor(100 * re) > 0")
def eval_macro_filtered(spark, d):
    return _prf(spark, d).filter("floor(100 * pr) > 0 or floor(100 * re) > 0").agg(F.round(F.avg("pr"), 6).alias("pr"), F.round(F.avg("re"), 6).alias("re"))


@query("eval_micro", PRF + ", s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM m) SELECT round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS pr, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS re FROM s")
def eval_micro(spark, d):
    s = _prf(spark, d).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return s.select(*[F.round(F.coalesce(F.try_divide("tp", F.col("tp") + F.col(x)), F.lit(0.0)), 6).alias(n) for x, n in (("fp", "pr"), ("fn", "re"))])


RUNS = "r AS (SELECT lang AS dataset, source AS system, avg(quality) AS f1 FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)"


def _runs(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy(F.col("lang").alias("dataset"), F.col("source").alias("system")).agg(F.avg("quality").alias("f1"))


@query("best_run", f"WITH {RUNS} SELECT dataset, system, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, system) AS k FROM r) WHERE k = 1")
def best_run(spark, d):
    return _runs(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("f1"), "system"))).filter("k = 1").select("dataset", "system", F.round("f1", 6).alias("f1"))


@query("best_run_pivot", f"WITH {RUNS} SELECT system, round(max(f1) FILTER (WHERE dataset = 'de'), 6) AS de, round(max(f1) FILTER (WHERE dataset = 'en'), 6) AS en, round(max(f1) FILTER (WHERE dataset = 'es'), 6) AS es, round(max(f1) FILTER (WHERE dataset = 'fr'), 6) AS fr FROM r GROUP BY 1")
def best_run_pivot(spark, d):
    return _runs(spark, d).groupBy("system").pivot("dataset", ["de", "en", "es", "fr"]).agg(F.round(F.max("f1"), 6))


@query("nif_triples", "SELECT 'urn:doc:' || doc_id || '#char=0,' || length(text) AS s, p, CASE p WHEN 'nif:beginIndex' THEN '0' WHEN 'nif:endIndex' THEN CAST(length(text) AS VARCHAR) ELSE text END AS o FROM documents, (VALUES ('nif:beginIndex'), ('nif:endIndex'), ('nif:isString')) v(p)")
def nif_triples(spark, d):
    n = F.length("text").cast("string")
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in (("nif:beginIndex", F.lit("0")), ("nif:endIndex", n), ("nif:isString", F.col("text")))])
    return table(spark, d, "documents").select(F.concat(F.lit("urn:doc:"), "doc_id", F.lit("#char=0,"), n).alias("s"), F.explode(rows).alias("x")).select("s", "x.p", "x.o")


@query("mentions_tsv", f"SELECT page_id || chr(9) || anchor || chr(9) || (strpos(html, anchor) - 1) || chr(9) || (strpos(html, anchor) - 1 + length(anchor)) || chr(9) || href AS line FROM (SELECT DISTINCT page_id, anchor, href FROM ({anchors_sql()})) JOIN pages USING (page_id)")
def mentions_tsv(spark, d):
    a = anchors(spark, d).select("page_id", "anchor", "href").distinct().join(table(spark, d, "pages").select("page_id", "html"), "page_id")
    at = F.expr("locate(anchor, html)") - 1
    return a.select(F.concat_ws("\t", "page_id", "anchor", at, at + F.length("anchor"), "href").alias("line"))


@query("section_split", "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM conversations")
def section_split(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn")).alias("section"))


@query("set_overlap", f"WITH l AS ({anchors_sql()}), h AS (SELECT page_id, list(DISTINCT href) AS u FROM l GROUP BY 1) SELECT page_id, list_has_any(u, ['/the', '/de', '/que']) AS hit FROM h")
def set_overlap(spark, d):
    u = anchors(spark, d).groupBy("page_id").agg(F.collect_set("href").alias("u"))
    return u.select("page_id", F.arrays_overlap("u", F.array(*map(F.lit, ("/the", "/de", "/que")))).alias("hit"))


@query("json_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_decode(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("news_filter", f"SELECT DISTINCT page_id FROM ({anchors_sql()}) WHERE href IN (SELECT '/' || lower(anchor) FROM ({anchors_sql()}))")
def news_filter(spark, d):
    a = anchors(spark, d)
    known = a.select(F.concat(F.lit("/"), F.lower("anchor")).alias("href")).distinct()
    return a.join(known, "href", "left_semi").select("page_id").distinct()
