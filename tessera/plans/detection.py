"""Dictionary, detection and linking queries, the flagship among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect as D
from ..sources.kg import anchors, anchors_sql, table
from .registry import query
from .texts import RX

STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
SF = f"WITH links AS ({anchors_sql()}), sf AS (SELECT anchor AS sf, href AS entity, count(*) AS n FROM links WHERE length(anchor) > 1 AND length(anchor) < 50 AND anchor NOT IN ({STOP}) AND NOT contains(href, 'List') AND NOT contains(href, 'Category:') GROUP BY 1, 2), tok AS (SELECT doc_id, t AS token, count(*) AS mentions FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RX}')) AS t FROM documents) WHERE length(t) > 2 GROUP BY 1, 2) "


def _dictionary(spark, d) -> DataFrame:
    return D.dictionary(anchors(spark, d).select(F.col("anchor").alias("sf"), F.col("href").alias("entity")))


@query("link_documents", SF + "SELECT doc_id, sf, mentions, entity, score FROM (SELECT doc_id, sf, mentions, entity, n, round(10 * sqrt(n), 6) AS score, row_number() OVER (PARTITION BY doc_id, sf ORDER BY n DESC, entity) AS r FROM tok JOIN sf ON token = sf) WHERE r = 1 AND score >= 14")
def link_documents(spark, d):
    """Detects surface forms in documents and links each to its candidate of the greatest prior (its number of links),
    if that has two links. The best candidate of a form doesn't depend on the document, so it is chosen before the join."""
    chosen = D.best(_dictionary(spark, d), ["sf"], "n", "entity").select("sf", "entity", F.round(10 * F.sqrt("n"), 6).alias("score")).filter("score >= 14")
    return D.found(table(spark, d, "documents"), chosen).select("doc_id", "sf", "mentions", "entity", "score")


@query("sf_dictionary", SF + "SELECT sf, entity, n FROM sf")
def sf_dictionary(spark, d):
    return _dictionary(spark, d)


@query("sf_sets", "SELECT p_name AS sf, count(DISTINCT p_partkey) AS entities, min(p_partkey) AS least FROM part GROUP BY 1")
def sf_sets(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("sf")).agg(F.countDistinct("p_partkey").alias("entities"), F.min("p_partkey").alias("least"))


@query("ambiguity_report", SF + "SELECT lower(sf) AS k, count(DISTINCT entity) AS entities FROM sf GROUP BY 1 HAVING count(DISTINCT entity) > 1")
def ambiguity_report(spark, d):
    return _dictionary(spark, d).groupBy(F.lower("sf").alias("k")).agg(F.countDistinct("entity").alias("entities")).filter("entities > 1")


@query("detect_exact", SF + "SELECT doc_id, token AS sf, mentions FROM tok WHERE token IN (SELECT sf FROM sf)")
def detect_exact(spark, d):
    return D.found(table(spark, d, "documents"), _dictionary(spark, d).select("sf").distinct()).select("doc_id", "sf", "mentions")


@query("detect_casefold", SF + "SELECT doc_id, token, mentions, token AS sf, 1 AS stage FROM tok WHERE token IN (SELECT sf FROM sf) UNION ALL SELECT doc_id, token, mentions, f.sf AS sf, 2 AS stage FROM tok JOIN (SELECT lower(sf) AS k, min(sf) AS sf FROM sf GROUP BY 1) f ON lower(token) = f.k WHERE token NOT IN (SELECT sf FROM sf)")
def detect_casefold(spark, d):
    hits = D.detect(D.words(table(spark, d, "documents")), _dictionary(spark, d))
    return hits.groupBy("doc_id", "token", "sf", "stage").agg(F.count("*").alias("mentions"))


@query("capital_filter", SF + "SELECT doc_id, token FROM tok WHERE regexp_matches(token, '^\\p{Lu}')")
def capital_filter(spark, d):
    return D.words(table(spark, d, "documents")).filter(F.col("token").rlike(r"^\p{Lu}")).distinct()


@query("candidates", SF + "SELECT token AS sf, entity, n, count(*) AS documents FROM tok JOIN sf ON token = sf GROUP BY 1, 2, 3")
def candidates(spark, d):
    t = D.tokens(table(spark, d, "documents")).groupBy(F.col("token").alias("sf")).agg(F.count("*").alias("documents"))
    return t.join(_dictionary(spark, d), "sf").select("sf", "entity", "n", "documents")


@query("missing_candidates", SF + "SELECT count(*) AS n FROM tok WHERE token NOT IN (SELECT sf FROM sf)")
def missing_candidates(spark, d):
    t = D.tokens(table(spark, d, "documents"))
    return t.join(_dictionary(spark, d).select(F.col("sf").alias("token")), "token", "left_anti").agg(F.count("*").alias("n"))


#: Spans over lineitem as if a document were an order and a mention a part: start and length from its numbers.
SPANS = "SELECT l_orderkey AS doc_id, CAST(l_partkey % 100 AS BIGINT) AS start, CAST(l_quantity AS BIGINT) % 17 + 1 AS length FROM lineitem GROUP BY 1, 2, 3"


def _spans(spark, d):
    q = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 100).cast("long").alias("start"), (q % 17 + 1).alias("length")).distinct()


@query("overlap_removal", f"WITH m AS ({SPANS}) SELECT doc_id, start, length FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.start <= m.start + m.length AND m.start <= o.start + o.length AND (o.length > m.length OR (o.length = m.length AND o.start > m.start)))")
def overlap_removal(spark, d):
    return D.without_overlaps(_spans(spark, d))


#: Spans of up to 5,000 characters, of orders' lines.
LONG = "SELECT l_orderkey AS doc_id, CAST(l_partkey * 37 % 20000 AS BIGINT) AS start, CAST(floor(l_extendedprice) AS BIGINT) % 5000 + 1 AS length, 'f' || l_partkey % 3 AS sf FROM lineitem GROUP BY 1, 2, 3, 4"


@query("overlap_removal_long", f"WITH m AS ({LONG}) SELECT doc_id, start, length, sf FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.doc_id = m.doc_id AND o.start <= m.start + m.length AND m.start <= o.start + o.length AND CASE WHEN o.sf = m.sf THEN o.start < m.start ELSE o.length > m.length OR (o.length = m.length AND o.start > m.start) END)")
def overlap_removal_long(spark, d):
    x = table(spark, d, "lineitem")
    m = x.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 37 % 20000).cast("long").alias("start"), (F.floor("l_extendedprice").cast("long") % 5000 + 1).alias("length"), F.concat(F.lit("f"), F.col("l_partkey") % 3).alias("sf"))
    return D.without_overlaps(m.distinct(), 1024)


@query("restrict_spans", f"WITH m AS ({SPANS}), gold AS (SELECT l_orderkey AS doc_id, CAST(l_partkey % 100 AS BIGINT) AS start, CAST(l_quantity AS BIGINT) % 17 + 1 AS length FROM lineitem WHERE l_returnflag = 'R') SELECT doc_id, start, length FROM m WHERE (doc_id, start, length) IN (SELECT * FROM gold)")
def restrict_spans(spark, d):
    """Mentions that are gold spans: those of returned lines."""
    m = _spans(spark, d)
    gold = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 100).cast("long").alias("start"), (F.col("l_quantity").cast("long") % 17 + 1).alias("length"))
    return m.join(gold, ["doc_id", "start", "length"], "left_semi")


@query("containment_filter", SF + ", f AS (SELECT DISTINCT sf FROM sf) SELECT sf FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.sf <> f.sf AND contains(o.sf, f.sf))")
def containment_filter(spark, d):
    """Every substring of a longer form is looked up, so no pairs of forms are formed."""
    f = _dictionary(spark, d).select("sf").distinct()
    n = F.length("sf")
    starts = f.select("sf", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    subs = starts.select("sf", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("i") + 1), lambda k: F.substring(F.col("sf"), F.col("i"), k))).alias("sub"))
    inner = subs.filter("sub <> sf").select(F.col("sub").alias("sf")).distinct()
    return f.join(inner, "sf", "left_anti")


@query("mentions_sorted", f"WITH m AS ({SPANS}) SELECT doc_id, start, length, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, length) AS INTEGER) AS r FROM m")
def mentions_sorted(spark, d):
    from pyspark.sql import Window

    return _spans(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "length")))


#: Noisy names of parts, by the key: shortened, in capitals, or with an s.
NOISY = "CASE p_partkey % 4 WHEN 0 THEN left(p_name, length(p_name) - 1) WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || 's' ELSE p_name END"
GRAMS = f"WITH q AS (SELECT DISTINCT {NOISY} AS q FROM part), s AS (SELECT DISTINCT p_name AS sf FROM part), qg0 AS (SELECT DISTINCT q, substring('$$' || lower(q) || '$$', i, 3) AS g FROM q, range(1, 200) r(i) WHERE i <= length(q) + 2), sg AS (SELECT DISTINCT sf, substring('$$' || lower(sf) || '$$', i, 3) AS g FROM s, range(1, 200) r(i) WHERE i <= length(sf) + 2), qg AS (SELECT * FROM qg0 WHERE g IN (SELECT g FROM sg)), nq AS (SELECT q, count(*) AS nq FROM qg GROUP BY 1), ns AS (SELECT sf, count(*) AS nf FROM sg GROUP BY 1), j AS (SELECT q, sf, round(k / (nq + nf - k), 6) AS jaccard FROM (SELECT q, sf, count(*) AS k FROM qg JOIN sg USING (g) GROUP BY 1, 2) JOIN nq USING (q) JOIN ns USING (sf)) "


def _noisy(spark, d):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    noisy = F.when(k == 0, F.expr("left(p_name, length(p_name) - 1)")).when(k == 1, F.upper(name)).when(k == 2, F.concat(name, F.lit("s"))).otherwise(name)
    p = table(spark, d, "part")
    return p.select(noisy.alias("q")), p.select(F.col("p_name").alias("sf"))


@query("ngram_jaccard_join", GRAMS + "SELECT * FROM j WHERE jaccard >= 0.5")
def ngram_jaccard_join(spark, d):
    return D.trigram_jaccard(*_noisy(spark, d), 0.5)


@query("fuzzy_detect", GRAMS + "SELECT q, sf, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY jaccard DESC, sf) AS r FROM j WHERE jaccard >= 0.7) WHERE r = 1")
def fuzzy_detect(spark, d):
    return D.best(D.trigram_jaccard(*_noisy(spark, d), 0.7), ["q"], "jaccard", "sf")


@query("lsh_band_join")
def lsh_band_join(spark, d):
    """Pairs that share a band of minhashes: of those of ``ngram_jaccard_join`` at 0.7 the most, and none beside them."""
    return D.lsh_join(*_noisy(spark, d), 0.7)


@query("lsh_collisions")
def lsh_collisions(spark, d):
    return D.collisions(*_noisy(spark, d), 0.7)


@query("lsh_tuning")
def lsh_tuning(spark, d):
    """A grid of bands and rows, where the source's has bands and buckets: rows decide how likely a bucket is shared."""
    return D.tuning(*_noisy(spark, d), 0.7, ((10, 2), (20, 2), (20, 3)))


@query("lsh_index")
def lsh_index(spark, d):
    """sf, band, bucket: what a table of the index holds."""
    return D.lsh_bands(_noisy(spark, d)[1], "sf")


@query("dictionary_rekeyed", SF + f", l AS (SELECT DISTINCT p_name AS sf, 'part:' || p_partkey AS entity FROM part UNION SELECT DISTINCT 'the ' || p_name, 'the:' || p_partkey FROM part WHERE p_partkey % 7 = 0), k AS (SELECT sf, entity, array_to_string(list_filter(list_filter(regexp_extract_all(sf, '{RX}'), lambda t: length(t) > 2), lambda t: NOT list_contains([{STOP}], t) AND NOT list_contains([{STOP}], lower(t))), ' ') AS k FROM l) SELECT sf, entity FROM l UNION SELECT k, entity FROM k WHERE k <> sf AND k IN (SELECT sf FROM l)")
def dictionary_rekeyed(spark, d):
    p = table(spark, d, "part")
    links = p.select(F.col("p_name").alias("sf"), F.concat(F.lit("part:"), "p_partkey").alias("entity")).union(p.filter("p_partkey % 7 = 0").select(F.concat(F.lit("the "), "p_name"), F.concat(F.lit("the:"), "p_partkey")))
    return D.rekeyed(links.distinct())


@query("longer_collisions", f"WITH m AS ({SPANS}), o AS (SELECT *, 'f' || (start % 5) AS sf, repeat('x', CAST(length AS BIGINT)) AS original FROM m), e AS (SELECT doc_id, sf, original, 0 AS k, start AS edge FROM o UNION ALL SELECT doc_id, sf, original, 1, start + length FROM o), bad AS (SELECT DISTINCT original FROM (SELECT original, min(length(original)) OVER (PARTITION BY doc_id, sf, k, edge) AS least FROM e) WHERE length(original) > least) SELECT doc_id, start, length FROM o WHERE original NOT IN (SELECT original FROM bad)")
def longer_collisions(spark, d):
    m = _spans(spark, d).withColumns({"sf": F.concat(F.lit("f"), F.col("start") % 5), "original": F.expr("repeat('x', int(length))")})
    return D.without_longer_collisions(m).select("doc_id", "start", "length")
