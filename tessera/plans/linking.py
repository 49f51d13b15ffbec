"""The full linker and its joins, and the preparation and filtering of surface forms, mentions and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import graph as G
from ..operators import link as L
from ..sources.kg import anchors, anchors_sql, table
from .detection import STOP, _dictionary
from .registry import query
from .texts import RX, segments_sql

ROUNDS = 10
LINKS = f"links AS MATERIALIZED ({anchors_sql()}), sf AS MATERIALIZED (SELECT DISTINCT anchor AS sf, href AS entity FROM links WHERE length(anchor) > 1 AND length(anchor) < 50 AND anchor NOT IN ({STOP}) AND NOT contains(href, 'List') AND NOT contains(href, 'Category:'))"
RANKS = (
    "e AS MATERIALIZED (SELECT url AS src, href AS dst FROM links), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS o FROM e GROUP BY 1), r0 AS (SELECT id, CAST(0.1 AS DOUBLE) AS pr FROM v), "
    + ", ".join(f"r{k + 1} AS MATERIALIZED (SELECT v.id AS id, 0.15 + 0.85 * coalesce(x, 0) AS pr FROM v LEFT JOIN (SELECT dst, sum(pr / o) AS x FROM e JOIN o USING (src) JOIN r{k} ON e.src = r{k}.id GROUP BY 1) g ON v.id = g.dst)" for k in range(ROUNDS))
    + f", low AS (SELECT lower(id) AS id, sum(pr) AS pr FROM r{ROUNDS} GROUP BY 1), cand AS MATERIALIZED (SELECT sf, entity, coalesce(a.pr, b.pr, 0) AS pr FROM sf LEFT JOIN low a ON a.id = lower(entity) LEFT JOIN low b ON b.id = url_decode(lower(entity)))"
)
KEY = f"array_to_string(list_filter(list_filter(regexp_extract_all(text, '{RX}'), lambda t: length(t) > 2), lambda t: NOT list_contains([{STOP}], t) AND NOT list_contains([{STOP}], lower(t))), ' ')"
#: An entity's vector is the one whose number its name's md5 gives.
VECTOR = "CAST('0x' || left(md5(entity), 6) AS BIGINT) % (SELECT count(*) FROM embeddings)"


def ranks(spark, d) -> DataFrame:
    a = anchors(spark, d).select(F.col("url").alias("src"), F.col("href").alias("dst"))
    return G.pagerank(a, ROUNDS)


def vectors(spark, d, entities: DataFrame) -> DataFrame:
    """key, vec of entities."""
    e = table(spark, d, "embeddings")
    number = F.conv(F.substring(F.md5(F.col("entity").cast("binary")), 1, 6), 16, 10).cast("long") % F.lit(e.count())
    return entities.select("entity").distinct().withColumn("vec_id", number).join(e, "vec_id").select(F.col("entity").alias("key"), F.col("embedding").alias("vec"))


DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
LINK_SQL = (
    f"WITH {LINKS}, {RANKS}, {segments_sql()}, k AS MATERIALIZED (SELECT doc_id, \"offset\", text, {KEY} AS key FROM win), "
    "low_sf AS (SELECT lower(sf) AS f, min(sf) AS sf FROM sf GROUP BY 1), m AS MATERIALIZED (SELECT doc_id, \"offset\", text, coalesce(a.sf, b.sf) AS sf FROM k LEFT JOIN (SELECT DISTINCT sf FROM sf) a ON a.sf = k.key LEFT JOIN low_sf b ON b.f = lower(k.key) WHERE key <> '' AND coalesce(a.sf, b.sf) IS NOT NULL), "
    f"ent AS MATERIALIZED (SELECT entity, embedding AS vec FROM (SELECT DISTINCT entity FROM cand) JOIN embeddings ON vec_id = {VECTOR}), "
    f"sim AS MATERIALIZED (SELECT a.entity AS e1, b.entity AS e2, round(abs({DOT.format('a.vec', 'b.vec')} / (sqrt({DOT.format('a.vec', 'a.vec')}) * sqrt({DOT.format('b.vec', 'b.vec')}))), 6) AS sim FROM ent a, ent b), "
    "c AS MATERIALIZED (SELECT doc_id, f.sf AS sf, entity, pr FROM (SELECT DISTINCT doc_id, sf FROM m) f JOIN cand ON cand.sf = f.sf), "
    "p AS (SELECT x.doc_id AS doc_id, x.sf AS sf, x.entity AS entity, y.sf AS sf2, y.entity AS entity2, sim FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.sf <> y.sf JOIN sim ON e1 = x.entity AND e2 = y.entity), "
    "b AS MATERIALIZED (SELECT doc_id, sf, entity, sf2, max(sim) AS sim, arg_max(entity2, (sim, -rk)) AS entity2 FROM (SELECT p.*, n.rk AS rk FROM p JOIN (SELECT entity, row_number() OVER (ORDER BY entity) AS rk FROM ent) n ON n.entity = p.entity2) GROUP BY 1, 2, 3, 4), "
    "votes AS (SELECT doc_id, sf, entity, sim FROM b UNION ALL SELECT doc_id, sf2, entity2, sim FROM b), s AS (SELECT doc_id, sf, entity, round(sum(sim), 6) AS score FROM votes GROUP BY 1, 2, 3), "
    "ch AS (SELECT DISTINCT doc_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sf ORDER BY score DESC, entity) AS r FROM s WHERE score > 0) WHERE r = 1), "
    "t AS (SELECT c.doc_id AS doc_id, sf, c.entity AS entity, pr, round(10 * sqrt(pr) + CASE WHEN ch.entity IS NULL THEN 0 ELSE 20 END, 6) AS score FROM c LEFT JOIN ch ON ch.doc_id = c.doc_id AND ch.entity = c.entity), "
    "best AS (SELECT doc_id, sf, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sf ORDER BY score DESC, pr DESC, entity) AS r FROM t) WHERE r = 1 AND score >= 10) "
    "SELECT m.doc_id AS doc_id, \"offset\", text, m.sf AS sf, entity, score FROM m JOIN best ON best.doc_id = m.doc_id AND best.sf = m.sf"
)


@query("link_full", LINK_SQL)
def link_full(spark, d):
    """Every mention of every document, linked over the web graph: windows of two segments, exact and folded forms,
    ranks of entities, the pairwise joint choice, pruning at 10 points."""
    dictionary = _dictionary(spark, d).select("sf", "entity")
    return L.link(table(spark, d, "documents"), dictionary, ranks(spark, d), vectors(spark, d, dictionary))


@query("rank_join", f"WITH {LINKS}, {RANKS} SELECT sf, entity, round(pr, 6) AS pr FROM cand")
def rank_join(spark, d):
    return L.with_rank(_dictionary(spark, d).select("sf", "entity"), ranks(spark, d)).select("sf", "entity", F.round("pr", 6).alias("pr"))


@query("vector_join", f"WITH {LINKS}, keys AS (SELECT DISTINCT entity AS entity, CASE WHEN length(entity) % 2 = 0 THEN replace(entity, '/', '%2F') ELSE entity END AS name FROM sf) SELECT name, vec_id FROM keys JOIN embeddings ON vec_id = {VECTOR}")
def vector_join(spark, d):
    """Names of which some are percent-encoded find the vectors of the decoded ones."""
    e = _dictionary(spark, d).select("entity").distinct()
    names = e.select(F.when(F.length("entity") % 2 == 0, F.replace("entity", F.lit("/"), F.lit("%2F"))).otherwise(F.col("entity")).alias("name"))
    v = vectors(spark, d, e)
    numbered = v.join(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec").select("key", "vec_id")
    return L.with_fallback(names, "name", numbered, "vec_id").select("name", "vec_id")


@query("rank_cutoff", f"WITH {LINKS}, {RANKS} SELECT id, round(pr, 6) AS pr FROM r{ROUNDS} WHERE round(pr, 6) >= 0.2")
def rank_cutoff(spark, d):
    return ranks(spark, d).select("id", F.round("pr", 6).alias("pr")).filter("pr >= 0.2")


MENTIONS = f"WITH {LINKS} SELECT DISTINCT page_id, anchor AS original, lower(anchor) AS sf, href AS entity FROM links"


def _mentions(spark, d) -> DataFrame:
    return anchors(spark, d).select("page_id", F.col("anchor").alias("original"), F.lower("anchor").alias("sf"), F.col("href").alias("entity")).distinct()


@query("mentions_without", f"SELECT * FROM ({MENTIONS}) WHERE original NOT IN ('The', 'and') AND sf NOT IN ('of')")
def mentions_without(spark, d):
    """Mentions without those of given originals or forms."""
    gone = spark.createDataFrame([("The",), ("and",)], "original string")
    forms = spark.createDataFrame([("of",)], "sf string")
    return _mentions(spark, d).join(F.broadcast(gone), "original", "left_anti").join(F.broadcast(forms), "sf", "left_anti")


@query("candidate_blacklist", f"SELECT * FROM ({MENTIONS}) WHERE NOT contains(entity, 'th') AND NOT contains(entity, 'an')")
def candidate_blacklist(spark, d):
    return U.without_any(_mentions(spark, d), "entity", ("th", "an"))


@query("name_whitelist", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '1') OR contains(lower(s_name), 'supplier#2')")
def name_whitelist(spark, d):
    return U.with_any(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_name", ("1", "SUPPLIER#2"))


@query("domain_whitelist", "WITH t AS (SELECT p_partkey AS entity, 'cls:' || p_type AS type FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 'wordnet_' || p_type FROM part WHERE p_partkey % 3 = 1) SELECT p_partkey AS entity FROM part WHERE p_partkey NOT IN (SELECT entity FROM t WHERE NOT contains(type, 'wordnet') AND NOT contains(type, 'wikicategory')) OR p_partkey IN (SELECT entity FROM t WHERE type IN (SELECT 'cls:' || p_type FROM part WHERE p_partkey <= 5))")
def domain_whitelist(spark, d):
    """Candidates without a type, or with one of the list; wordnet types and categories don't count."""
    p = table(spark, d, "part")
    t = p.filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("entity"), F.concat(F.lit("cls:"), "p_type").alias("type"))
    t = t.unionAll(p.filter("p_partkey % 3 = 1").select("p_partkey", F.concat(F.lit("wordnet_"), "p_type")))
    allowed = p.filter("p_partkey <= 5").select(F.concat(F.lit("cls:"), "p_type").alias("type")).distinct()
    return U.in_domain(p.select(F.col("p_partkey").alias("entity")), t, allowed)


CB = "replace(replace(replace({0}, 'https://', 'http://'), 'www.', ''), 'm.', '')"


@query("url_both_ways", f"SELECT page_id, {CB.format('url')} || CASE WHEN ends_with(url, '#id') THEN '' ELSE '#id' END AS iri, {CB.format('url')} <> url AS changes, regexp_matches(url, '^(https?|ftp)://[A-Za-z0-9.-]+(/[^[:space:]]*)?$') AS valid FROM pages")
def url_both_ways(spark, d):
    """The IRI of a page's url, whether that changes more than the suffix, and whether the url is well-formed; back again gives what was dropped no more."""
    u = F.col("url")
    x = table(spark, d, "pages").select("page_id", U.to_iri(u).alias("iri"), U.rewritten(u).alias("changes"), U.valid(u).alias("valid"))
    return x


@query("url_from_iri", f"SELECT page_id, replace(replace({CB.format('url')} || '#id', '#id', ''), 'http://', 'https://www.') AS v FROM pages WHERE NOT contains(url, '#')")
def url_from_iri(spark, d):
    return table(spark, d, "pages").filter("not contains(url, '#')").select("page_id", U.from_iri(U.to_iri(F.col("url"))).alias("v"))


@query("lines_by_key", "SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def lines_by_key(spark, d):
    keys = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id", "text").join(keys, "doc_id", "left_semi")


@query("nth_lines", "SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE n IN (1, 3)")
def nth_lines(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return x.select("doc_id", (F.col("n") + 1).alias("n"), "line").filter("n in (1, 3)")


@query("sorted_lines", "SELECT line, CAST(row_number() OVER (ORDER BY line) AS BIGINT) AS n FROM (SELECT DISTINCT p_name || chr(9) || p_partkey AS line FROM part)")
def sorted_lines(spark, d):
    """A total order over partitions: ranges first, then ranks within, then the ranges' offsets."""
    return U.numbered(table(spark, d, "part").select(F.concat_ws("\t", "p_name", "p_partkey").alias("line")).distinct(), "line", "n")


@query("occurrences", "SELECT doc_id, CAST(i AS INTEGER) AS pos FROM documents, range(1, 200000) r(i) WHERE i <= length(text) - 1 AND substring(text, i, 2) = 'th' AND doc_id % 10 = 0")
def occurrences(spark, d):
    """Places of a substring, overlapping ones too, in the queries' documents (ids divisible by 10)."""
    x = table(spark, d, "documents").filter("doc_id % 10 = 0")
    return x.select("doc_id", F.explode(U.occurrences(F.col("text"), "th")).alias("pos"))


@query("form_queries", "SELECT 'SF' AS family, 'part:' || p_partkey AS entity, p_name AS lit FROM part UNION ALL SELECT 'HSF', 'part:' || p_partkey, p_type FROM part UNION ALL SELECT 'NP_HSF', 'part:' || p_partkey, p_brand FROM part UNION ALL SELECT 'NP_URL_HSF', url, regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages")
def form_queries(spark, d):
    """The four families of surface-form queries by name: labels, helping literals, literals for noun phrases, and pages'."""
    p = table(spark, d, "part")
    of = lambda family, c: p.select(F.lit(family).alias("family"), F.concat(F.lit("part:"), "p_partkey").alias("entity"), F.col(c).alias("lit"))
    pages = table(spark, d, "pages").select(F.lit("NP_URL_HSF").alias("family"), F.col("url").alias("entity"), T.html_title(F.col("html")).alias("lit"))
    return of("SF", "p_name").unionByName(of("HSF", "p_type")).unionByName(of("NP_HSF", "p_brand")).unionByName(pages)


@query("entity_texts", "SELECT entity, string_agg(lit, ' ' ORDER BY lit) AS text FROM (SELECT 'part:' || p_partkey AS entity, p_name AS lit FROM part UNION ALL SELECT 'part:' || p_partkey, p_type FROM part UNION ALL SELECT 'part:' || p_partkey, p_brand FROM part) GROUP BY 1")
def entity_texts(spark, d):
    """All that the families say of an entity, sorted and grouped."""
    x = form_queries(spark, d).filter("family <> 'NP_URL_HSF'")
    return x.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("lit")), " ").alias("text"))


@query("form_triples", "SELECT 'part:' || p_partkey AS s, 'p_brand_p_type' AS p, p_brand || ' ' || p_type AS o FROM part")
def form_triples(spark, d):
    return U.column_triples(table(spark, d, "part"), F.concat(F.lit("part:"), "p_partkey"), ["p_brand", "p_type"])


TAGGED = f"SELECT page_id, list_transform(list_filter(regexp_extract_all(anchor, '{RX}'), lambda t: length(t) > 2), lambda w: CASE WHEN regexp_matches(w, '(ing|ed)$') THEN 'VBG' WHEN regexp_matches(w, '^(the|and|of|to|der|die|que)$') THEN 'IN' WHEN regexp_matches(w, 's$') THEN 'NNS' ELSE 'NN' END) AS tags, list_filter(regexp_extract_all(anchor, '{RX}'), lambda t: length(t) > 2) AS words FROM ({anchors_sql()})"


@query("noun_phrases", f"SELECT DISTINCT page_id, words[i] AS np FROM ({TAGGED}), range(1, 50) r(i) WHERE i <= len(words) AND tags[i] IN ('NN', 'NNS')")
def noun_phrases(spark, d):
    """A triple's words tagged as nouns; the tagger is a rule of endings that any other may take the place of."""
    x = anchors(spark, d).select("page_id", U.tagged(T.tokens(F.col("anchor"))).alias("t"))
    return x.select("page_id", F.explode(F.filter("t", lambda w: w["tag"].isin("NN", "NNS"))).alias("w")).select("page_id", F.col("w.word").alias("np")).distinct()


@query("base_noun_phrases", r"SELECT item_id, np FROM (SELECT item_id, unnest(regexp_extract_all(array_to_string(list_transform(words, lambda w: w || '/' || CASE WHEN regexp_matches(w, '(ing|ed)$') THEN 'VBG' WHEN regexp_matches(w, '^(the|and|of|to|der|die|que)$') THEN 'IN' WHEN regexp_matches(w, 's$') THEN 'NNS' ELSE 'NN' END), ' '), '([^ /]+/VBG )?[^ /]+/NNS?( [^ /]+/NNS?)*')) AS np FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '" + RX + "'), lambda t: length(t) > 2) AS words FROM benchmark))")
def base_noun_phrases(spark, d):
    """Stretches of word/TAG text that a rule's expansion matches: nouns, after a participle at most."""
    rules = {"noun": "[^ /]+/NNS?", "head": ";@noun@;( ;@noun@;)*", "np": "([^ /]+/VBG )?;@head@;"}
    x = table(spark, d, "benchmark").select("item_id", U.tagged(T.tokens(F.lower("text"))).alias("t"))
    return x.select("item_id", F.explode(U.phrases(F.col("t"), rules, "np")).alias("np"))


@query("audit_mapping", f"SELECT count(*) AS links, count(*) FILTER (WHERE href NOT IN (SELECT DISTINCT '/' || lower(anchor) FROM ({anchors_sql()}))) AS unknown FROM ({anchors_sql()})")
def audit_mapping(spark, d):
    """Links whose target no mapping has."""
    a = anchors(spark, d)
    known = a.select(F.concat(F.lit("/"), F.lower("anchor")).alias("href"), F.lit(1).alias("k")).distinct()
    return a.join(known, "href", "left").agg(F.count("*").alias("links"), F.count_if(F.col("k").isNull()).alias("unknown"))


@query("news_evaluation", f"WITH g AS (SELECT DISTINCT page_id, 'http:/' || href AS uri FROM ({anchors_sql()})), p AS (SELECT DISTINCT page_id, 'http:/' || '/' || lower(anchor) AS uri FROM ({anchors_sql()})), b AS (SELECT page_id, uri, max(g) AS g, max(p) AS p FROM (SELECT *, 1 AS g, NULL AS p FROM g UNION ALL SELECT *, NULL, 1 FROM p) GROUP BY 1, 2), f AS (SELECT page_id, count(*) FILTER (WHERE g = 1 AND p = 1) AS tp, count(p) AS np, count(g) AS ng FROM b GROUP BY 1) SELECT page_id, tp, round(coalesce(tp / nullif(np, 0), 0), 6) AS precision, round(coalesce(tp / nullif(ng, 0), 0), 6) AS recall FROM f")
def news_evaluation(spark, d):
    """Distinct predicted IRIs against the rewritten links of each page."""
    a = anchors(spark, d)
    gold = a.select("page_id", F.concat(F.lit("http:/"), "href").alias("uri")).distinct().withColumn("g", F.lit(1))
    pred = a.select("page_id", F.concat(F.lit("http://"), F.lower("anchor")).alias("uri")).distinct().withColumn("p", F.lit(1))
    f = gold.join(pred, ["page_id", "uri"], "full").groupBy("page_id").agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), F.count("p").alias("np"), F.count("g").alias("ng"))
    of = lambda n: F.round(F.coalesce(F.try_divide("tp", n), F.lit(0.0)), 6)
    return f.select("page_id", "tp", of("np").alias("precision"), of("ng").alias("recall"))


@query("page_texts", r"SELECT url, length(t) AS n, links FROM (SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS t, len(regexp_extract_all(html, '<a href=')) AS links FROM pages) WHERE links > 0 AND length(t) > 1")
def page_texts(spark, d):
    """What a crawl would save: pages with links and a text."""
    x = table(spark, d, "pages").select("url", F.length(T.html_text(F.col("html"))).cast("long").alias("n"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("links"))
    return x.filter("links > 0 and n > 1")
