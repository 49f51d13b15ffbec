"""Triple-pattern queries over the catalog graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bgp
from ..sources.kg import Catalog, catalog, catalog_sql, table
from .registry import query

KG = f"WITH kg AS ({catalog_sql()}) "


@query("bgp_single", KG + "SELECT s AS entity, o AS lit FROM kg WHERE p = 'label'")
def single(spark, d):
    return bgp.match(catalog(spark, d, ("label",)), [("?entity", "label", "?lit")])


@query("bgp_distinct_subjects", KG + "SELECT DISTINCT s FROM kg WHERE p = 'inNation'")
def distinct_subjects(spark, d):
    return bgp.match(catalog(spark, d, ("inNation",)), [("?s", "inNation", None)]).distinct()


@query("bgp_in_list", KG + "SELECT s, o FROM kg WHERE p = 'rdf:type' AND o IN ('cls:Nation', 'cls:Region', 'cls:Supplier')")
def in_list(spark, d):
    return catalog(spark, d, ("rdf:type",)).filter(F.col("o").isin("cls:Nation", "cls:Region", "cls:Supplier")).select("s", "o")


@query("bgp_star", KG + "SELECT a.s AS s, b.o AS name FROM kg a JOIN kg b ON a.s = b.s WHERE a.p = 'rdf:type' AND a.o = 'cls:Supplier' AND b.p = 'label'")
def star(spark, d):
    return bgp.match(catalog(spark, d, ("rdf:type", "label")), [("?s", "rdf:type", "cls:Supplier"), ("?s", "label", "?name")])


@query("bgp_chain2", f"WITH kg AS MATERIALIZED ({catalog_sql()}), a AS MATERIALIZED (SELECT p, o FROM kg WHERE s = 'customer:7') SELECT a.p AS p1, a.o AS o1, b.p AS p2, b.o AS o2 FROM a JOIN kg b ON a.o = b.s")
def chain2(spark, d):
    return bgp.match(Catalog(spark, d), [("customer:7", "?p1", "?o1"), ("?o1", "?p2", "?o2")]).select("p1", "o1", "p2", "o2")


@query("bgp_chain_d", KG + "SELECT a.s AS s, a.p AS p0, a.o AS o0, b.p AS p1, b.o AS o1, c.p AS p2, c.o AS o2 FROM kg a JOIN kg b ON a.o = b.s JOIN kg c ON b.o = c.s WHERE a.p NOT IN ('contains', 'suppliedBy') AND b.p NOT IN ('contains', 'suppliedBy') AND c.p NOT IN ('contains', 'suppliedBy') AND c.o_kind <> 'literal'")
def chain_d(spark, d):
    return bgp.chain(catalog(spark, d), 3, ("contains", "suppliedBy"))


@query("bgp_chain_limit", KG + "SELECT a.s AS s, a.p AS p0, a.o AS o0, b.p AS p1, b.o AS o1 FROM kg a JOIN kg b ON a.o = b.s WHERE b.o_kind <> 'literal' ORDER BY s, p0, o0, p1, o1 LIMIT 1000")
def chain_limit(spark, d):
    return bgp.chain(catalog(spark, d), 2).orderBy("s", "p0", "o0", "p1", "o1").limit(1000)


@query("bgp_triangle", KG + "SELECT DISTINCT ts.o AS type_s, e.p AS pred, tobj.o AS type_o FROM kg ts JOIN kg e ON ts.s = e.s JOIN kg tobj ON tobj.s = e.o WHERE ts.p = 'rdf:type' AND tobj.p = 'rdf:type'")
def triangle(spark, d):
    t = Catalog(spark, d)
    return bgp.match(t, [("?x", "rdf:type", "?type_s"), ("?x", "?pred", "?y"), ("?y", "rdf:type", "?type_o")]).select("type_s", "pred", "type_o").distinct()


@query("bgp_group_count", KG + "SELECT p, count(*) AS n FROM kg GROUP BY p")
def group_count(spark, d):
    return catalog(spark, d).groupBy("p").agg(F.count("*").alias("n"))


@query("bgp_count_distinct", KG + "SELECT count(DISTINCT s) AS n FROM kg WHERE p = 'rdf:type'")
def count_distinct(spark, d):
    return catalog(spark, d, ("rdf:type",)).agg(F.countDistinct("s").alias("n"))


@query("bgp_distinct_pred", KG + "SELECT DISTINCT p FROM kg WHERE s = 'order:1'")
def distinct_pred(spark, d):
    return catalog(spark, d, s="order:1").select("p").distinct()


@query("bgp_is_literal", KG + "SELECT DISTINCT p FROM kg WHERE o_kind = 'literal'")
def is_literal(spark, d):
    return catalog(spark, d).filter("o_kind = 'literal'").select("p").distinct()


@query("bgp_strlen", KG + "SELECT s, o, CAST(length(o) AS INTEGER) AS n FROM kg WHERE o_kind = 'literal' AND length(o) > 1 AND length(o) < 8000")
def strlen(spark, d):
    n = F.length("o")
    return catalog(spark, d, ("label",)).filter((F.col("o_kind") == "literal") & (n > 1) & (n < 8000)).select("s", "o", n.alias("n"))


@query("bgp_prefix", KG + "SELECT s, p, o FROM kg WHERE starts_with(s, 'supplier:1')")
def prefix(spark, d):
    return catalog(spark, d).filter(F.col("s").startswith("supplier:1")).select("s", "p", "o")


@query("bgp_lang", KG + "SELECT s, o FROM kg WHERE o_lang = 'en' AND p = 'label'")
def lang(spark, d):
    return catalog(spark, d, ("label",)).filter("o_lang = 'en'").select("s", "o")


@query("bgp_offset_limit", KG + "SELECT DISTINCT s FROM kg WHERE p = 'rdf:type' ORDER BY s LIMIT 50 OFFSET 20")
def offset_limit(spark, d):
    return catalog(spark, d, ("rdf:type",)).select("s").distinct().orderBy("s").offset(20).limit(50)


@query("bgp_sample", KG + "SELECT s, o FROM kg WHERE p = 'label' ORDER BY md5('seed7' || s), s LIMIT 25")
def sample(spark, d):
    return catalog(spark, d, ("label",)).select("s", "o").orderBy(F.md5(F.concat(F.lit("seed7"), "s").cast("binary")), "s").limit(25)


@query("bgp_concat", KG + "SELECT a.s AS s, a.o || ' ' || b.o AS full_name FROM kg a JOIN kg b ON a.s = b.s WHERE a.p = 'brand' AND b.p = 'label'")
def concat(spark, d):
    return bgp.match(catalog(spark, d, ("brand", "label")), [("?s", "brand", "?a"), ("?s", "label", "?b")]).select("s", F.concat_ws(" ", "a", "b").alias("full_name"))


@query("bgp_selector", KG + "SELECT s, p, o FROM kg WHERE p = 'inRegion' AND o = 'region:1'")
def selector(spark, d):
    return Catalog(spark, d).scan(None, "inRegion", "region:1").select("s", "p", "o")


A, B = "(SELECT s, p, o FROM kg WHERE p IN ('label', 'inNation'))", "(SELECT s, p, o FROM kg WHERE p IN ('label', 'inRegion') AND starts_with(s, 'nation:'))"


def _two(spark, d):
    a = catalog(spark, d, ("label", "inNation")).select("s", "p", "o")
    return a, catalog(spark, d, ("label", "inRegion")).filter(F.col("s").startswith("nation:")).select("s", "p", "o")


@query("bgp_union", KG + f"SELECT * FROM {A} UNION SELECT * FROM {B}")
def union(spark, d):
    a, b = _two(spark, d)
    return a.unionByName(b).distinct()


@query("bgp_left", KG + f"SELECT a.s AS s, a.p AS p, a.o AS o, b.s IS NOT NULL AS in_other FROM {A} a LEFT JOIN (SELECT DISTINCT * FROM {B}) b ON a.s = b.s AND a.p = b.p AND a.o = b.o")
def left(spark, d):
    return bgp.left_merge(*_two(spark, d))


@query("bgp_right", KG + f"SELECT b.s AS s, b.p AS p, b.o AS o, a.s IS NOT NULL AS in_other FROM {B} b LEFT JOIN (SELECT DISTINCT * FROM {A}) a ON a.s = b.s AND a.p = b.p AND a.o = b.o")
def right(spark, d):
    a, b = _two(spark, d)
    return bgp.left_merge(b, a)


@query("bgp_inner", KG + f"SELECT * FROM {A} INTERSECT SELECT * FROM {B}")
def inner(spark, d):
    a, b = _two(spark, d)
    return a.intersect(b)


@query("bgp_add_remove", KG + f"SELECT * FROM (SELECT * FROM {A} UNION SELECT * FROM {B}) EXCEPT SELECT s, p, o FROM kg WHERE p = 'inNation' AND o = 'nation:3'")
def add_remove(spark, d):
    a, b = _two(spark, d)
    return bgp.remove(bgp.add(a, b), catalog(spark, d, ("inNation",)).filter("o = 'nation:3'"))


@query("bgp_neighbours", KG + "SELECT o1, n, rn FROM (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, o1) AS INTEGER) AS rn FROM (SELECT a.o AS o1, count(*) AS n FROM kg a JOIN kg b ON a.o = b.s WHERE a.s = 'order:1' GROUP BY a.o)) WHERE rn <= 20")
def neighbours(spark, d):
    t = Catalog(spark, d)
    n = bgp.match(t, [("order:1", None, "?o1"), ("?o1", None, None)]).groupBy("o1").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "o1").limit(20)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), "o1")))


@query("bgp_whitespace", "SELECT doc_id, replace(regexp_replace(text, '\\s', ' ', 'g'), '  ', ' ') AS v FROM documents")
def whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", r"[ \t\n\r\f]", " "), "  ", " ").alias("v"))


@query("literal_search_and", KG + "SELECT s, o FROM kg WHERE p = 'label' AND list_contains(string_split_regex(lower(o), '[^a-z]+'), 'red') AND list_contains(string_split_regex(lower(o), '[^a-z]+'), 'bolt') ORDER BY s LIMIT 100")
def literal_search(spark, d):
    words = F.split(F.lower("o"), "[^a-z]+")
    t = catalog(spark, d, ("label",)).select("s", "o", words.alias("w"))
    return t.filter(F.array_contains("w", "red") & F.array_contains("w", "bolt")).orderBy("s").limit(100).select("s", "o")


@query("context_search", "SELECT doc_id, score FROM (SELECT doc_id, CAST(list_contains(w, 'the') AS BIGINT) + CAST(list_contains(w, 'and') AS BIGINT) AS score FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents) WHERE list_contains(w, 'of')) ORDER BY score DESC, doc_id LIMIT 500")
def context_search(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.split(F.lower("text"), "[^a-z]+").alias("w")).filter(F.array_contains("w", "of"))
    score = F.array_contains("w", "the").cast("long") + F.array_contains("w", "and").cast("long")
    return w.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(500)


@query("label_fetch", KG + "SELECT s, o FROM kg WHERE s = 'part:5' AND p = 'label' AND o_lang = 'en' ORDER BY o LIMIT 100")
def label_fetch(spark, d):
    """A subject's labels in a language, 100 at most: the feature's limit."""
    return Catalog(spark, d).scan("part:5", "label", None).filter("o_lang = 'en'").orderBy("o").limit(100).select("s", "o")


@query("property_lists", KG + "SELECT s, string_agg(p || '=' || o, '|' ORDER BY p, o) AS properties FROM kg WHERE p IN ('rdf:type', 'label', 'inNation') GROUP BY 1")
def property_lists(spark, d):
    t = catalog(spark, d, ("rdf:type", "label", "inNation"))
    return t.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "o"))), lambda x: F.concat_ws("=", x["p"], x["o"])), "|").alias("properties"))


@query("rendered_solutions", KG + "SELECT s || chr(9) || p || chr(9) || o AS line FROM kg WHERE p = 'inRegion'")
def rendered_solutions(spark, d):
    return bgp.rendered(catalog(spark, d, ("inRegion",)), ["s", "p", "o"]).select("line")


#: Queries by name, as a batch of query files would hold them.
BATCH = {"labels": [("?entity", "label", "?lit")], "nations": [("?entity", "inNation", "?n"), ("?n", "label", "?lit")]}


@query("query_batch", KG + "SELECT 'labels' AS name, s AS entity, o AS lit FROM kg WHERE p = 'label' UNION ALL SELECT 'nations', a.s, b.o FROM kg a JOIN kg b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'label'")
def query_batch(spark, d):
    return bgp.batch(Catalog(spark, d), BATCH, ["entity", "lit"])


SEARCH = "list_filter(string_split_regex(lower(o), '[^a-z]+'), lambda t: t <> '')"


@query("literal_search", KG + f", q AS (SELECT * FROM (VALUES (1, 'Red Bolt'), (2, 'part:7'), (3, '12')) q(id, text)) SELECT id, s, o FROM (SELECT id, s, o, row_number() OVER (PARTITION BY id ORDER BY length(o), s) AS r FROM q JOIN kg ON p IN ('label', 'brand') AND CASE WHEN contains(text, ':') THEN s = text WHEN regexp_matches(text, '^[0-9]+$') THEN regexp_extract(o, '([0-9]+)$', 1) = text ELSE len(list_filter(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> ''), lambda t: NOT list_contains({SEARCH}, t))) = 0 END) WHERE r <= 100")
def literal_search_forms(spark, d):
    """Queries of three forms: all words in a literal, an IRI exactly, a number exactly; 100 at most each, the shortest first."""
    q = spark.createDataFrame([(1, "Red Bolt"), (2, "part:7"), (3, "12")], "id int, text string")
    return bgp.literal_search(catalog(spark, d, ("label", "brand")), q, 100)


@query("types_inferred", "WITH RECURSIVE sub AS (SELECT * FROM (VALUES ('cls:Supplier', 'cls:Company'), ('cls:Customer', 'cls:Company'), ('cls:Company', 'cls:Agent'), ('cls:Agent', 'cls:Thing'), ('cls:Nation', 'cls:Place'), ('cls:Place', 'cls:Thing')) x(a, b)), " + f"kg AS ({catalog_sql()})" + ", t AS (SELECT s, o FROM kg WHERE p = 'rdf:type' AND o <> 'cls:Order' UNION SELECT t.s, sub.b FROM t JOIN sub ON t.o = sub.a) SELECT s, o AS type FROM t")
def types_inferred(spark, d):
    sub = spark.createDataFrame([("cls:Supplier", "cls:Company"), ("cls:Customer", "cls:Company"), ("cls:Company", "cls:Agent"), ("cls:Agent", "cls:Thing"), ("cls:Nation", "cls:Place"), ("cls:Place", "cls:Thing")], "sub string, super string")
    return bgp.inferred(catalog(spark, d, ("rdf:type",)).filter("o <> 'cls:Order'").select("s", F.col("o").alias("type")), sub)


@query("markings_by_kind", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'meaning' WHEN l_returnflag = 'A' THEN 'scored' ELSE 'span' END AS kind FROM lineitem) GROUP BY 1")
def markings_by_kind(spark, d):
    """Markings with an IRI are meanings, with a confidence scored, else spans."""
    x = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "u").alias("uri"), F.when(F.col("l_returnflag") == "A", 0.5).alias("confidence"))
    kind = F.when(F.col("uri").isNotNull(), "meaning").when(F.col("confidence").isNotNull(), "scored").otherwise("span")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
