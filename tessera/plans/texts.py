"""Text function queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import windows as W
from ..sources.kg import anchors, anchors_sql, table
from .registry import query

RX = "[^[:punct:][:space:]]+"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
WORDS = f"list_filter(regexp_extract_all(text, '{RX}'), lambda t: length(t) > 2)"


#: Segments: a token with the separator that ends it; the last one may have none.
SEGMENT = "[^[:punct:][:space:]]*(?:[[:punct:]]|[[:space:]]+)|[^[:punct:][:space:]]+"
ENDED = "regexp_matches({0}, '[[:punct:][:space:]]$')"
BARE = "CASE WHEN " + ENDED + " THEN left({0}, length({0}) - 1) ELSE {0} END"


def segments_sql(table: str = "documents", key: str = "doc_id") -> str:
    """CTEs seg (key, i, s, pos): segments with their offsets; win: windows of one and of two segments."""
    bare, nbare = BARE.format("s"), BARE.format("n")
    return (
        f"seg AS (SELECT {key}, i, s, coalesce(sum(length(s)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, lead(s) OVER (PARTITION BY {key} ORDER BY i) AS n "
        f"FROM (SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT {key}, regexp_extract_all(text, '{SEGMENT}') AS l FROM {table})))"
        f", two AS (SELECT {key}, pos, regexp_replace({bare}, '[[:space:]]+$', '') AS a, regexp_replace(right(s, 1) || {nbare}, '[[:space:]]+$', '') AS b, n IS NOT NULL AND {ENDED.format('s')} AS more FROM seg)"
        f", win AS (SELECT {key}, CAST(pos AS INTEGER) AS \"offset\", a AS text FROM two WHERE length(a) >= 2 UNION ALL SELECT {key}, CAST(pos AS INTEGER), a || b FROM two WHERE more AND length(b) >= 2)"
    )


@query("tokens_single", f"WITH {segments_sql()} SELECT doc_id, CAST(pos AS INTEGER) AS \"offset\", {BARE.format('s')} AS token FROM seg WHERE length({BARE.format('s')}) > 2")
def tokens_single(spark, d):
    return W.windows(table(spark, d, "documents"), "single").withColumnRenamed("text", "token")


@query("tokens_offsets", f"SELECT doc_id, count(*) AS n, sum(pos) AS offsets FROM (WITH {segments_sql()} SELECT doc_id, pos FROM seg WHERE length({BARE.format('s')}) > 2) GROUP BY 1")
def tokens_offsets(spark, d):
    """Number of tokens and sum of their offsets."""
    return W.windows(table(spark, d, "documents"), "single").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("offset").cast("decimal(38,0)").alias("offsets"))


@query("tokens_window2", f"WITH {segments_sql()} SELECT doc_id, \"offset\", text FROM win")
def tokens_window2(spark, d):
    return W.windows(table(spark, d, "documents"), "bounded")


STRETCH = "SELECT item_id, CAST(a.pos AS INTEGER) AS \"offset\", substring(text, CAST(a.pos AS BIGINT) + 1, CAST(b.cut - a.pos - 1 AS BIGINT)) AS text FROM c a JOIN c b USING (item_id) JOIN benchmark USING (item_id) WHERE b.i >= a.i AND b.cut - a.pos - 1 > 2 AND {0}"
CUTS = f"WITH {segments_sql('benchmark', 'item_id')}, c AS (SELECT item_id, i, pos, pos + length(s) + CASE WHEN n IS NULL AND NOT {ENDED.format('s')} THEN 1 ELSE 0 END AS cut, length(s) + CASE WHEN n IS NULL AND NOT {ENDED.format('s')} THEN 1 ELSE 0 END AS w FROM seg) "


@query("tokens_unbounded", CUTS + STRETCH.format("CASE WHEN a.i = b.i THEN a.i = 1 ELSE b.w > 2 END"))
def tokens_unbounded(spark, d):
    """All stretches between cuts of the benchmark's items; their number is the square of a text's length, so
    documents (of up to 20,000 words) would give 10^8 rows each."""
    return W.windows(table(spark, d, "benchmark"), "unbounded", "item_id")


@query("tokens_multiword", CUTS + STRETCH.format("b.i > a.i AND b.w > 2"))
def tokens_multiword(spark, d):
    return W.windows(table(spark, d, "benchmark"), "multiword", "item_id")


@query("stopword_filter", f"SELECT doc_id, array_to_string(list_filter({WORDS}, lambda t: NOT list_contains({STOP}, t) AND NOT list_contains({STOP}, lower(t))), ' ') AS words FROM documents")
def stopword_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", T.key(F.col("text")).alias("words"))


@query("sf_split", "SELECT DISTINCT p_partkey AS entity, w AS sf FROM (SELECT p_partkey, unnest(list_append(list_filter(regexp_extract_all(p_name, '[^[:punct:][:space:]]+'), lambda t: length(t) > 2 AND left(t, 1) <> lower(left(t, 1))), p_name)) AS w FROM part)")
def sf_split(spark, d):
    parts = F.filter(T.tokens(F.col("p_name")), lambda t: F.substring(t, 1, 1) != F.lower(F.substring(t, 1, 1)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.explode(F.array_append(parts, F.col("p_name"))).alias("sf")).distinct()


PADDED = "('$$' || lower(p_name) || '$$')"


@query("ngrams3", f"SELECT p_partkey, substring({PADDED}, i, 3) AS gram, count(*) AS n FROM part, range(1, 200) r(i) WHERE i <= length({PADDED}) - 2 GROUP BY 1, 2")
def ngrams3(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(T.ngrams(F.col("p_name"))).alias("gram")).groupBy("p_partkey", "gram").agg(F.count("*").alias("n"))


@query("strip_iri", "SELECT p_partkey, regexp_replace('<part:' || p_partkey || '>', '^<(.*)>$', '\\1') AS v FROM part")
def strip_iri(spark, d):
    return table(spark, d, "part").select("p_partkey", T.strip_iri(F.concat(F.lit("<part:"), "p_partkey", F.lit(">"))).alias("v"))


@query("strip_lang", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '"' || p_name || '"' ELSE p_name END AS v FROM part""")
def strip_lang(spark, d):
    lit = F.concat(F.lit('"'), "p_name", F.when(F.col("p_partkey") % 2 == 0, '"@en').otherwise('"'))
    return table(spark, d, "part").select("p_partkey", T.strip_literal(lit).alias("v"))


@query("percent_decode", "SELECT DISTINCT href, url_decode(href) AS v FROM (" + anchors_sql() + ")")
def percent_decode(spark, d):
    return anchors(spark, d).select("href", T.percent_decode(F.col("href")).alias("v")).distinct()


@query("url_rewrite", "SELECT page_id, replace(replace(url, 'https://', 'http://'), 'www.', '') || CASE WHEN contains(url, '#') THEN '' ELSE '#id' END AS v FROM pages")
def url_rewrite(spark, d):
    u = F.replace(F.replace("url", F.lit("https://"), F.lit("http://")), F.lit("www."), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.concat(u, F.when(F.col("url").contains("#"), "").otherwise("#id")).alias("v"))


@query("label_norm", "SELECT p_partkey, CASE WHEN length(t) > 4 AND (t = upper(t) OR t = lower(t)) THEN upper(left(t, 1)) || lower(substring(t, 2)) WHEN contains(t, ' ') THEN t ELSE regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g') END AS v FROM (SELECT p_partkey, regexp_replace(regexp_replace(trim(p_brand), '[#,.]', '', 'g'), '[_-]', ' ', 'g') AS t FROM part)")
def label_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", T.label_norm(F.col("p_brand")).alias("v"))


@query("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query("html_text", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || chr(10) || trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("html_links", "SELECT page_id, href, anchor, count(*) AS n FROM (" + anchors_sql() + ") GROUP BY 1, 2, 3")
def html_links(spark, d):
    return anchors(spark, d).groupBy("page_id", "href", "anchor").agg(F.count("*").alias("n"))


@query("shorten", "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 40) || ' [...] (' || length(text) || ')' ELSE text END AS v FROM documents")
def shorten(spark, d):
    return table(spark, d, "documents").select("doc_id", T.shorten(F.col("text"), 40).alias("v"))


@query("clean_markup", "SELECT page_id, replace(regexp_replace(html, '[\\n\\r<>]', ' ', 'g'), '  ', ' ') AS v FROM pages")
def clean_markup(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_markup(F.col("html")).alias("v"))


@query("literal_analyzer", "SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(strip_accents(lower(text)), '[^a-z]+')) AS w FROM benchmark) WHERE w <> '' GROUP BY 1, 2")
def literal_analyzer(spark, d):
    folded = F.translate(F.lower("text"), "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return table(spark, d, "benchmark").select("item_id", F.explode(F.split(folded, "[^a-z]+")).alias("w")).filter("w <> ''").groupBy("item_id", "w").agg(F.count("*").alias("n"))


@query("nif_uri", "SELECT doc_id, 'urn:doc:' || doc_id || '#char=0,' || length(text) AS uri FROM documents")
def nif_uri(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("urn:doc:"), "doc_id", F.lit("#char=0,"), F.length("text")).alias("uri"))


@query("kth_occurrence", f"WITH {segments_sql()} SELECT doc_id, \"offset\", token, CAST(row_number() OVER (PARTITION BY doc_id, token ORDER BY \"offset\") AS INTEGER) AS k FROM (SELECT doc_id, CAST(pos AS INTEGER) AS \"offset\", {BARE.format('s')} AS token FROM seg) WHERE length(token) > 2")
def kth_occurrence(spark, d):
    return tokens_single(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "token").orderBy("offset")))


@query("number_words")
def number_words(spark, d):
    words = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, T.TENS)), (F.col("p_partkey") % 8 + 1).cast("int")), F.element_at(F.array(*map(F.lit, T.UNITS[1:10])), (F.col("p_partkey") % 9 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", words.alias("words"), T.word2num(words).alias("digits"))


@query("german_stem")
def german_stem(spark, d):
    w = table(spark, d, "documents").filter("lang = 'de'").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", T.german_stem("word").alias("stem"))


@query("nfkd_norm")
def nfkd_norm(spark, d):
    w = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", T.nfkd("word").alias("norm")).filter("word <> norm")


@query("iri_keys", """SELECT page_id, CASE WHEN starts_with(url, '<') THEN '' ELSE '<' END || url || CASE WHEN ends_with(url, '>') THEN '' ELSE '>' END AS iri,
    regexp_extract(url, '[^/]*$') || '__;__' || CAST(page_id AS VARCHAR) AS key FROM pages""")
def iri_keys(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", T.bracketed(F.col("url")).alias("iri"), T.with_offset(F.regexp_extract("url", "[^/]*$", 0), F.col("page_id")).alias("key"))


@query("span_faults", """WITH s AS (SELECT doc_id, text, CAST(doc_id % 50 AS INTEGER) AS b, CAST(1 + doc_id % 20 AS INTEGER) AS n FROM documents),
    c AS (SELECT doc_id, substring(text, b + 1, 1) AS first, CASE WHEN b > 0 THEN substring(text, b, 1) ELSE '' END AS before, substring(text, b + n, 1) AS last, substring(text, b + n + 1, 1) AS after FROM s)
    SELECT doc_id, concat_ws(' ', CASE WHEN regexp_matches(first, '^\\s$') THEN 'space_first' END, CASE WHEN regexp_matches(before, '^\\pL$') THEN 'letter_before' END,
    CASE WHEN regexp_matches(last, '^\\s$') THEN 'space_last' END, CASE WHEN regexp_matches(after, '^\\pL$') THEN 'letter_after' END) AS faults FROM c""")
def span_faults(spark, d):
    """The faults of one span in every document, placed by its id."""
    start, length = (F.col("doc_id") % 50).cast("int"), (1 + F.col("doc_id") % 20).cast("int")
    return table(spark, d, "documents").select("doc_id", F.array_join(T.span_faults(F.col("text"), start, length), " ").alias("faults"))
