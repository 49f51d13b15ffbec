"""File formats in and out: triples, links, vectors, ranks, walks, NIF and reports. All readers are lazy text scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINK_DELIMITER, RESULT_DELIMITER, WALK_DELIMITER = " %%%%% ", "\t;\t", "->"  # fixed values of the file formats
TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*$'


def _unwrap(c: Column) -> Column:
    return F.regexp_replace(c, r"^<(.*)>$", "$1")


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_kind, o_datatype, o_lang; lines that are no statement are left out."""
    line = spark.read.text(path).filter(F.col("value").rlike(TRIPLE))
    raw = F.regexp_extract("value", TRIPLE, 3)
    t = line.select(_unwrap(F.regexp_extract("value", TRIPLE, 1)).alias("s"), F.regexp_extract("value", TRIPLE, 2).alias("p"), raw.alias("raw"))
    kind = F.when(F.col("raw").startswith('"'), "literal").when(F.col("raw").startswith("_:"), "bnode").otherwise("uri")
    lexical = F.regexp_extract("raw", r'^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    none = F.lit(None).cast("string")

    def part(pattern):
        x = F.regexp_extract("raw", pattern, 1)
        return F.when((kind == "literal") & (x != ""), x).otherwise(none)

    return t.select("s", "p", F.when(kind == "literal", lexical).otherwise(_unwrap(F.col("raw"))).alias("o"), kind.alias("o_kind"), part(r'"\^\^<([^>]*)>$').alias("o_datatype"), part(r'"@([A-Za-z0-9-]+)$').alias("o_lang"))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a triple file, but for blanks and comments, that are no statement."""
    return spark.read.text(path).filter(~F.col("value").rlike(TRIPLE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header)


READERS: dict[str, Callable] = {"n3": ntriples, "nt": ntriples, "csv": delimited}


def load(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    return READERS[kind.lower()](spark, path, **options)


def links(spark: SparkSession, path: str) -> DataFrame:
    """entity, pred, sf of lines with two or three tokens; others are left out."""
    x = spark.read.text(path).select(F.split("value", LINK_DELIMITER).alias("t")).filter(F.size("t").isin(2, 3))
    return x.select(F.col("t")[0].alias("entity"), F.when(F.size("t") == 3, F.col("t")[1]).alias("pred"), F.element_at("t", -1).alias("sf"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()


def embeddings(spark: SparkSession, path: str, sep: str = "\t", normalise: bool = False, id_map: DataFrame | None = None) -> DataFrame:
    """entity, vec of ``iri<sep>f1<sep>...`` lines; gzip files are read alike. id_map: key, value."""
    x = spark.read.text(path).select(F.split("value", sep).alias("t")).filter(F.size("t") > 1)
    x = x.select(_unwrap(F.col("t")[0]).alias("entity"), F.slice("t", F.lit(2), F.size("t") - 1).cast("array<float>").alias("vec"))
    if id_map is not None:
        x = x.join(id_map, x["entity"] == id_map["key"], "left").select(F.coalesce("value", "entity").alias("entity"), "vec")
    if normalise:
        from ..operators.embed import sum_normalised

        x = x.withColumn("vec", sum_normalised(F.col("vec")))
    return x


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """entity (lower case), score: scores of one key are summed."""
    return ntriples(spark, path).groupBy(F.lower("s").alias("entity")).agg(F.sum(F.col("o").cast("double")).alias("score"))


def entities(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    e = ntriples(spark, path).select(F.col("s").alias("entity"))
    return e.distinct() if distinct else e


def id_mapping(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.text(path).select(F.split("value", "\t").alias("t")).filter(F.size("t") == 2)
    return x.select(F.col("t")[0].alias("key"), F.col("t")[1].alias("value"))


def walks(spark: SparkSession, path: str) -> DataFrame:
    """entity, tokens; lines that begin with # are comments."""
    x = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", WALK_DELIMITER).alias("tokens"))
    return x.select(F.col("tokens")[0].alias("entity"), "tokens")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one file is one document."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def nif(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_uri, text; markings: doc_uri, start, length, uri, confidence) of a NIF graph's triples."""

    def of(p: str, name: str) -> DataFrame:
        return triples.filter(F.col("p").endswith(p)).select("s", F.col("o").alias(name))

    docs = of("#isString", "text").withColumnRenamed("s", "doc_uri")
    m = of("#referenceContext", "doc_uri").join(of("#beginIndex", "b"), "s").join(of("#endIndex", "e"), "s").join(of("#taIdentRef", "uri"), "s", "left").join(of("#taConfidence", "c"), "s", "left")
    start = F.col("b").cast("int")
    return docs, m.select("doc_uri", start.alias("start"), (F.col("e").cast("int") - start).alias("length"), "uri", F.col("c").cast("double").alias("confidence"))


def result_table(spark: SparkSession, path: str) -> DataFrame:
    """Result rows by arity: kind is ok (28 fields), error or running."""
    t = F.split("value", "\t")
    kind = F.when(F.size(t) >= 28, "ok").when(F.col("value").contains("error"), "error").otherwise("running")
    return spark.read.text(path).select(t.alias("fields"), kind.alias("kind"))


def property_of(spark: SparkSession, path: str, key: str) -> str | None:
    row = spark.read.text(path).filter(F.col("value").startswith(f"{key}=")).select(F.substring("value", len(key) + 2, 1 << 20).alias("v")).first()
    return row["v"] if row else None


RESOURCE = "`@URI` string, `@support` string, `@types` string, `@surfaceForm` string, `@offset` string, `@similarityScore` string, `@percentageOfSecondRank` string"


def annotations(answers: DataFrame) -> DataFrame:
    """doc_id, uri, sf, offset, score: the resources of annotation answers (doc_id, json), of each IRI the last one.
    An answer that is null, no JSON or without resources gives no row."""
    found = answers.select("doc_id", F.posexplode(F.from_json("json", f"Resources array<struct<{RESOURCE}>>")["Resources"]).alias("i", "r"))
    last = found.groupBy("doc_id", F.col("r.`@URI`").alias("uri")).agg(F.max_by("r", "i").alias("r"))
    return last.select("doc_id", "uri", F.col("r.`@surfaceForm`").alias("sf"), F.col("r.`@offset`").cast("int").alias("offset"), F.col("r.`@similarityScore`").cast("double").alias("score"))


def offline_pages(spark: SparkSession, path: str, mapping: DataFrame) -> DataFrame:
    """url, html: files below a folder, whole, with the url that mapping (file, url) gives their name; a file of several
    urls gives a row for each, one without url none."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("html"))
    return files.join(mapping.select("file", "url"), "file").select("url", "html")
