"""The triple model: (s, p, o, o_kind, o_datatype, o_lang), and two knowledge graphs over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The catalog graph: table, subject prefix, subject column, predicate, object prefix, object column, kind of object.
#: Without an object column the prefix is the whole object.
CATALOG = (
    ("part", "part:", "p_partkey", "rdf:type", "cls:Part", None, "uri"),
    ("part", "part:", "p_partkey", "label", "", "p_name", "literal"),
    ("part", "part:", "p_partkey", "brand", "brand:", "p_brand", "uri"),
    ("part", "part:", "p_partkey", "ptype", "type:", "p_type", "uri"),
    ("supplier", "supplier:", "s_suppkey", "rdf:type", "cls:Supplier", None, "uri"),
    ("supplier", "supplier:", "s_suppkey", "label", "", "s_name", "literal"),
    ("supplier", "supplier:", "s_suppkey", "inNation", "nation:", "s_nationkey", "uri"),
    ("customer", "customer:", "c_custkey", "rdf:type", "cls:Customer", None, "uri"),
    ("customer", "customer:", "c_custkey", "label", "", "c_name", "literal"),
    ("customer", "customer:", "c_custkey", "inNation", "nation:", "c_nationkey", "uri"),
    ("nation", "nation:", "n_nationkey", "rdf:type", "cls:Nation", None, "uri"),
    ("nation", "nation:", "n_nationkey", "label", "", "n_name", "literal"),
    ("nation", "nation:", "n_nationkey", "inRegion", "region:", "n_regionkey", "uri"),
    ("region", "region:", "r_regionkey", "rdf:type", "cls:Region", None, "uri"),
    ("region", "region:", "r_regionkey", "label", "", "r_name", "literal"),
    ("orders", "order:", "o_orderkey", "rdf:type", "cls:Order", None, "uri"),
    ("orders", "order:", "o_orderkey", "by", "customer:", "o_custkey", "uri"),
    ("lineitem", "order:", "l_orderkey", "contains", "part:", "l_partkey", "uri"),
    ("lineitem", "part:", "l_partkey", "suppliedBy", "supplier:", "l_suppkey", "uri"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] | None = None, s: str | None = None, o: str | None = None) -> DataFrame:
    """The catalog graph; branches of other predicates than those asked for are not planned at all. A bound subject or
    object (``s``, ``o``) leaves only the branches of its prefix, and becomes a filter of the key at their scans.
    Edges of lineitem are distinct."""

    def key(term: str, prefix: str):
        rest = term[len(prefix) :]
        return int(rest) if term.startswith(prefix) and rest.isdigit() and str(int(rest)) == rest else None

    def branch(t, sp, sc, p, op, oc, kind):
        d = table(spark, sf_dir, t)
        if s is not None:
            if key(s, sp) is None:
                return None
            d = d.filter(F.col(sc) == key(s, sp))
        if o is not None:
            number = oc is not None and op != "" and dict(d.dtypes)[oc] != "string"
            if (number and key(o, op) is None) or (oc is None and o != op) or not o.startswith(op):
                return None
            if oc is not None:
                d = d.filter(F.col(oc) == (key(o, op) if number else o[len(op) :]))
        subject = F.concat(F.lit(sp), F.col(sc).cast("string"))
        object_ = F.concat(F.lit(op), F.col(oc).cast("string")) if oc else F.lit(op)
        if t == "lineitem":
            d = d.select(sc, oc).distinct()
        return d.select(subject.alias("s"), F.lit(p).alias("p"), object_.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit("en" if kind == "literal" else None).cast("string").alias("o_lang"))

    parts = [b for b in (branch(*b) for b in CATALOG if predicates is None or b[3] in predicates) if b is not None]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "s string, p string, o string, o_kind string, o_datatype string, o_lang string")


class Catalog:
    """The catalog as a source of patterns: each is scanned with what it binds."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def scan(self, s: str | None, p: str | None, o: str | None) -> DataFrame:
        return catalog(self.spark, self.sf_dir, (p,) if p else None, s, o)


def catalog_sql() -> str:
    """The same graph as a DuckDB subquery."""

    def branch(t, sp, sc, p, op, oc, kind):
        o = f"'{op}' || CAST({oc} AS VARCHAR)" if oc else f"'{op}'"
        lang = "'en'" if kind == "literal" else "CAST(NULL AS VARCHAR)"
        return f"SELECT {'DISTINCT ' if t == 'lineitem' else ''}'{sp}' || CAST({sc} AS VARCHAR) AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, {lang} AS o_lang FROM {t}"

    return " UNION ALL ".join(branch(*b) for b in CATALOG)


ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web graph: page_id, url, href, anchor, one row for each link of a page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("a"))
    return pages.select("page_id", "url", F.regexp_extract("a", ANCHOR, 1).alias("href"), F.regexp_extract("a", ANCHOR, 2).alias("anchor"))


def anchors_sql() -> str:
    return f"SELECT page_id, url, regexp_extract(a, '{ANCHOR}', 1) AS href, regexp_extract(a, '{ANCHOR}', 2) AS anchor FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{ANCHOR}', 0)) AS a FROM pages)"
