"""Sinks: what the readers read, and exports of mentions and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import LINK_DELIMITER, RESULT_DELIMITER, WALK_DELIMITER


def _lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def results(df: DataFrame, path: str) -> None:
    _lines(df, F.concat_ws(RESULT_DELIMITER, *df.columns), path)


def links(df: DataFrame, path: str) -> None:
    _lines(df, F.concat_ws(LINK_DELIMITER, *[c for c in ("entity", "pred", "sf") if c in df.columns]), path)


def triple_line() -> Column:
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise(""))

    def node(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.regexp_replace(c, r"[<>\"\s]", "_"), F.lit(">")))

    return F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), F.when(F.col("o_kind") == "literal", quoted).otherwise(node("o")), F.lit(" ."))


def ntriples(df: DataFrame, path: str) -> None:
    _lines(df, triple_line(), path)


def subject_object(df: DataFrame, path: str) -> None:
    df.select("s", "o").write.csv(path, sep=";")


def ranks(df: DataFrame, path: str, form: str = "tsv") -> None:
    score = F.format_string("%.10f", F.col("pr"))
    _lines(df, F.concat_ws("\t", "id", score) if form == "tsv" else F.concat(F.lit("<"), "id", F.lit('> <http://purl.org/voc/vrank#pagerank> "'), score, F.lit('"^^<http://www.w3.org/2001/XMLSchema#float> .')), path)


def embeddings(df: DataFrame, path: str) -> None:
    _lines(df, F.concat_ws("\t", "entity", F.array_join(F.col("vec").cast("array<string>"), "\t")), path)


def walks(df: DataFrame, path: str) -> None:
    _lines(df, F.array_join("tokens", WALK_DELIMITER), path)


def id_mapping(df: DataFrame, path: str) -> None:
    _lines(df, F.concat_ws("\t", "key", "value"), path)


def grouped_lines(df: DataFrame, key: str, line: str) -> DataFrame:
    """value: one line a key, its lines sorted and joined by tabs."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(line)), "\t").alias("_l")).select(F.concat_ws("\t", key, "_l").alias("value"))


def concatenated(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def mentions_xml(df: DataFrame) -> DataFrame:
    """value: one element a mention (start, length, sf, entity, score)."""
    def esc(c: str) -> Column:
        return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    return df.select(F.concat(F.lit('<mention start="'), "start", F.lit('" length="'), "length", F.lit('" score="'), "score", F.lit('" entity="'), esc("entity"), F.lit('">'), esc("sf"), F.lit("</mention>")).alias("value"))


def hyperlinked(df: DataFrame) -> DataFrame:
    """doc_id, html: the text with each marking (start, length, uri; without overlaps) as a link. df: doc_id, text, markings."""
    s = F.array_sort("markings")

    def step(a, m):
        text = F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, m["start"] - a["pos"]), F.lit('<a href="'), m["uri"], F.lit('">'), F.substring(F.col("text"), m["start"] + 1, m["length"]), F.lit("</a>"))
        return F.struct(text.alias("out"), (m["start"] + m["length"]).alias("pos"))

    html = F.aggregate(s, F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["pos"] + 1, F.length("text") + 1)))
    return df.select("doc_id", html.alias("html"))


def nif_triples(markings: DataFrame) -> DataFrame:
    """s, p, o, o_kind, o_datatype, o_lang of markings (doc_uri, start, length, uri, confidence)."""
    nif, its = "http://persistence.uni-leipzig.org/nlp2rdf/ontologies/nif-core#", "http://www.w3.org/2005/11/its/rdf#"
    s = F.concat(F.regexp_replace("doc_uri", "#.*$", ""), F.lit("#char="), "start", F.lit(","), F.col("start") + F.col("length"))
    rows = [(nif + "referenceContext", F.col("doc_uri"), "uri"), (nif + "beginIndex", F.col("start").cast("string"), "literal"), (nif + "endIndex", (F.col("start") + F.col("length")).cast("string"), "literal"), (its + "taIdentRef", F.col("uri"), "uri"), (its + "taConfidence", F.col("confidence").cast("string"), "literal")]
    x = markings.select(s.alias("s"), F.explode(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind")) for p, o, k in rows])).alias("t"))
    none = F.lit(None).cast("string")
    return x.select("s", "t.p", "t.o", "t.o_kind", none.alias("o_datatype"), none.alias("o_lang")).filter("o is not null")


def latex_matrix(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """value: a LaTeX line for each row, the best of it in bold."""
    p = df.groupBy(row).pivot(column, columns).agg(F.max(value))
    best = F.greatest(*[F.col(f"`{c}`") for c in columns]) if len(columns) > 1 else F.col(f"`{columns[0]}`")
    cells = [F.when(F.col(f"`{c}`").isNull(), "-").when(F.col(f"`{c}`") == best, F.concat(F.lit("\\textbf{"), F.format_string("%.3f", F.col(f"`{c}`")), F.lit("}"))).otherwise(F.format_string("%.3f", F.col(f"`{c}`"))) for c in columns]
    return p.select(F.concat(F.concat_ws(" & ", row, *cells), F.lit(" \\\\")).alias("value"))
