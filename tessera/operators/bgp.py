"""Basic graph patterns: triple patterns compiled to joins over a triples DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def is_var(term: str | None) -> bool:
    return term is not None and term.startswith("?")


def match_one(triples: DataFrame, pattern: tuple) -> DataFrame:
    """Bindings of one pattern: constants filter at the scan, None is a wild card, a repeated variable is an equality.
    triples: a DataFrame, or a source that scans with what a pattern binds."""
    d, first = triples, {}
    if not isinstance(triples, DataFrame):
        d = triples.scan(*[None if term is None or is_var(term) else term for term in pattern])
    for column, term in zip("spo", pattern):
        if term is None:
            continue
        if is_var(term):
            if term in first:
                d = d.filter(F.col(column) == F.col(first[term]))
            first.setdefault(term, column)
        else:
            d = d.filter(F.col(column) == term)
    return d.select(*[F.col(c).alias(v[1:]) for v, c in first.items()])


def match(triples: DataFrame, patterns: list[tuple]) -> DataFrame:
    """All bindings of a conjunction of patterns, joined on shared variables: those that bind most first, then those
    that stay connected. Patterns that share no variable are an error, not a product."""
    left = sorted(patterns, key=lambda p: sum(t is None or is_var(t) for t in p))
    out, names = match_one(triples, left[0]), set(filter(is_var, left.pop(0)))
    while left:
        nxt = next((p for p in left if names & set(filter(is_var, p))), None)
        if nxt is None:
            raise ValueError(f"patterns {left} share no variable with the others")
        left.remove(nxt)
        shared = [v[1:] for v in dict.fromkeys(filter(is_var, nxt)) if v in names]
        d = match_one(triples, nxt)
        out = out.join(d, shared)
        names |= set(filter(is_var, nxt))
    return out


def select(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Statements that fit; None fits all."""
    conditions = [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    return triples.filter(reduce(Column.__and__, conditions)) if conditions else triples


def chain(triples: DataFrame, depth: int, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """s, p0, o0, ... over ``depth`` hops; blacklisted predicates fail on every hop, literals only as the last object."""
    hop = triples.filter(~F.col("p").isin(*blacklist)) if blacklist else triples
    out = None
    for k in range(depth):
        h = hop.filter("o_kind <> 'literal'") if k == depth - 1 else hop
        h = h.select(F.col("s").alias("s" if k == 0 else f"o{k - 1}"), F.col("p").alias(f"p{k}"), F.col("o").alias(f"o{k}"))
        out = h if out is None else out.join(h, f"o{k - 1}")
    return out.select("s", *[f"{c}{k}" for k in range(depth) for c in ("p", "o")])


def left_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """All statements of a, and whether b has them."""
    return a.join(b.select("s", "p", "o").distinct().withColumn("in_other", F.lit(True)), ["s", "p", "o"], "left").withColumn("in_other", F.coalesce("in_other", F.lit(False)))


def add(triples: DataFrame, more: DataFrame) -> DataFrame:
    return triples.unionByName(more, allowMissingColumns=True).dropDuplicates(["s", "p", "o"])


def remove(triples: DataFrame, less: DataFrame) -> DataFrame:
    return triples.join(less.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def rendered(solutions: DataFrame, columns: list[str], sep: str = "\t") -> DataFrame:
    """line: the columns of each solution in the order asked for; a variable without a value is empty."""
    return solutions.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))


def batch(triples, queries: dict[str, list[tuple]], columns: list[str]) -> DataFrame:
    """name and columns: the solutions of each named query. ``write(df.filter(name), path)`` gives a file for each."""
    return reduce(DataFrame.unionByName, [match(triples, q).select(F.lit(name).alias("name"), *columns) for name, q in queries.items()])


def literal_search(triples: DataFrame, queries: DataFrame, most: int = 100) -> DataFrame:
    """id, s, o: of each query (id, text) the ``most`` shortest literals with all its words (an inverted-index join that
    counts), the statements of an IRI, or those whose object ends in exactly its number."""

    def words(c):
        return F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z]+")), lambda t: t != "")

    t = triples.select("s", "o")
    iri, number = F.col("text").contains(":"), F.col("text").rlike("^[0-9]+$")
    asked = queries.filter(~iri & ~number).select("id", F.size(words("text")).alias("n"), F.explode(words("text")).alias("w"))
    index = t.select("s", "o", F.explode(words("o")).alias("w"))
    by_words = index.join(F.broadcast(asked), "w").groupBy("id", "n", "s", "o").agg(F.count("*").alias("k")).filter("k = n").select("id", "s", "o")
    by_iri = t.join(F.broadcast(queries.filter(iri)), F.col("s") == F.col("text")).select("id", "s", "o")
    by_number = t.join(F.broadcast(queries.filter(number)), F.regexp_extract("o", "([0-9]+)$", 1) == F.col("text")).select("id", "s", "o")
    w = Window.partitionBy("id").orderBy(F.length("o"), "s")
    return by_words.unionByName(by_iri).unionByName(by_number).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def inferred(types: DataFrame, subclass: DataFrame) -> DataFrame:
    """s, type: all types that follow from subclass statements (sub, super), until no new one does."""
    all_ = new = stored(types.select("s", "type").distinct())
    while not new.isEmpty():
        more = new.join(F.broadcast(subclass), F.col("type") == F.col("sub")).select("s", F.col("super").alias("type")).distinct()
        new = stored(more.join(all_, ["s", "type"], "left_anti"))
        all_ = all_.unionByName(new)
    return all_
