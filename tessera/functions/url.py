"""Filters on names and urls, rewriting, numbering of lines, tagging by rule, and triples from columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def any_of(c: Column, parts) -> Column:
    return reduce(Column.__or__, [c.contains(p) for p in parts], F.lit(False))


def without_any(d: DataFrame, column: str, parts) -> DataFrame:
    return d.filter(~any_of(F.col(column), parts))


def with_any(d: DataFrame, column: str, parts) -> DataFrame:
    """Rows whose column holds any of the parts, whatever their case."""
    return d.filter(any_of(F.lower(column), [p.lower() for p in parts]))


def in_domain(candidates: DataFrame, types: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates (entity) without a type, or with an allowed one. types: entity, type."""
    t = without_any(types, "type", ("wordnet", "wikicategory"))
    good = t.join(allowed, "type", "left_semi").select("entity").distinct().withColumn("good", F.lit(True))
    seen = t.select("entity").distinct().withColumn("typed", F.lit(True))
    return candidates.join(seen, "entity", "left").join(good, "entity", "left").filter("typed is null or good").select("entity")


#: Ordered literal replacements from a page's url to its IRI, and the suffix.
REPLACED, SUFFIX = (("https://", "http://"), ("www.", ""), ("m.", "")), "#id"


def _replaced(url: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), REPLACED, url)


def to_iri(url: Column) -> Column:
    out = _replaced(url)
    return F.when(url.endswith(SUFFIX), out).otherwise(F.concat(out, F.lit(SUFFIX)))


def from_iri(iri: Column) -> Column:
    return F.replace(F.replace(iri, F.lit(SUFFIX), F.lit("")), F.lit("http://"), F.lit("https://www."))


def rewritten(url: Column) -> Column:
    """Whether the IRI differs by more than the suffix."""
    return _replaced(url) != url


def valid(url: Column) -> Column:
    return url.rlike(r"^(https?|ftp)://[A-Za-z0-9.-]+(/\S*)?$")


def occurrences(text: Column, part: str) -> Column:
    """Places, from 1, of a substring, overlapping ones too: what a look-ahead splits off, added up."""
    n = F.length(text) - (len(part) - 1)
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, len(part)) == part)


def numbered(d: DataFrame, order: str, name: str) -> DataFrame:
    """d with numbers from 1 in a total order: sorted ranges, and the number of rows in those before."""
    n = max(1, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    t = stored(d.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()))
    t = t.withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = t.groupBy("_p").count()  # one row a range
    before = sizes.withColumn("_b", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).select("_p", "_b")
    return t.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_r") + 1).drop("_m", "_p", "_r", "_b")


#: Rules of the default tagger: pattern of a word, tag; the first that fits counts.
TAGS = ((r"(ing|ed)$", "VBG"), (r"^(the|and|of|to|der|die|que)$", "IN"), (r"s$", "NNS"))


def tagged(words: Column, rules=TAGS, other: str = "NN") -> Column:
    """array<struct<word,tag>>."""

    def tag(w):
        out = F.lit(other)
        for pattern, name in reversed(rules):
            out = F.when(w.rlike(pattern), name).otherwise(out)
        return out

    return F.transform(words, lambda w: F.struct(w.alias("word"), tag(w).alias("tag")))


def expanded(rules: dict[str, str], name: str) -> str:
    """The pattern of a rule, in which ``;@other@;`` stands for another one."""
    return re.sub(r";@(\w+)@;", lambda m: f"(?:{expanded(rules, m[1])})", rules[name])


def phrases(tags: Column, rules: dict[str, str], name: str) -> Column:
    """All stretches of ``word/TAG`` text that a rule matches."""
    text = F.array_join(F.transform(tags, lambda t: F.concat_ws("/", t["word"], t["tag"])), " ")
    return F.regexp_extract_all(text, F.lit(expanded(rules, name)), F.lit(0))


def head(tags: Column, priority: tuple[str, ...] = ("NNS", "NN", "VBG")) -> Column:
    """The last word of the first tag, by priority, that a phrase has."""
    return F.coalesce(*[F.try_element_at(F.filter(tags, lambda t, p=p: t["tag"] == p), F.lit(-1))["word"] for p in priority])


def split_at(phrase: Column, sentence: Column, delimiter: str, template: str, goes: str = "none") -> Column:
    """A phrase cut at a delimiter word if the sentence matches the template (``{}``: the phrase); the delimiter goes
    to the next part, to the previous, or to none."""
    d = {"next": f" (?={delimiter} )", "previous": f"(?<= {delimiter}) ", "none": f" {delimiter} "}[goes]
    before, after = (re.escape(x) for x in template.split("{}"))
    fits = sentence.rlike(before) & F.contains(sentence, F.concat(F.lit(template.split("{}")[0]), phrase, F.lit(template.split("{}")[1]))) if before or after else F.lit(True)
    return F.when(fits, F.split(phrase, d)).otherwise(F.array(phrase))


def column_triples(d: DataFrame, subject: Column, columns: list[str]) -> DataFrame:
    """s, p, o: one statement a row; several columns make one predicate, joined by underscores, and one literal."""
    return d.select(subject.alias("s"), F.lit("_".join(columns)).alias("p"), F.concat_ws(" ", *columns).alias("o"))
