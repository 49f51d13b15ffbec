"""Op 3: secret scans through a trigram inverted index, with DataFrame operations only.

From each rule's regular expression a Boolean query over lower-case trigrams is derived (an OR of ANDs for every
stretch of which all strings are known). The index maps each trigram of the queries to the sorted keys of the texts
that hold it, in shards of about SHARD texts; queries intersect and unite posting lists, and only candidates are
verified by the regular expression itself. A rule without a mandatory trigram scans every text. A key is a hash of
the doc_id and the text, so copies are spread like other texts; a collision only adds a candidate.

Nulls: a null text is empty and has no spans; a null doc_id is kept. Whole texts are scanned, however long; of matches
of one kind the leftmost counts, and of different kinds all do, ties at one place in the order of the rules. Repeated
rows are scanned one by one; empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_only

SHARD, MASK = 4_000, "<redacted>"
MOST = 32  # strings that one stretch of a pattern may stand for


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that group ``group`` must have
    group: int = 0
    base: bool = False


#: The base rules, as the contract gives them, and further ones of public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", r"[0-9a-f]{16,}", 16, 0, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


def _strings(node) -> set[str] | None:
    """All strings, in lower case, that a parsed node stands for; None if they are many or unknown."""
    op, arg = node
    if op == sre.LITERAL:
        return {chr(arg).lower()}
    if op == sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind == sre.LITERAL:
                out.add(chr(x).lower())
            elif kind == sre.RANGE and x[1] - x[0] < MOST:
                out.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None
        return out if len(out) <= 8 else None
    if op == sre.SUBPATTERN:
        return _all(arg[-1])
    if op == sre.BRANCH:
        parts = [_all(b) for b in arg[1]]
        return None if any(p is None for p in parts) or sum(map(len, parts)) > MOST else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        one = _all(inner) if high <= 3 else None
        return None if one is None or len(one) ** high > MOST else {"".join(x) for k in range(low, high + 1) for x in product(one, repeat=k)}
    return {""} if op == sre.AT else None


def _all(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        s = _strings(node)
        if s is None or len(out) * len(s) > MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets: every list must have a set of which the text holds all. Empty: no mandatory trigram."""

    def stretches(nodes):
        now = {""}
        for node in nodes:
            s = _strings(node)
            if s is not None and len(now) * len(s) <= MOST:
                now = {a + b for a in now for b in s}
                continue
            yield now
            now = {""}
            if s is not None:
                now = s
            elif node[0] == sre.SUBPATTERN:
                yield from stretches(node[1][-1])
            elif node[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and node[1][0] >= 1:
                yield from stretches(node[1][2])
        yield now

    out = []
    for strings in stretches(parser.parse(pattern)):
        if min(map(len, strings)) >= 3:
            out.append(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted))
    return out


def _key() -> Column:
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def postings(docs: DataFrame, trigrams: list[str], shards: int) -> DataFrame:
    """shard, index: a map from trigram to the keys of the shard's texts that hold it."""
    low = F.lower("text")
    held = F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in trigrams]), lambda t: t.isNotNull())
    rows = docs.filter("text <> ''").select(_key().alias("key"), F.explode(held).alias("trigram"))
    lists = rows.groupBy((F.pmod("key", F.lit(shards))).alias("shard"), "trigram").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return lists.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("index"))


def candidates(docs: DataFrame, rules=RULES, shard: int = SHARD) -> DataFrame:
    """key, rules: for each text that any rule with mandatory trigrams may match, the numbers of those rules."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for strings in q for s in strings for t in s})
    if not trigrams:
        return docs.sparkSession.createDataFrame([], "key long, rules array<int>")
    rows = docs.count()
    index = postings(docs, trigrams, max(1, rows // shard))
    none = F.array().cast("array<bigint>")

    def ask(query):
        literal = F.array(*[F.array(*[F.array(*map(F.lit, sorted(s))) for s in strings]) for strings in query])

        def get(t):
            return F.coalesce(F.col("index")[t], none)

        def alternative(strings):
            return F.aggregate(strings, none, lambda out, s: F.array_union(out, F.aggregate(F.slice(s, 2, 99), get(s[0]), lambda keys, t: F.array_intersect(keys, get(t)))))

        return F.aggregate(F.slice(literal, 2, 99), alternative(literal[0]), lambda keys, strings: F.array_intersect(keys, alternative(strings)))

    found = [F.struct(F.lit(i).alias("rule"), ask(q).alias("keys")) for i, q in queries.items()]
    each = index.select(F.explode(F.array(*found)).alias("f")).select("f.rule", F.explode("f.keys").alias("key"))
    return each.groupBy("key").agg(F.collect_set("rule").alias("rules"))


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches with places in code points: what splits off between matches gives the gaps."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern), F.lit(1), F.size(matches))
    none = F.array().cast(SPAN)

    def step(acc, x):
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        long = F.length(x["match"]) if rule.group == 0 else F.length(F.regexp_extract(x["match"], rule.pattern, rule.group))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("pos"), F.when(long >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    spans = F.aggregate(zipped, F.struct(F.lit(0).alias("pos"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def with_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with ``found``: an array of the spans of each rule, in the order of the rules."""
    may = candidates(docs, rules)
    d = docs.withColumn("key", _key()).join(may, "key", "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for i, r in enumerate(rules):
        spans = rule_spans(text, r, i)
        parts.append(F.when(F.array_contains("rules", F.lit(i)), spans).otherwise(F.array().cast(SPAN)) if trigram_query(r.pattern) else spans)
    return d.withColumn("found", F.array(*parts)).drop("key", "rules")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_<kind> of base rules, base_sha256 and spans of every document."""
    d = with_spans(with_only(docs, doc_id="long", text="string"), rules)
    base = [i for i, r in enumerate(rules) if r.base]
    counts = [F.size(F.col("found")[i]).cast("long").alias(f"n_{rules[i].kind}") for i in base]
    return d.select("doc_id", *counts, F.sha2(_listed(F.flatten(F.array(*[F.col("found")[i] for i in base]))), 256).alias("base_sha256"), _listed(F.flatten("found")).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mask: str = MASK) -> DataFrame:
    """The documents (with their columns) with every span, overlapping ones merged, replaced by ``mask``."""
    d = with_spans(with_only(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long"), rules)
    spans, text = F.array_sort(F.flatten("found")), F.col("text")

    def step(acc, s):
        fresh = s["start"] >= acc["pos"]
        said = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask))
        return F.struct(F.when(fresh, said).otherwise(acc["out"]).alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))

    clean = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")), step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text) + 1)))
    some = F.size(spans) > 0
    d = d.withColumn("text", F.when(some, clean).otherwise(text))
    return d.select("doc_id", "text", "lang", "source", F.when(F.col("n_chars").isNotNull() & some, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
