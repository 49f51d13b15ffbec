"""Op 9: URL filter: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

The whole url after its scheme is read, query and fragment included, in lower case. A term counts only between
boundaries (ends of the url, or characters that are neither letters nor digits), and once however often it is there.
The weights of the different terms add up, and a url of LIMIT or more is rejected: a strict term weighs that much by
itself, a soft one 0.7 of it, or 0.34 where it is common in good urls too: it takes two soft terms, or three common ones.

Nulls: a null url, and one without ``://``, has an empty host and path, no rule, no terms, and is allowed. Repeated
rows are judged one by one; among rules that fit, the longest host and path together wins, then the one listed first;
urls of any length are read whole; empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, with_only

#: (host, path, verdict): fixed values of the contract.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LIMIT = 1.0
#: The vocabulary, in English, French, German and Spanish: explicit content, gambling, malware, illegal copies and drugs;
#: then what advertising, betting, dating, credit and trackers call themselves.
STRICT = dict.fromkeys("porn porno pornografie pornographie pornografia xxx hentai milf escort escorts camgirl camgirls casino casinos-online spielcasino malware phishing ransomware keylogger warez crackz serialz viagra cialis".split(), 1.0)
SOFT = dict.fromkeys("bet bets betting wetten wette paris-sportifs apuestas poker roulette slots jackpot nude nudes nackt nue desnuda sex sexe sexo dating rencontre citas loan loans kredit prestamo credito pills pillen pastillas torrent torrents crack keygen spam adult adultes erwachsene adulto".split(), 0.7)
SOFT |= dict.fromkeys("ad ads advert werbung anuncio popup click clickbait track tracker cheap billig barato free kostenlos gratis gratuit win gewinn gagner ganar deal deals promo affiliate farm".split(), 0.34)


@dataclass(frozen=True)
class Vocabulary:
    strict: dict
    soft: dict
    limit: float = LIMIT


def split_url(url: str = "url"):
    """(host, path) columns: the host lower-cased, both empty without a ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def automaton(v: Vocabulary):
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, terms in (("strict", v.strict), ("soft", v.soft)):
        for term, weight in terms.items():
            a.add_word(term, (term, kind, weight))
    a.make_automaton()
    return a


def hits(a, text: str) -> tuple[int, int, float]:
    """(different strict terms, different soft terms, weight of both) at boundaries."""
    found: dict[str, tuple[str, float]] = {}
    for end, (term, kind, weight) in a.iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        found[term] = (kind, weight)
    n = sum(kind == "strict" for kind, _ in found.values())
    return n, len(found) - n, round(sum(w for _, w in found.values()), 6)


def judge(pages: DataFrame, rules=RULES, vocabulary: Vocabulary = Vocabulary(STRICT, SOFT)) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft, weight of every url."""

    def make():
        a = automaton(vocabulary)

        def kernel(c):
            found = [hits(a, x.partition("://")[2].lower()) if x else (0, 0, 0.0) for x in c["url"]]
            yield {k: c[k] for k in ("page_id", "host", "path")} | {"n_strict": [x[0] for x in found], "n_soft": [x[1] for x in found], "weight": [x[2] for x in found]}

        return kernel

    host, path = split_url()
    parts = with_only(pages, page_id="long", url="string").select("page_id", "url", host.alias("host"), path.alias("path"))
    counted = map_batches(parts, make, "page_id long, host string, path string, n_strict int, n_soft int, weight double", text="url")
    #: The longest rule wins: by the length of host and path together, then as listed.
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p) for h, p, _ in order]
    rule = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, order)], F.lit(None).cast("string"))
    said = F.coalesce(*[F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, order)], F.lit(None).cast("string"))
    own = F.when(F.col("weight") >= vocabulary.limit, "block").otherwise("allow")
    return counted.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "n_strict", "n_soft", "weight")
