"""The queries of this subpackage: one thin ``opN_<name>`` for each operator, over whole tables."""

from __future__ import annotations

from . import fmindex, jaccard, language, packing, quality, rans, secrets, toxicity, urls, wrappers
from .common import table


def op1_wrappers(spark, sf_dir):
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op2_langid(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op3_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_rans(spark, sf_dir):
    return rans.round_trip(table(spark, sf_dir, "documents"))


def op6_fmindex(spark, sf_dir):
    d = fmindex.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.drop("spans", "items")


def op7_outliers(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_jaccard(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_wrappers, op2_langid, op3_secrets, op4_toxicity, op5_rans, op6_fmindex, op7_outliers, op8_pack, op9_urls, op10_jaccard)}


def _op9_sql() -> str:
    """The same rules and terms, each term as a regular expression with its boundaries."""
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))]

    def has(term):
        return rf"CAST(regexp_matches(t, '(^|[^\pL\pN]){term}([^\pL\pN]|$)') AS INTEGER)"

    strict, soft = (" + ".join(map(has, terms)) for terms in (urls.STRICT, urls.SOFT))
    weight = " + ".join(f"{w} * {has(t)}" for t, w in (urls.STRICT | urls.SOFT).items())
    rule, said = (" ".join(f"WHEN {f} THEN '{x}'" for f, *rest in fits for x in [rest[k]]) for k in (0, 1))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, lower(rest) AS t, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    w AS (SELECT *, {strict} AS n_strict, {soft} AS n_soft, round(CAST({weight} AS DOUBLE), 6) AS weight FROM u)
    SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {said} WHEN weight >= {urls.LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft, weight FROM w"""


ORACLES: dict[str, str] = {"op9_urls": _op9_sql()}
