"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest

from tessera.llm import fmindex, jaccard, language, packing, quality, rans, secrets, toxicity, urls, wrappers

LONG = "lorem ipsum dolor sit amet " * 40_000
ROWS = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "  \n\t ", None, "s", 5), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7), (5, "123 !?", "de", "s", 6), (6, "Der Hund und die Katze sind im Haus", "de", "s", 9), (7, "the dog and the cat are in the house", "en", "s", 9), (8, LONG, "en", "s", len(LONG)), (9, "👍 ünï\x00code ́   x", "fr", "t", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
EXTRA = "n long, ids string, key string, found string, sig long, hub long, host string, v string, count long, prefix string"


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    rows = ROWS if request.param == "rows" else []
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], f"{SCHEMA}, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (None, "the dog"), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (4, 1, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


@pytest.mark.parametrize("name", ["language", "secrets", "toxicity", "rans", "fmindex", "quality", "jaccard"])
def test_one_row_a_document(docs, bench, labels, name):
    got = {
        "language": lambda: language.identify(docs), "secrets": lambda: secrets.scan(docs), "toxicity": lambda: toxicity.score(docs, labels), "rans": lambda: rans.round_trip(docs),
        "fmindex": lambda: fmindex.scan(docs, bench), "quality": lambda: quality.judge(docs), "jaccard": lambda: jaccard.link(docs),
    }[name]()
    got = got.cache()
    assert ids(got) == ids(docs)
    if docs.isEmpty():
        return
    by = {r["doc_id"]: r for r in got.collect()}
    if name == "language":
        assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (None, 1, 2, 3, 5))
    if name == "jaccard":
        assert [by[k]["n_shingles"] for k in (None, 1, 3, 4)] == [0, 0, 0, 1] and by[4]["component_id"] == 4 and by[2]["component_id"] == 2
    if name == "fmindex":
        assert by[4]["n_items"] == 1 and by[7]["n_hit"] == 2 and not by[1]["contaminated"]
    if name == "quality":
        assert by[1]["base_failed"] and by[8]["n_words"] == 200_000 and by[8]["n_repeat_words"] == 200_000
    if name == "rans":
        assert [by[k]["n_tokens"] for k in (1, 2, 3)] == [1, 1, 1]


def test_packing(docs):
    rows = packing.pack(docs).collect()
    assert ids(docs) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["piece"] == 0)
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= 1024 for v in fill.values())


def test_stages_keep_columns(docs, bench):
    for f in (language.keep_identified, jaccard.keep_one, secrets.redact, lambda d: fmindex.remove(d, bench)):
        out = f(docs)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.collect()


def test_pages(spark):
    rows = [(1, None, None), (2, "http://a.b/c", ""), (3, "no scheme", "<p>x"), (3, "no scheme", "<p>x"), (4, "https://X.example.com/en/7?q#f", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (None, "://", "<div><div><b>y</div>")]
    p = spark.createDataFrame([(*r, "", "") for r in rows], "page_id long, url string, html string, wrapper string, path string")
    t = {r["page_id"]: r for r in wrappers.main_text(p).collect()}
    assert t[1]["text"] == "" and t[3]["text"] == "x" and t[4]["n_chars"] == 20_000 * 5 - 1
    u = {r["page_id"]: r for r in urls.judge(p).collect()}
    assert (u[1]["host"], u[1]["path"], u[1]["verdict"]) == ("", "", "allow") and u[4]["rule"] == "example.com/en/7" and u[4]["host"] == "x.example.com"
    none = p.limit(0)
    assert wrappers.main_text(none).collect() == [] and urls.judge(none).collect() == []
