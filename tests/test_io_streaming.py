from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import embed as E
from tessera.operators import graph as G
from tessera.operators import walks as K
from tessera.operators import windows as N
from tessera.sources import readers as R
from tessera.sources import writers as W
from tessera.sources.kg import anchors
from tessera.streaming import link

SF = "/root/testdata/sf0.001"


def test_ntriples_round_trip(spark, tmp_path):
    (tmp_path / "in.nt").write_text('<a> <p> <b> .\n<a> <label> "x \\"y\\""@en .\n_:n <v> "1"^^<int> .\n# comment\nbroken line\n')
    t = R.ntriples(spark, str(tmp_path / "in.nt"))
    rows = sorted(tuple(r) for r in t.collect())
    assert [(r[0], r[3], r[4], r[5]) for r in rows] == [("_:n", "literal", "int", None), ("a", "literal", None, "en"), ("a", "uri", None, None)]
    assert [r["value"] for r in R.rejected(spark, str(tmp_path / "in.nt")).collect()] == ["broken line"]
    W.ntriples(t.filter("p = 'p'"), str(tmp_path / "out"))
    assert R.ntriples(spark, str(tmp_path / "out")).collect()[0]["o"] == "b"


def test_links_embeddings_walks(spark, tmp_path):
    d = spark.createDataFrame([("e1", "label", "Berlin")], "entity string, pred string, sf string")
    W.links(d, str(tmp_path / "l"))
    assert R.links(spark, str(tmp_path / "l")).collect() == d.collect()
    v = spark.createDataFrame([("e1", [1.0, 3.0])], "entity string, vec array<float>")
    W.embeddings(v, str(tmp_path / "v"))
    assert R.embeddings(spark, str(tmp_path / "v"), normalise=True).collect()[0]["vec"] == [0.25, 0.75]
    w = spark.createDataFrame([("a", ["a", "p", "b"])], "entity string, tokens array<string>")
    W.walks(w, str(tmp_path / "w"))
    assert R.walks(spark, str(tmp_path / "w")).collect() == w.collect()


def test_nif(spark):
    m = spark.createDataFrame([("urn:d#char=0,10", 2, 3, "e", 0.5)], "doc_uri string, start int, length int, uri string, confidence double")
    docs, got = R.nif(W.nif_triples(m))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in m.collect()] and docs.count() == 0


PROBE = "I have   a cat, !!that I like- playing with  "


def test_windows(spark):
    d = spark.createDataFrame([(1, PROBE), (2, ""), (3, None)], "doc_id long, text string")

    def got(mode):
        return [(r["offset"], r["text"]) for r in N.windows(d, mode).orderBy("doc_id", "offset", F.length("text")).collect()]

    assert got("single") == [(2, "have  "), (11, "cat"), (18, "that"), (25, "like"), (31, "playing"), (39, "with ")]
    assert got("bounded") == [(0, "I have"), (2, "have"), (2, "have a"), (9, "a cat"), (11, "cat"), (17, "!that"), (18, "that"), (18, "that I"), (23, "I like"), (25, "like"), (30, " playing"), (31, "playing"), (31, "playing with"), (39, "with")]
    every = got("unbounded")
    assert (0, "I have  ") in every and (0, PROBE[:-1]) in every and (2, "have   a cat") in every and set(got("multiword")) <= set(every) and len(every) == len(set(every))


def test_scalar_functions():
    assert T.number_of("twenty one") == "21" and T.number_of("two hundred and five thousand") == "205000" and T.number_of("one point five") == "1.5" and T.number_of("cat") == "cat"
    stems = {"Häuser": "hau", "gelaufen": "lauf", "Energie": "energie", "schnellen": "schnell", "Straßen": "strass", "Zeitungen": "zeitung", "laufend": "lauf", "tanzend": "tanz", "Bett": "bett", "3,5": "3,5", "Au!": "au"}
    assert {w: T.german_stem_of(w) for w in stems} == stems


def test_ngrams(spark):
    assert spark.createDataFrame([("Cat",)], "x string").select(T.ngrams(F.col("x"))).first()[0] == ["$$c", "$ca", "cat", "at$", "t$$"]


def test_similarity(spark):
    d = spark.createDataFrame([([5.0, 10.0], [2.0, 5.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, -1.0], [1.0, -1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in d.select(E.similarity(F.col("a"), F.col("b"))).collect()] == [0.996546, 0.0, 1.0]


def test_pagerank_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert all(abs(r["pr"] - 1) < 1e-9 for r in G.pagerank(e, 5, start=1.0).collect())


def test_hill_climb_finds_planted_choice(spark):
    good, bad = [1.0, 0.0], [0.0, 1.0]
    c = spark.createDataFrame([(1, sf, sf * 10 + k, good if k == 0 else [0.6 * (-1) ** sf, 0.8] if k == 1 else bad) for sf in range(4) for k in range(2)], "doc_id long, sf long, entity long, vec array<double>")
    got = {r["sf"]: r["entity"] for r in E.hill_climb(c, repeats=10).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert E.hill_climb(c.filter("sf = 0"), repeats=2).collect() == []


def test_stream_link(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "in"))
    d = anchors(spark, SF).groupBy(F.col("anchor").alias("sf"), F.col("href").alias("entity")).agg(F.count("*").alias("n")).cache()
    link.start(link.read(spark, str(tmp_path / "in"), 1), d, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = link.linked(spark.read.parquet(f"{SF}/documents.parquet"), d)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.count() > 0 and got.exceptAll(batch).isEmpty()


def test_annotations_and_offline_pages(spark, tmp_path):
    one = '{"Resources": [{"@URI": "u", "@surfaceForm": "a", "@offset": "3", "@similarityScore": "0.5"}, {"@URI": "u", "@surfaceForm": "b", "@offset": "9", "@similarityScore": "1"}]}'
    a = R.annotations(spark.createDataFrame([(1, one), (2, "{}"), (3, None), (4, "no json")], "doc_id long, json string"))
    assert [tuple(r) for r in a.collect()] == [(1, "u", "b", 9, 1.0)]
    (tmp_path / "x.html").write_text("<p>a\nb</p>")
    (tmp_path / "y.html").write_text("y")
    p = R.offline_pages(spark, str(tmp_path), spark.createDataFrame([("x.html", "http://x/")], "file string, url string"))
    assert [tuple(r) for r in p.collect()] == [("http://x/", "<p>a\nb</p>")]


def test_span_faults(spark):
    d = spark.createDataFrame([("ab cd", 0, 2), ("ab cd", 1, 2), ("ab cd", 2, 2), ("", 0, 3), (None, 0, 1), ("é😀 x", 1, 1)], "t string, s int, n int")
    got = [r[0] for r in d.select(T.span_faults(F.col("t"), F.col("s"), F.col("n"))).collect()]
    assert got == [[], ["letter_before", "space_last", "letter_after"], ["space_first", "letter_before", "letter_after"], [], [], ["letter_before"]]


def test_walks_by_share(spark):
    """A hub of 300 neighbours that each have one more: shares, the least and the most hold for each entity and depth."""
    t = spark.createDataFrame([("h", "p", f"n{i}", "uri") for i in range(300)] + [(f"n{i}", "q", "e", "uri") for i in range(300)] + [("h", "label", "a->b\tc", "literal")], "s string, p string, o string, o_kind string")
    w = K.walks(t, 6).persist()
    assert {(r["depth"], r["count"]) for r in w.groupBy("depth").count().collect()} == {(1, 600), (2, 300)}
    hub = K.sampled(w, (1.0, 0.1), least=50, most=200).filter("entity = 'h'").groupBy("depth").count()
    assert {(r["depth"], r["count"]) for r in hub.collect()} == {(1, 200), (2, 50)}
    assert K.sampled(w, (1.0, 0.1), least=0).filter("depth = 2").count() in range(10, 60) and K.picked(w, 7).filter("entity = 'h'").count() == 14
    assert [r["walk"] for r in K.direct(t).filter("walk like '%label%'").collect()] == ["h->label->ab c"] and K.direct(t, literals=False).count() == 600
