"""The linker's shortcuts, against the long way."""

from tessera.operators import link as L
from tessera.operators import windows as W


def test_known_words_drop_no_mention(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The Ist, der IST und ist-da; ÉA Éa Σας ΣΑΣ İx"), (2, None), (3, "no form here " * 50), (None, "ist")], "doc_id long, text string")
    forms = spark.createDataFrame([("Ist", "e1"), ("ist da", "e2"), ("éa", "e3"), ("σας", "e4"), ("a-b", "e5"), ("i̇x", "e6")], "sf string, entity string")
    with_ = sorted(map(repr, L.detected(docs, forms).collect()))
    monkeypatch.setattr(L, "KNOWN", 0)
    assert with_ == sorted(map(repr, L.detected(docs, forms).collect())) and len(with_) > 5
    assert W.windows(docs, known=["ist"]).filter("doc_id = 3").count() == 0 < W.windows(docs).filter("doc_id = 3").count()


def test_documents_are_detected_once(spark):
    docs = spark.createDataFrame([(k, "Ist der Hof") for k in range(20)], "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    forms = spark.createDataFrame([("Ist", "e1"), ("hof", "e2")], "sf string, entity string")
    ranks = spark.createDataFrame([("e1", 4.0), ("e2", 4.0)], "id string, pr double")
    vectors = spark.createDataFrame([("e1", [1.0, 0.0]), ("e2", [1.0, 1.0])], "key string, vec array<double>")
    got = L.link(docs.mapInArrow(count, docs.schema), forms, ranks, vectors).collect()
    assert {(r["sf"], r["entity"]) for r in got} == {("Ist", "e1"), ("hof", "e2")} and len({r["doc_id"] for r in got}) == 20
    assert seen.value == 20


def test_choice_of_many_documents_in_a_group(spark, monkeypatch):
    rows = [(d, f"f{i}", f"e{i}{j}", [float(d % 3 + 1), float(i), float(j * d % 5)]) for d in range(40) for i in range(d % 4 + 1) for j in range(3)]
    c = spark.createDataFrame([*rows, (None, "f", "e", None), (99, "f", "e", None)], "doc_id long, sf string, entity string, vec array<double>")
    some = sorted(map(tuple, L.collective(c).collect()))
    monkeypatch.setattr(L, "GROUPS", 1)
    assert some == sorted(map(tuple, L.collective(c).collect())) and len({r[0] for r in some}) == 30
