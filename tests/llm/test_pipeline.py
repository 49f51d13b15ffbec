from collections import Counter

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, f in P.STAGES[:-1]:
        docs = P.stored(f(spark, docs, SF)).cache()
        assert docs.columns == columns and 0.5 * n < docs.count() <= n, name
    from tessera.llm import fmindex, jaccard, secrets

    assert secrets.scan(docs).filter("spans <> ''").isEmpty()
    assert fmindex.scan(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").isEmpty()
    links = jaccard.link(docs)
    assert links.select("component_id").distinct().count() >= 0.98 * docs.count()
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.select("doc_id").collect())
