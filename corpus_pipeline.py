"""A training corpus from raw documents, in five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return doc_id, text, lang, source, n_chars, the columns of documents; any further
column of the input, whatever its name, is left out by the first stage.

1. language: documents without an identified language go; so do null and empty texts, which have none.
2. near_duplicates: of each component of near duplicates the document of the least id stays; rows of a null id stay.
3. decontaminate: passages of the benchmark are cut out; a document of which nothing is left goes.
4. secrets: secrets in the texts are masked.
5. pack: the remaining documents are packed into sequences of token ids.

Nulls in lang, source and n_chars are kept; n_chars follows a text that changes, if it is not null. Texts are taken
whole by every stage, however long. Repeated rows of one doc_id stay together in every stage and are packed one by
one. Ties (languages, copies, equal lengths) go by name, by the least id, and by the order of tasks. An empty table
gives an empty result in each stage; without any labelled text, or on a table of nothing but nulls, stage 1 keeps
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import fmindex, jaccard, language, packing, secrets
from tessera.llm.common import stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fmindex.remove(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", identified),
    ("near_duplicates", first_of_near_duplicates),
    ("decontaminate", decontaminated),
    ("secrets", without_secrets),
    ("pack", packed),
]

#: Language models, signatures and the packing search have no SQL form; the result is tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
