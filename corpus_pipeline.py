"""From documents to packed training pieces: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of docs. Their decisions:

1. quality: documents that the classifier scores below queries.LEAST_QUALITY go.
2. near_duplicates: of each group of linked documents the one with the smallest id stays. A null id links with nothing and stays.
3. secrets: every found secret is replaced in its text, and n_chars counted anew; no document goes.
4. mix: a document is repeated as often as the mix of sources takes it, which may be never.
5. packing: texts become pieces of binary lengths, one row per piece with its ids; a repeated document has pieces for each copy.

A null text is empty. Extra columns travel along, whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard_join, mixing, packing, quality, queries, secret_scan
from tidemark.llm.shared import dropped, prepared, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.score(docs, queries.quality_model(docs, labels))
    return rows.filter(rows["score"] >= queries.LEAST_QUALITY).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    groups = jaccard_join.similar_components(docs)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return secret_scan.mask_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return packing.binary_pieces(docs, queries.WORD_VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("packing", pack),
]

#: The classifier, the mix and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage on the table documents. Each stage's rows are written to the shared folder and read again."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES, 1):
        rows = stage(spark, docs, sf_dir)
        if place == len(STAGES):
            return rows
        rows = stored(rows)
        if place > 1:
            dropped(docs)
        docs = rows
    return docs
