"""Documents made ready for training: toxic ones out, one of each group of near duplicates, none with
benchmark passages, personal data masked, and the rest as byte-level BPE tokens.

Nulls in any column, empty and very long texts, repeated rows and empty tables are taken by every stage;
what each does with them is said there. Columns besides doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import bpe, decontam, jaccard, pii, toxicity
from keystrata.llm.idfilter import mark_likely
from keystrata.llm.names import fresh_name
from keystrata.llm.queries import remainder, table
from keystrata.runtime import materialize

TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_FROM; null and empty texts have no evidence and stay unless most labels are toxic.
    A model that learnt no n-gram tells nothing apart and rejects nothing."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=remainder(5) != 0)
    if not model.weights.any():
        return docs
    score = fresh_name(docs, "score")
    return toxicity.score_documents(docs, model, into=score).where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group. Texts without words are no duplicates.

    Rows that share an id are one document: all of them stay or go, but of those with equal texts one
    stays. A row without an id is in nobody's group; of such rows with equal texts one stays. Texts
    of documents that cannot be among the dropped ones stay where they are; only the others are shuffled
    to be told apart.
    """
    groups = materialize(jaccard.jaccard_components(docs), "groups")
    dropped = groups.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    flag = fresh_name(docs, "doubtful")
    marked = mark_likely(docs, materialize(dropped.union(repeated).distinct(), "doubtful"), "doc_id", flag)
    doubtful = marked.where(F.col(flag)).join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return marked.where(~F.col(flag)).unionByName(doubtful).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of 10 words of a benchmark item (of all its words, if it has fewer)."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind, and n_chars of the new text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and token ids of every document."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("personal_data", mask_personal_data), ("tokens", encode)]

#: The toxicity stage learns its model, which SQL cannot express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
