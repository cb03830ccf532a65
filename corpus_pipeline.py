"""From raw documents to token ids: the stages of a training-data pipeline, each by an operator of ``brightloom.llm``.

``run`` applies STAGES in order to the table ``documents``; each stage's rows are written to the shared folder as
Parquet and read again by the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import bpe, minhash, mixing, secret_scan, toxicity
from brightloom.llm.workspace import Workspace, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the rest stay as they are.

    Null, empty and very long texts are judged whole, repeated rows alike, rows without a doc_id too; without labels
    nothing goes. An empty table gives an empty result; extra columns pass whatever their names."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least doc_id.

    Texts without words and rows without a doc_id all stay. Of rows that share a doc_id one stays, the first by a hash
    of its columns. Very long texts are compared whole, an empty table gives an empty result, extra columns pass."""
    return minhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay.

    Null and empty texts stay as they are, very long ones are read whole, repeated rows are treated alike; an empty
    table gives an empty result; extra columns pass whatever their names."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as its source's target weight asks for, or left out.

    A null source is a source. Rows without words are not taken; repeated rows are taken together; an empty table, or
    one without words, gives an empty result; extra columns pass whatever their names."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded text of each row.

    A null text counts as empty and has no tokens; repeated rows stay repeated, a null doc_id stays null, very long texts are
    encoded whole, other columns are ignored; an empty table gives an empty result."""
    from public_tokenizers import path

    return bpe.digests(docs, path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encode", encode),
]

#: No stage's rows can be told in SQL: the tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with scope():  # a stage's tables and broadcasts go when its rows are written
            docs = work.save(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            work.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
