"""Documents to mixed, encoded training text: five stages, each a written table.

Quality rules drop documents, one of each group of near-duplicates stays, secrets are
replaced, sources are repeated to their targets, and what results is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, mixing, neardup, quality, secret_scan
from corpusloom.llm.text import documents, without
from corpusloom.session import cut

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep.

    Null and empty texts fail the rules and go, with a null id too. Each row is judged by
    its own text: of rows that repeat an id only the bad ones go, rows alike go or stay
    together. An empty table stays empty; other columns pass through.
    """
    return without(docs, quality.quality_rules(docs).where(~F.col("kept")).select("doc_id", "row"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null and empty texts and rows without an id are in no group and stay. Of rows that
    repeat an id each goes by its own text; rows alike in id and text are one document and
    stay as they are. An empty table stays empty; other columns pass through.
    """
    return without(docs, neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id", "row"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced.

    A null text stays null. Rows that repeat an id are searched each in its own text. An
    empty table stays empty; ``n_chars`` follows the text, other columns pass through.
    """
    return secret_scan.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source of its own. Empty texts have size 0 and are taken at their
    source's rate; rows that repeat an id are drawn alike. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of token ids per row; null and empty texts have none. An empty table gives no rows."""
    return bpe.encode_documents(docs, TOKENIZER, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Robust estimates, minima of hashes and merges are beyond SQL; tests hold the stages
#: against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
