"""From documents to token ids: five stages, each on all that the one before it kept.

1. quality: documents that the co-trained classifier rejects go.
2. near_duplicates: one document of each SimHash group stays.
3. secrets: what the scan finds is masked in the text.
4. mixture: documents are drawn so that sources, languages and topics get their shares of tokens.
5. tokens: the byte-level BPE ids of every document left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again. All but the mixture begin by letting go of
what the driver still holds of those before."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, cotraining, raking, secrets, simhash
from weft.llm.base import durable, released, table

#: Expected share of the tokens that the mixture keeps.
BUDGET = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the co-trained classifier accepts. A null text is scored as an empty one, null metadata is a value
    like others, ids may be null; equal rows have one score and go together. Without labels of both kinds the only
    label decides, without any all stay. A text of any length is read whole. Other columns stay, whatever their names."""
    released(spark)
    return cotraining.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: the smallest doc_id (null ids last), among rows of that id the smallest hash of the
    text, of equal rows one. Null and empty texts are one group. Texts of any length are read whole."""
    released(spark)
    return simhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with the secrets in its text masked and n_chars to match. Null and empty texts stay as they are, equal
    rows stay equal; a long text or token is scanned whole."""
    released(spark)
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows drawn so that BUDGET of the tokens stay, in raked shares. Null source or language is a name; rows of one
    doc_id in one cell are drawn together, null ids too; a corpus without tokens is kept whole."""
    return raking.sample(docs, budget=BUDGET)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, null ids and equal rows too. A null text is an empty one, of no ids; time is
    in proportion to a text's length."""
    released(spark)
    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, written=True)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("mixture", mixture), ("tokens", tokens)]

#: A trained classifier, graph components and merges are not to be had in one SQL statement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again; then the rows before them are deleted."""
    docs, last = table(spark, sf_dir, "documents"), ()
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), spent=last)
        last = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
