"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

1. quality: texts that the importance resampling does not draw go.
2. near_duplicates: one document of each group of near copies stays.
3. repeats: passages of 100 bytes and more that stand earlier in the corpus are cut out of the texts.
4. secrets: confirmed and pattern-matched secrets are replaced by a mark.
5. packing: the texts that are left are packed into sequences of several lengths.

A text that stage 3 empties keeps its row and takes no room in stage 5. ``n_chars`` follows the text. All stages but the
last return the columns of their input, whatever these are called, and take any table of documents:

* null and empty texts: not drawn by stage 1, which keeps texts with at least one token; any later stage lets them pass;
* rows without an id are drawn, cut, cleaned and packed like any other; stage 2 keeps them all, even copies;
* rows that repeat an id and a text are drawn together and stand for one text in stages 2 and 3: none of them is a copy of
  the other; rows that repeat an id with another text are judged text by text;
* equal weights in stage 1 go to the smaller id; of equal texts the smallest id stays in stage 2 and keeps its bytes in 3;
* texts of any length are read whole; an empty table gives an empty table; without labels stage 1 keeps all texts with a token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import op1_minhash, op5_resampling, op6_packing, op8_secrets, op10_suffixes
from tessella.runtime import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling towards labelled good texts draws; ids without a label are drawn by their text alone."""
    return op5_resampling.drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return op1_minhash.without_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that start earlier."""
    return _counted(op10_suffixes.strip_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark, overlapping ones by one."""
    return _counted(op8_secrets.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, bin_id, capacity, bin_offset."""
    return op6_packing.pack(op6_packing.token_counts(docs))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

#: Components, suffix order and decoding of secrets are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's rows are written as Parquet and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return made
        kept = scratch.keep(made)
        scratch.drop(docs)
        docs = kept
    return docs
