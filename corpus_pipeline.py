"""A corpus pipeline: quality rules, SimHash near-dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
stage's rows as Parquet to the shared folder and reads them back for the next.

Results: a null text is the empty text, which the first stage rejects; null ids are
kept and told apart by their texts; of rows equal in id and text one goes on from
the second stage; ties there go by id, null last, then by the text's digest; an
empty table gives no rows in any stage; extra columns pass through all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import bpe, mixing, quality, simhash
from tandem.llm.queries import tokenizer_path
from tandem.llm.shared import remove, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, with the lines that pass; repeated rows stay as often as they come, null and empty texts go."""
    return quality.clean(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, which five-word shingles with a similarity of 0.8 or more connect: that with the smallest id, null last."""
    return simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources, null one of them, mixed to their target weights; a document taken more than once is as many rows, the last cut perhaps."""
    return mixing.mix(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text: doc_id, source, ids; a text without tokens has an empty list."""
    return bpe.encode(docs, tokenizer_path(), keep=("doc_id", "source"))


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("source_mix", source_mix), ("bpe_encode", bpe_encode)]
#: SimHash fingerprints and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's table is deleted once the next one's is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before, path = path, shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return docs
