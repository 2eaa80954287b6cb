"""From raw documents to packed training sequences.

Each stage takes what the one before it kept, as written to and read back from the
shared scratch folder; all but the last return the columns of ``documents``.

Defined results, for all stages: a null text is handled as the empty one and stays null; null ids take part; of rows that
repeat both id and text one stays from exact dedup on; an empty table gives an empty one; columns beside those of
``documents`` are carried along, whatever they are called, up to packing. A stage's scratch tables are deleted when it
reads them no more, but for those that its result reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.llm import exact_dedup, packing, queries, simhash, substring_dedup, toxicity
from fathomlog.llm.common import materialize
from fathomlog.llm.training import remainder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model of the labels that it may learn from; without such labels of both kinds the share of toxic ones is every score (0.5 if there are none, so all go)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels, remainder(F.col("doc_id"), 5) != 0))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null equals empty), the document with the largest doc_id; a null id stays only where there is no other."""
    return exact_dedup.drop_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of five-word shingles alike, or fingerprints within two bits), the document with the smallest doc_id, null ids last; texts without words are one group."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 200-byte strings that occur more than once; n_chars follows the text. A document of which nothing is left stays, empty; a character cut in two goes whole."""
    left = substring_dedup.remove_repeats(docs, length=200, keep_text=True)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens; an empty text is one piece, the separator."""
    return packing.pack_documents(docs, queries.tokenizer_path(), capacity=2048, separator=0)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("suffix_array_dedup", remove_repeats),
    ("packing", pack_sequences),
]
#: Neither the classifier nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
