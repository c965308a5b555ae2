"""The corpus pipeline: five stages over documents, each written as Parquet and read again for the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import decontam, langid, simhash, substring_dedup, vector_packing
from scorewright.llm.blocks import remove, shared_folder
from scorewright.llm.queries import documents, table, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; `und` and texts of no learned language go. Each row goes by its own text; doc_ids may be null or repeated."""
    return langid.recognised(docs, langid.learn(docs, F.lit(True)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, that of the smallest doc_id.

    Rows go by themselves: those with null or repeated doc_ids are linked by their texts only, and of rows that are equal in doc_id
    and text one stays. Null and empty texts are copies of each other.
    """
    return simhash.one_of_each(docs)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows leave the texts; documents of which nothing is left go. n_chars follows the text.

    Null and empty texts stay as they are. Rows with one doc_id are no copies of each other, and a row without doc_id keeps all its words.
    """
    rows = substring_dedup.remove_repeats(docs)
    cut = F.col("kept.n_removed") > 0
    new = {"text": F.when(cut, F.col("kept.kept_text")).otherwise(F.col("row.text"))}
    new["n_chars"] = F.when(cut, F.char_length("kept.kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    left = rows.where(~cut | (F.char_length("kept.kept_text") > 0))
    return left.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Each row goes by its own text; doc_ids may be null or repeated, null and empty texts stay."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences of 1024 tokens, with their token ids: the training data.

    `ids` holds a piece's ids as little-endian unsigned 32-bit numbers; those of a sequence's pieces, in the order of `offset`, are the
    sequence, and the pieces' lengths its segments. Each row is packed by itself, whatever its doc_id; a null or empty text is its end token.
    """
    return vector_packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("substring_dedup", substring_removal), ("decontamination", decontamination), ("packing", packing)]
#: SQL cannot express a fitted classifier or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result goes through Parquet in the shared checkpoint folder, and is removed when the next one is written."""
    docs, base = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}-{name}")
        docs = spark.read.parquet(f"{base}/{number}-{name}")
        if number:
            remove(spark, f"{base}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
