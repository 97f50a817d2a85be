"""Prepares the documents table in five stages, each written as Parquet and read again as the next one's documents.

Every stage decides on rows, not on ids: null ids are rows like others, rows may share an id or be equal. An
empty table gives an empty one, texts of any length are whole, and columns beyond those of documents are carried along by
all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import bpe, jaccard, lines, mixing, quality
from cadence.llm.common import WORD_BYTES, Workspace, free, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the line labels keep. A null or empty text fails; equal rows fare alike."""
    return quality.keep(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without lines that an earlier row has; those that lose all their words go. Rows that share an id, or have none, are told apart by their texts and then by place, so a row that repeats goes; a null id counts as the last; a null text stays null."""
    counts = (free("_lines", docs), free("_removed", docs))
    kept = lines.dedup_lines(docs, counts=counts)
    whole = F.col(counts[1]) == 0
    kept = kept.where(whole | F.col("text").rlike(WORD_BYTES))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the first by id (null last) and text. Rows without words all stay."""
    return jaccard.first_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: the words it takes of a row, rounded to whole copies (none, one or two). Rows without words go; a null source is one of its own."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of them and of the decoded text; a null text is an empty one."""
    return bpe.encode_frame(docs, bpe.model_path(), with_ids=True).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL can express neither the trained line labels nor the encoder; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
