"""A training-data pipeline of five stages over `documents`; each takes what its predecessor kept, whole.

Every stage but the last returns the columns of documents. Stages read their other tables from sf_dir.

In every stage documents without an id are judged on their own, equal rows alike, and rows that share an id as the stage's operator says;
an empty table gives an empty one; extra columns stay, whatever their names; texts may have any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, lines, neardup, quality
from quern.llm.queries import tokenizer_path
from quern.runtime import drop, mark, release, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond their language's quantile of perplexity go, and those with words of toxic documents. Null and empty texts
    go; a null language takes the model of all text; without trusted labels only null and empty texts go."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of two or more lines that stand earlier are cut from texts; n_chars follows, null for a null text (a table without it stays so). Texts that go
    whole stay as empty rows; of equal rows of one id none is cut."""
    cut = lines.dedup(docs)
    if "n_chars" not in docs.columns:
        return cut.select([f"`{c}`" for c in docs.columns])
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select([n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates stays, with all rows of that id; stages on word shingles
    take five words. Null and empty texts, and rows without an id, stay."""
    return neardup.deduplicated(docs, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay, and null or empty items are in none."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and hashes of ids and decoded texts, a row for each document; a null text counts as empty."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
#: SQL can't express the quality model or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to shared storage and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, own = docs, mark()
        docs = written(stage(spark, before, sf_dir), name)
        drop(before)
        release(spark, own, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
