"""A training corpus from raw documents: five stages, each one operator of the llm subpackage.

Every stage takes all rows that the one before it kept, and its decisions take effect: rejected documents and near
copies go, repeated passages are cut out of texts, sources are mixed to their weights (rows may repeat), and what
stays is encoded.

Edge cases: a null text is the empty text throughout; it is scored, is a near copy of other texts without words, and is
encoded to no ids. Rows with a null id are kept, rejected and mixed like any other, and of near copies a row with an id
stays rather than one without. Repeated rows are near copies of each other, so one stays. Texts of any length are
taken whole. Extra columns are left out by the first stage, so none can clash. An empty table gives an empty one; without
labels all documents score 0.5 and stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm import byte_bpe, quality, simhash_dedup, source_mixing, substring_dedup
from cinderlake.staging import discard, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.classify(docs.select(*COLUMNS), labels)
    return scored.where("score >= 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash_dedup.one_of_similar(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of words that also start elsewhere; other texts stay as they are."""
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": chars}).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    import public_tokenizers

    coded = byte_bpe.encode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The stages of trained models, fingerprints and merges have no SQL form; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)  # nothing reads a stage once the next one is written
    return STAGES[-1][1](spark, docs, sf_dir)
