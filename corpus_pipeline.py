"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import decontam, langid, lines, neardup, packing
from glyphlake.llm.shared import remainder, table, written

#: Bits a letter beyond which no learned language fits a text, and the letters from which a text is long enough to tell.
MOST_BITS, LEAST_LETTERS = 5.5, 50

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of ``LEAST_LETTERS`` letters that fit no learned language.

    A text fits none if even the best automaton needs more than ``MOST_BITS`` bits a letter. Without a
    model no language is judged.
    """
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    model = langid.fit(docs, learn=remainder(F.col("doc_id"), 4) != 2)
    if not model.languages:
        return lettered
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    got = langid.identify(lettered, model)
    return got.where((F.col("lang_bits") <= MOST_BITS) | (letters < LEAST_LETTERS)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, and documents of which no line is left."""
    kept = lines.deduplicate(docs, every_line=True).where("n_removed < n_lines or n_removed = 0")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.flag(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express language ID by automata, joins of line sketches, BagMinHash or packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
