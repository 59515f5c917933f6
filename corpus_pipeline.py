"""A corpus pipeline of five stages over documents; each is written as Parquet and read again by the next.

All stages take any number of rows, none included, keep all columns (also such as
have the names that operators use inside) and treat rows that share a doc_id
alike. Rows without a doc_id have no place in an order of documents and no name
by which others could point to them: they are labelled, keep all their lines and
are no copies; only what a stage says below makes them go.

Line dedup comes before the join of near duplicates. A near copy loses the lines
that match its first one's, and what is left of it are the lines with edits: these
fragments are seldom near duplicates of anything, so the join's own work in the
pipeline is on texts whose lines were edited throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, jaccard_join, langid, line_dedup, mixing
from sparkloom.llm.stage import fresh, keep


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a known language go: those whose text is null, empty or has no letter. The others get lang_pred and score.

    The classifier learns from the non-null lang of the stage's own rows; where no row has one, no language
    is known and every row goes. Each row is judged by its own text. All columns stay as they are.
    """
    return langid.known_language(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go. A document that had words and has none left goes with them; n_chars follows text.

    Of equal lines the one of the smallest doc_id, then line number, stays. Null and empty texts stay as they are.
    """
    lines, removed = fresh(docs, "__lines"), fresh(docs, "__removed")
    out = line_dedup.dedup_lines(docs, n_lines=lines, n_removed=removed)
    out = out.where((F.col(removed) <= 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[size.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; null, empty and wordless texts are no duplicates."""
    return jaccard_join.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; null and empty texts hold none, an empty benchmark takes none."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by calibrated probabilities, with weight (in place of a column of that name).

    Documents without words weigh nothing and go. The draw is a hash of doc_id, null being one value.
    """
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]

#: Trained and iterative stages are beyond SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
