"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``documents``. ``run`` writes what a stage returns to the shared folder and gives that to
the next, so that no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoebox.llm import byte_bpe, decontaminate, line_dedup, quality, simhash
from shoebox.llm.common import documents, table
from shoebox.plans.tables import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it is trained on the stage's own input."""
    return quality.keep_trained(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without lines that ten or more share; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id. Of a group's documents
    without an id one stays too. Groups are those of the SimHash operator: three-word shingles, links of three bits."""
    return simhash.keep_first(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return byte_bpe.encode_documents(docs, *byte_bpe.default_vocabulary())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: Stages 1, 3 and 5 have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor kept."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
