"""A training corpus from raw documents: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all rows its predecessor kept and its result is
written and read again before the next one starts. All stages but the last return the columns of ``documents``; the
last one returns a row per packed piece. Rows with NULL ids or texts stay in until packing, where a NULL text is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontamination, lines, neardup, packing, toxicity
from tablewright.llm.catalog import pack_options
from tablewright.llm.tables import bounded_broadcast, read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labelled ones among them."""
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, passages_col=None).where("toxicity < 0.5").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that exceed the boilerplate ratio of their source; n_chars is that of the new text."""
    return lines.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of an id that is repeated; documents without an id stay."""
    found = stored(neardup.near_duplicates(docs).where("id IS NOT NULL").groupBy("id").agg(F.min("component").alias("component"), F.count("*").alias("n")), "components")
    gone = found.where("id <> component").select(F.col("id").alias("_gone"))
    left = docs.join(bounded_broadcast(gone, gone.count(), 16), F.col("doc_id") == F.col("_gone"), "left_anti").select(*COLUMNS)
    again = found.where("id = component AND n > 1").select(F.col("id").alias("_again"))
    if again.isEmpty():
        return left
    twice = F.col("doc_id") == F.col("_again")
    return left.join(again, twice, "left_anti").union(left.join(again, twice, "left_semi").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    found = decontamination.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    return found.where(~decontamination.contaminated()).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    _, pieces = packing.pack(docs.select("doc_id", "text"), pack_options())
    return packing.digest(pieces)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# The learned score, the sketches and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
