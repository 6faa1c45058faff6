"""A training-corpus pipeline: language, near duplicates, benchmark leaks, secrets, pieces.

Every stage reads all that its predecessor kept and is written as Parquet in the shared
checkpoint folder before the next one starts, so an executor that is lost costs no more than
the stage that runs.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crosspanel.llm import jaccard, langid, pieces, secrets, winnow
from crosspanel.llm.frames import bound_batches, read_input, row_key
from crosspanel.llm.queries import vocabulary
from crosspanel.session import ship_package, stage_table

#: Score that a text needs: about half of the margin that nearly all held-out labelled texts reach.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; texts without letters and null texts go.

    Without a single labelled document every text with a letter stays.
    """
    bound_batches(spark)
    model = langid.fit(docs.where(langid.fold() != 0).select("text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(docs, model)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near duplicates, the one with the smallest id.

    Documents are told apart by id and text, so different texts under one id both stay.  Of rows equal in
    both, one stays.  Rows without an id or without words are near nothing and stay.
    """
    bound_batches(spark)
    found = stage_table(jaccard.surplus_rows(docs).where("NOT keep OR times > 1"), "pipeline-surplus")
    at = found.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"), "keep")
    same = (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_h"))
    stay = docs.join(at.drop("keep"), same, "left_anti")
    if found.where("keep").isEmpty():
        return stay.select(*docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.join(at.where("keep"), same, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min(row).alias("row")).select("row.*")
    return stay.unionByName(once).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no window of a benchmark item occurs."""
    found = winnow.decontaminate(docs, read_input(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("key").alias("hit"))
    return docs.join(found.distinct(), row_key() == F.col("hit"), "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep all documents, with secrets replaced by their kind and the length brought up to date."""
    bound_batches(spark)
    clean = secrets.find_secrets(docs, secrets.fit(docs), redact=True, column="pipeline_spans").drop("pipeline_spans")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked by decoding them."""
    bound_batches(spark)
    coded = pieces.encode_checked(docs.select("doc_id", "lang", "source", "text"), vocabulary(spark))
    return coded.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scan", without_secrets),
    ("SentencePiece", encoded),
]

#: The language and grammar models and the segmentation can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read_input(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
