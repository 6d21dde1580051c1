"""The corpus pipeline: documents go through the training-data operators, a stage at a time.

Every stage but the last returns the columns it was given. A document is a row; rows of equal
``doc_id`` and text are one document once they have passed ``near_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm import cross_parsing, fit_packing, line_dedup, prob_minhash, quality
from pagemill.llm.common import limit_batches, table
from pagemill.session import apply_settings, scratch_dir

#: Workers of one stage may still be there when the next one starts: half the batch of a query by itself.
BATCH_BYTES = 2 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts and texts without letters go."""
    limit_batches(spark, BATCH_BYTES)
    samples = cross_parsing.training_sample(docs)
    found = cross_parsing.identify(docs, samples)
    unlike = cross_parsing.unlike(F.col("phrase_letters"), F.col("lang_pred"), F.col("letters"), cross_parsing.shortest_phrases(samples))
    return found.where(~unlike).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the model fitted on ``labels``."""
    labels = table(spark, sf_dir, "labels")
    limit_batches(spark, BATCH_BYTES)
    model = quality.train(docs, labels)
    return quality.judge(docs, model).where("kept").select(docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats in many of its texts; ``n_chars`` follows the text.

    Copies count once: near-duplicate removal comes later and could keep none that has its text.
    """
    limit_batches(spark, BATCH_BYTES)
    cut = line_dedup.drop_boilerplate(docs, distinct_texts=True)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", changed)
    return cut.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest ``doc_id``, once.

    A document is a ``doc_id`` with a text: several texts of one ``doc_id`` are several documents. Rows without a
    ``doc_id`` or text are classes of their own and stay.
    """
    limit_batches(spark, BATCH_BYTES)
    classes = prob_minhash.text_classes(docs).where("digest is not null")
    heads = classes.groupBy("comp").agg(F.min(F.struct("doc_id", "digest")).alias("h")).select(F.col("h.doc_id").alias("__pm_head"), F.col("h.digest").alias("__pm_text"))
    digest = F.unhex(F.md5("text"))
    kept = docs.join(heads, (docs["doc_id"] == heads["__pm_head"]) & (digest == heads["__pm_text"]), "left_semi")
    w = Window.partitionBy("doc_id", digest).orderBy(F.xxhash64(*docs.columns))
    first = kept.withColumn("__pm_rn", F.row_number().over(w)).where("__pm_rn = 1").drop("__pm_rn")
    return first.union(docs.where("doc_id is null or text is null"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in packed sequences."""
    limit_batches(spark, BATCH_BYTES)
    return fit_packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]
#: Suffix automata, a fitted model and hashed signatures have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet and read again."""
    apply_settings(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
