"""A corpus pipeline: language, quality, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import jaccard, langid, mixing, packing, quality
from loomwork.llm.common import load, scratch_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, of which no language can be told, go."""
    return langid.predict(docs.select(COLUMNS), langid.train(docs)).filter("lang_pred != 'und'").select(COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go.  Labels come from the table ``labels``."""
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), model).filter(F.col("score") >= quality.THRESHOLD).select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of the whole row, so neither null nor repeated ids matter; equal rows share it."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 over five-word shingles, the one with the least id stays (null ids last).

    Rows that share an id but not the text are documents of their own; equal rows are a group.  Texts without words
    link with nothing and stay.
    """
    rows = keyed(docs)
    found = jaccard.jaccard_components(rows, words=5, num=80, den=100, row_col="_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_row"))
    kept = found.filter("n_shingles > 0").groupBy("class_id").agg(first.alias("m")).select("m._row").unionByName(found.filter("n_shingles = 0").select("_row").distinct())
    return rows.join(kept, "_row", "left_semi").select(COLUMNS).distinct()


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.  Equal rows are taken together."""
    rows = keyed(docs)
    copies = mixing.mix(rows, id_col="_row").groupBy("_row").agg(F.sum("copies").cast("int").alias("_copies")).filter("_copies > 0")
    once = rows.distinct().join(copies, "_row")
    return once.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("quality", quality_filter), ("ngram_jaccard", near_duplicates), ("mixing", mixture), ("packing", pack)]
#: The classifier, the rounding and the packing cannot be put as SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what lies between them is written to the folder that the cluster shares."""
    docs = load(spark, sf_dir, "documents")
    home = scratch_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
