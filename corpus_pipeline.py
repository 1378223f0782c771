"""Corpus pipeline: five stages from raw documents to a mixed training corpus.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. The rows of the last
stage are the copies of the documents that the mix takes.

Rows of one doc_id: the classifier, decontamination and surrogates treat every
row by itself; for near duplicates the rows of a doc_id are one document, of whose
equal rows one stays (the first by all columns) and whose other texts stay with it;
the mix tells them apart by their texts. A null doc_id is no document to near
duplicates, and its rows stay. Null and empty texts go where the classifier rejects
them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.llm._scratch import written
from sessionlake.llm.fmindex import find_leaks
from sessionlake.llm.gam import THRESHOLD, quality_model, score
from sessionlake.llm.jaccard import similarity_classes
from sessionlake.llm.mixing import mix
from sessionlake.llm.pii import replace_entities

#: Near duplicates: five-word shingles, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep_text=True).filter(F.col("score") >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every group; those without doc_id or words stay."""
    classes = written(similarity_classes(docs, SHINGLE, PERCENT), "pipeline-classes")
    first = classes.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = docs.join(first.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if not first.filter("rows > 1").isEmpty():
        equal = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(F.struct(*docs.columns))
        kept = kept.withColumn("_place", F.row_number().over(equal)).filter("_place = 1").drop("_place")
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=True)
    found = found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return found.select(*docs.columns)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    found = replace_entities(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, with its number."""
    taken = mix(docs, carry=True).filter("copies > 0")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("mixing", mixing),
]

#: A learned model and keyed surrogates: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
