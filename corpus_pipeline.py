"""The corpus pipeline: documents through five of the operators, one written table per stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what it
keeps, in the columns of ``documents`` except for the last.  ``run`` writes every stage as Parquet
under ``spark.checkpoint.dir`` and reads it back as the next one's documents.

A document that the quality classifier rejects goes.  Line dedup removes repeated chunks from texts,
and with them documents of which less than two fifths is left (``LEFT``): what an exact or near copy has of
its own is no document, and too little for the next stage to know the original by.  Of every near-duplicate group the
document of least id stays (five-word shingles, similarity 0.8).  Documents that hold a benchmark
window go.  Packing gives one row per piece of every document left.

SQL can't express the classifier, the rolling hashes or the dynamic programme, so there is no oracle;
tests hold ``run`` against brute force.  Nulls, empty tables, repeated rows and clashing columns are
as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castplan.llm import bbit_minhash, decontamination, length_packing, line_dedup, quality_qda
from castplan.llm.shared import materialize


#: Least share of a text's bytes that must be left when repeated chunks are removed.
LEFT = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_qda.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed_chunks") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    size = F.octet_length("text")
    left = F.col("text").rlike(r"\S") & (size > LEFT * (size + F.col("n_removed_bytes")))
    return out.where((F.col("n_removed_chunks") == 0) | left).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bbit_minhash.deduplicate(docs, shingle=5, threshold_pct=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return length_packing.pack(docs, keep=["doc_id", "lang", "source"])


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_duplicates),
          ("benchmark decontamination", benchmark), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
