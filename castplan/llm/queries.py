"""Registered queries of the operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castplan.llm import (bbit_minhash, bpe, code_compression, decontamination, kd_sharding, length_packing, line_dedup, lstm_extract, order_minhash,
                          pseudo_likelihood, quality_qda, url_temporal, whitening)
from castplan.llm.shared import materialize


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its globally repeated line chunks removed."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", *line_dedup.ADDED, F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, split over source, language and id."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    dims = [kd_sharding.text_ordinal(F.col("source")), kd_sharding.text_ordinal(F.col("lang")), kd_sharding.linear_ordinal(F.col("doc_id"), least, most)]
    out = kd_sharding.kd_shards(docs, dims, shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels that aren't held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_qda.score(docs, _read(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", (~quality_qda.training_row()).alias("held_out"), "score", "predicted")


def _number(text, size: int):
    """A number below ``size`` made from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % size


def url_captures(pages: DataFrame) -> DataFrame:
    """Captures: every page, fetched on a day (0 to 719) made from its URL."""
    return pages.select("page_id", "url", _number(F.coalesce("url", F.lit("")), 720).alias("fetched_on"))


def url_changes(pages: DataFrame) -> DataFrame:
    """Dated list changes over all patterns that cover a URL of ``pages``: two thirds of them are listed,
    later removed, and listed again; one list in four allows, and a third of the patterns stand on two lists."""
    patterns = pages.select(F.explode(url_temporal.url_keys(F.col("url"))).alias("pattern")).distinct()
    patterns = patterns.where(_number(F.concat(F.lit("in"), "pattern"), 3) > 0)
    # the second list has a pattern's text with a mark in its dates
    seed = F.explode(F.when(_number(F.concat(F.lit("two"), "pattern"), 3) == 0, F.array("pattern", F.concat("pattern", F.lit("#2")))).otherwise(F.array("pattern")))
    entries = patterns.select("pattern", seed.alias("seed"))
    start = _number(F.concat(F.lit("start"), "seed"), 500)
    gone = start + 30 + _number(F.concat(F.lit("gone"), "seed"), 200)
    again = gone + _number(F.concat(F.lit("again"), "seed"), 90)
    place = (_number(F.concat(F.lit("list"), "pattern"), 4) + F.when(F.col("seed") == F.col("pattern"), 0).otherwise(1)) % 4
    name = F.element_at(F.array(*[F.lit(x) for x in ("allow", "adult", "phishing", "spam")]), (place + 1).cast("int"))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), d.alias("day")) for a, d in (("add", start), ("remove", gone), ("add", again))]))
    return entries.select(name.alias("list_name"), "pattern", steps.alias("s")).select("list_name", "pattern", "s.action", "s.day")


def op4_url_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of ``pages`` against the list entries active on the day of its fetch."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_temporal.filter_urls(url_captures(pages), url_changes(pages))


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked pseudo-likelihood of every document under a network trained on the corpus."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudo_likelihood.score(docs, keep=["doc_id"])


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on 4-word shingles at a similarity of 0.8."""
    return bbit_minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, threshold_pct=80)


def op7_lstm_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = lstm_extract.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bucket, batch and padding."""
    return length_packing.pack(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every document and of its edited text."""
    return order_minhash.edit_report(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of ``benchmark`` against every whole text of ``documents``."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.scan(docs, _read(spark, sf_dir, "benchmark"), window=10)
    n_hit = decontamination.span_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings: 8 parts, 16 entries, 6 rounds."""
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows, books = code_compression.compress(vectors)
    out = code_compression.add_group_totals(materialize(rows, "codes"), "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened on their first 32 components."""
    out = whitening.report(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), top=32)
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and what they decode to."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, keep=["doc_id"])
    out = bpe.decode(docs, vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_kd_sharding": op2_kd_sharding,
    "op3_quality_qda": op3_quality_qda,
    "op4_url_temporal": op4_url_temporal,
    "op5_pseudo_likelihood": op5_pseudo_likelihood,
    "op6_bbit_minhash": op6_bbit_minhash,
    "op7_lstm_extract": op7_lstm_extract,
    "op8_length_packing": op8_length_packing,
    "op9_order_minhash": op9_order_minhash,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_code_compression": op11_code_compression,
    "op12_whitening": op12_whitening,
    "op13_bpe": op13_bpe,
}
