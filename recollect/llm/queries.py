"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, hard_negatives, language, license_scan, metric_join, mixing, neardup, pieces, posting_lists, quality, toxicity, url_filter
from .supervised import crc_mod
from .tables import small_batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(mod: int, rest: int) -> Column:
    """Nothing is learned from a document without an id, but it isn't held out either."""
    return F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    out = toxicity.score(docs, model, ["doc_id"])
    return out.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, crc_mod("doc_id", 3) != 1)
    out = language.mixtures(docs, model, ["doc_id"])
    return out.select("doc_id", _held_out(3, 1), "lang_pred", "score", "proportions")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _read(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    out = quality.score(docs, model, ["doc_id"])
    return out.select("doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.metric_links(_read(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.default_labels(spark), url_filter.default_rules(spark))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"), license_scan.known(spark))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "decoded_ok")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    p = F.floor(F.col("m_p") * 1e6 + 0.5) / 1e6  # as it is shown; what is kept goes by all digits
    return mixing.mixed(docs).select("doc_id", "m_source", "m_lang", "m_topic", "m_tokens", p.alias("m_p"), "m_kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: x.cast("double") * 256)
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), scaled.alias("embedding")), F.col("vec_id") % 50 == 0)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _read(spark, sf_dir, "conversations")
    found = conversations.repair(conversations.damaged(given)).withColumnRenamed("conv_id", "of")
    every = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    hashed = F.coalesce(conversations.digest("repaired"), F.sha2(F.lit(""), 256))
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), hashed.alias("repaired_sha256"))


_EVERY = (
    op1_toxicity, op2_language, op3_url_filter, op4_posting_lists, op5_license_scan, op6_pieces, op7_quality, op8_minhash, op9_mixing, op10_metric_join,
    op11_hard_negatives, op12_bpe, op13_conversations,
)
QUERIES = {f.__name__: f for f in _EVERY}
ORACLE_SQL: dict[str, str] = {"op5_license_scan": license_scan.ORACLE, "op9_mixing": mixing.oracle(), "op11_hard_negatives": hard_negatives.ORACLE, "op13_conversations": conversations.ORACLE}
