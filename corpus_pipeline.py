"""The corpus pipeline: language ID, toxicity, near-duplicates, mixing to target weights, SentencePiece.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Models are learned from what the stage gets.

Cases: null texts have no language and go in the first stage, as do texts without a letter; rows with a null or repeated
id are documents of their own, of which near-duplicates go like any other's; ties go to the smaller id; very long texts are
read in pieces; an empty table stays empty; extra columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import language, mixing, neardup, pieces, toxicity
from recollect.llm.bitmap import without
from recollect.llm.supervised import crc_mod
from recollect.llm.tables import dropped, small_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document of at least so many characters goes if no language has this share of it; shorter ones can't be told.
MIN_LANGUAGE_SHARE, SHORT = 0.4, 200
#: A document goes if it is at least this likely to be toxic.
MAX_TOXIC = 0.3
#: Workers serve one stage after the other and keep what they hold, so that batches and remembered words are fewer here.
BATCH, PIECES = 4 << 20, pieces.PieceParams(memory=60_000)


def _shielded(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs `work` with columns that aren't documents' own under other names, so that none can clash."""
    small_batches(docs.sparkSession, BATCH)
    other = {c: f"extra_{i}_" for i, c in enumerate(docs.columns) if c not in COLUMNS}
    done = work(docs.withColumnsRenamed(other))
    return done.withColumnsRenamed({b: a for a, b in other.items()})


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a main language."""

    def work(rows: DataFrame) -> DataFrame:
        model = language.train(rows, crc_mod("doc_id", 3) != 1)
        judged = language.mixtures(rows, model, rows.columns, out=("pred_", "share_", "all_"))
        return judged.filter((F.col("pred_") != "und") & ((F.col("share_") >= MIN_LANGUAGE_SHARE) | (F.length("text") < SHORT))).select(rows.columns)

    return _shielded(docs, work)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't toxic."""

    def work(rows: DataFrame) -> DataFrame:
        model = toxicity.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
        return toxicity.score(rows, model, rows.columns, out="toxic_").filter(F.col("toxic_") < MAX_TOXIC).select(rows.columns)

    return _shielded(docs, work)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are similar by 0.8: that with the smallest id, a row without an id only if none has one."""

    def work(rows: DataFrame) -> DataFrame:
        # Rows are the nodes, as ids may be null or repeated; a number of their own is fixed by writing it.
        keyed = written(rows.withColumn("row_", F.monotonically_increasing_id()).withColumn("hash_", F.xxhash64("text")), "rows")
        groups = neardup.near_duplicates(keyed.select("row_", "text"), neardup.LOOSE, key="row_").select(F.col("doc_id").alias("row_"), "component_id")
        several = written(groups.join(groups.groupBy("component_id").count().filter("count > 1").select("component_id"), "component_id"), "several")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash_", "row_")).alias("first_")
        members = keyed.select("row_", "doc_id", "hash_").join(several, "row_")
        gone = several.select("row_").join(members.groupBy("component_id").agg(first).select("first_.row_"), "row_", "left_anti")
        return without(keyed, written(gone, "gone"), "row_").select(rows.columns)

    return _shielded(docs, work)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by calibrated probabilities."""
    return _shielded(docs, lambda rows: mixing.mixed(rows).filter("m_kept").select(rows.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces."""
    small_batches(spark, BATCH)
    return pieces.encode(docs.select("doc_id", "text", "lang", "source"), PIECES).withColumn("n_pieces", F.size("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", languages), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix), ("pieces", tokens),
]
#: Learned models and sketches are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:  # nothing reads it once its successor is there
            dropped(before)
        before = docs
    return docs
