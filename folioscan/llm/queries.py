"""The queries of this subpackage: each applies an operator to its whole table and returns the asked columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, langid, lengths, lines, lm, mixing, neardup, quality, warc
from .common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark, sf_dir):
    return lm.interpolated(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)


def op2_line_dedup(spark, sf_dir):
    return lines.duplicate_lines(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_counts(spark, sf_dir):
    return lengths.length_histogram(_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, crc_mod("doc_id", 4) != 2)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_warc_zip(spark, sf_dir):
    folder = warc.archive_folder(spark)
    archives = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(archives, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_bpe(spark, sf_dir):
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), ids=False)


def op8_minhash_near_dedup(spark, sf_dir):
    return neardup.near_documents(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=False).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_deleted_interpolation, op2_line_dedup, op3_quality_rules, op4_token_counts, op5_language_id, op6_warc_zip, op7_bpe, op8_minhash_near_dedup, op9_embedding_near_dedup, op10_mixing)}
ORACLES = {"op10_mixing": mixing.MIX_SQL}
