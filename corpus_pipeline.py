"""A corpus from documents: language, lines, near-duplicates, mixture, token ids; each stage a table of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import bpe, langid, lines, mixing, neardup
from folioscan.llm.common import crc_mod, delete, scratch, shared_dir

#: Documents whose language is less likely than this are rejected, as are those without letters.
LEAST_SCORE = 0.5
#: Bytes of a batch that goes to a Python worker: the executor and the worker hold one or two for each task at once.
BATCH_BYTES = 8 << 20


def _small_batches(spark: SparkSession) -> None:
    """From here on the session hands out texts in batches of BATCH_BYTES, unless it was told to use smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the languages learned; those it rejects (undetermined or unlikely) go.

    The languages are learned from the rows' own ``lang``.  Null, empty and letterless texts go; rows without a lang or
    doc_id are judged like others, repeated rows alike, long texts whole.  If no row has a lang, no language can be
    told and all rows go; an empty table stays empty.  Other columns are carried along, whatever their names.
    """
    _small_batches(spark)
    model = langid.train(docs, crc_mod("doc_id", 4) != 2)
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that equal or are near to earlier ones; rows left without a word go.

    Rows without a doc_id keep all lines, rows that share one lose lines by their own text; rows that repeat doc_id and
    text lose the same lines.  Texts without a word stay as they are; n_chars follows the text where lines went.
    """
    _small_batches(spark)
    return lines.without_duplicate_lines(docs)


def drop_near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest doc_id.

    Of rows that share a doc_id one stays, that with the smallest hash of all its columns (equal rows are the same);
    rows without a doc_id, and texts without words, stay.
    """
    _small_batches(spark)
    kept = neardup.near_documents(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    tie = F.xxhash64(*_columns(docs))
    rows = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("doc_id").alias("id"), tie.alias("tie"))
    first = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min(tie).alias("tie")).join(kept.withColumnRenamed("doc_id", "id"), "id")
    once = rows.join(first, ["id", "tie"]).dropDuplicates(["id"])
    return once.select("row.*").unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once, or repeatedly, by source.

    Sources may be null (one of their own); texts without words count nothing, and are taken as often as others of
    their source, unless the source has no words at all.  Reruns take the same rows.
    """
    return mixing.repeat_rows(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document that is left: doc_id (may be null), n_tokens, ids_sha256, decoded_sha256; a null text has no tokens."""
    _small_batches(spark)
    return bpe.encode_documents(docs, ids=False)


STAGES = [("language", keep_languages), ("lines", drop_lines), ("near_duplicates", drop_near_documents), ("mixture", mix_sources), ("tokens", encode)]
#: No SQL expresses the stages before the mixture; a test compares all rows with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, each written to the shared folder and read again.

    What a stage saves on its way goes when it is written, and a stage's table when the next one is; the last one's
    stays for whoever reads the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if last:
            delete(spark, f"{at}/{last}")
        docs, last = spark.read.parquet(f"{at}/{name}"), name
    return docs
