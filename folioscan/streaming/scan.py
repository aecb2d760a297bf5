"""The scan over a stream of documents: each is judged alone, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.scan import scan


def scan_stream(docs: DataFrame, once_by: str | None = None, late: str = "1 day") -> DataFrame:
    """Findings of a stream of (doc_id, text, filetype).

    If ``once_by`` names a column of event times, a document that comes again within ``late`` is scanned once.
    """
    if once_by:
        docs = docs.withWatermark(once_by, late).dropDuplicatesWithinWatermark(["doc_id"])
    return scan(docs)


def write_findings(findings: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of findings to Parquet, exactly once by its checkpoint; start() runs it."""
    return findings.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
