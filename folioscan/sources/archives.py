"""ZIP archives of many small files, one per group, byte for byte the same on every run."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import rows_of

#: The time that members carry.
STAMP = (1980, 1, 1, 0, 0, 0)


def archive_of(files: list[dict]) -> bytes:
    """A ZIP archive of stored members (name, content), in the order of their names."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for f in sorted(files, key=lambda f: f["name"]):
            z.writestr(zipfile.ZipInfo(f["name"], STAMP), f["content"] or b"")
    return out.getvalue()


def archives(files: DataFrame) -> DataFrame:
    """doc_id, archive: the files of each document (doc_id, name, content as text or bytes) in one archive.

    A document's files come together in one task: they are what mending and reporting leave of one document.
    """
    per = files.groupBy("doc_id").agg(F.collect_list(F.struct("name", F.col("content").cast("binary").alias("content"))).alias("f"))
    return rows_of(per, ["f"], lambda f: [(archive_of(f),)], [("archive", "binary", pa.binary())])


def write_archives(files: DataFrame, path: str) -> DataFrame:
    """doc_id, path, bytes: archives written as ``<doc_id>.zip`` below ``path`` by the tasks that make them (once the rows are read).

    ``path`` is an address that pyarrow's file systems open (local, HDFS, S3, GCS).  A task that runs again writes the
    same bytes to the same names.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names = [f"{base}/{k}.zip" for k in batch.column(0).to_pylist()]
            blobs = batch.column(1).to_pylist()
            for name, blob in zip(names, blobs, strict=True):
                with store.open_output_stream(name) as f:
                    f.write(blob)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array([len(b) for b in blobs], pa.int64())], names=["doc_id", "path", "bytes"])

    return archives(files).mapInArrow(run, "doc_id long, path string, bytes long")
