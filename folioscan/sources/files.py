"""Sources in files: each a row, routed by the ending of its name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The endings that are read, and what a file of each counts as.
FILETYPES = {"tex": "tex", "latex": "tex", "bbl": "tex", "bib": "bib", "txt": "txt", "pdf": "pdf"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, filetype, text, content: files below ``path`` whose ending is known, in any case.

    Texts are UTF-8; files of type pdf have their bytes in ``content`` and no text, all others a text and no content.
    ``doc_id`` is a hash of the address, which names a file for certain.  Other files are never opened; empty ones give no
    row, as Spark does not plan them.
    """
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in FILETYPES) + "}"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    types = F.create_map(*[F.lit(x) for pair in FILETYPES.items() for x in pair])
    rows = rows.withColumn("filetype", types[F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))])
    pdf = F.col("filetype") == "pdf"
    return rows.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file"), "filetype", F.when(~pdf, F.decode("content", "UTF-8")).alias("text"), F.when(pdf, F.col("content")).alias("content"))
