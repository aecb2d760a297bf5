"""Text of pages from placed strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pages read, and the distances from which strings are on another line or apart.
PAGES, LINE_GAP, WORD_GAP = 300, 2, 1


def page_texts(items: DataFrame) -> DataFrame:
    """doc_id, page, text: strings in their order, parted by a line break, a blank or nothing.

    ``items``: doc_id, page, seq, str, x, y, width.  Two strings are on one line if their heights differ by less than
    LINE_GAP; a blank parts them if the gap is over WORD_GAP and neither brings one.  Pages beyond PAGES are left out.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    before = lambda c: F.lag(c).over(w)
    gap = F.col("x") - (before("x") + F.coalesce(before("width"), F.lit(0.0)))
    blank = (before("str") != "") & ~before("str").endswith(" ") & ~F.col("str").startswith(" ") & (gap > WORD_GAP)
    sign = F.when(F.row_number().over(w) == 1, "").when(F.abs(F.col("y") - before("y")) >= LINE_GAP, "\n").when(blank, " ").otherwise("")
    rows = items.where(F.col("page") <= PAGES).select("doc_id", "page", "seq", F.concat(sign, "str").alias("s"))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda x: x["s"]), "").alias("text"))
