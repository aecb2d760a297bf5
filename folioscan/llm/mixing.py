"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Documents of one source and size are dealt into so many groups, so that no group of a hot size is one task's work.
GROUPS_HEX = 3


def _u(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the text of ``key``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share_num: int = 3, share_den: int = 2, cap: int = 2) -> DataFrame:
    """Targets per source from ``sizes`` (source, source_size): weights by code-point order (null last), repeating.

    All targets sum to ``share_num/share_den`` of the sizes unless every source is at its cap; a target stops at
    ``cap`` times the source's size and the excess goes to the others by weight.  Sorting by cap / weight, the number
    of capped sources is the first prefix beyond which the remaining level stays below the next cap.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(w, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything).cast("double") * F.lit(float(share_num)) / F.lit(float(share_den))
    level = (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    # The level that would hold if exactly the sources before this one were capped; the first source below its cap sets it.
    found = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    return found.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share=(3, 2), cap: int = 2, seed: str = "mix", keep: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the whole row, if ``keep``), doc_id, size, source_size, target, copies, taken.

    ``docs`` needs doc_id, text and source; other columns, whatever their names, stay inside ``row``.  Size is the
    number of words of the text (null text: 0).  Every document of a source expects target / source_size copies; along
    an order by size the prefix sums of these, plus one offset per source drawn from ``seed``, yield a copy at each
    integer crossed.  The prefix sum is rank times expectation, and the rank is exact: rows before the source's size,
    rows of the size in earlier groups, rows before it in the group; so results do not hang on partitions.  Rows of
    one doc_id (or none) go by the hash of their text, and equal ones are ties, which may change places; texts of any
    length are counted whole; a source with no words gets target 0 and no copies; an empty
    table gives an empty result.
    """
    rows = docs.select(
        (F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.lit(None).cast("int")).alias("row"), F.col("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"),
        F.xxhash64("text").alias("tie"),
    )
    rows = rows.withColumn("part", F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, GROUPS_HEX), 16, 10).cast("int"))
    parts = rows.groupBy("key", "size", "part").agg(F.count("*").alias("n"))
    upto = lambda *keys: Window.partitionBy("key", *keys)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    first = sizes.select("key", "size", F.coalesce(F.sum("n").over(before(upto().orderBy("size"))), F.lit(0)).alias("smaller"))
    inside = parts.select("key", "size", "part", F.coalesce(F.sum("n").over(before(upto("size").orderBy("part"))), F.lit(0)).alias("earlier"))
    source = F.when(F.col("key") != "n", F.substring("key", 2, 2147483647))
    totals = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals.select(source.alias("source"), "source_size"), weights, *share, cap)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "source_size", "target")
    placed = inside.join(first.join(targets, "key"), ["key", "size"])
    # The rows are dealt once, by the keys of both this join and the window below.
    full = rows.join(placed, ["key", "size", "part"])
    rank = F.col("smaller") + F.col("earlier") + F.row_number().over(upto("size", "part").orderBy("doc_id", "tie"))
    e = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = _u(seed, F.col("key"))
    full = full.withColumn("rank", rank).withColumn("e", e).withColumn("u", u)
    copies = F.least(F.floor(F.col("e") * F.col("rank") + F.col("u")) - F.floor(F.col("e") * (F.col("rank") - 1) + F.col("u")), F.ceil("e"))
    return full.select("row", "doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: the rows given to :func:`mix`, each as often as it is taken."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: The same in DuckDB's SQL, for the query over ``documents``.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3))::BIGINT AS part FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 3 / 2 - coalesce(sum(cap) OVER o, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER o, 0)) AS lev FROM w
      WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lev, cap / w) AS level FROM l WHERE lev * w <= cap),
t AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target,
             ('0x' || substr(md5('mix:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM w LEFT JOIN f ON true),
r AS (SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
             row_number() OVER (PARTITION BY d.source ORDER BY size, part, doc_id) AS rank
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(floor(e * rank + u) - floor(e * (rank - 1) + u), ceil(e))::BIGINT * size)::BIGINT AS taken FROM r
"""
