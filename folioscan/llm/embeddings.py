"""Near-duplicate embeddings: random-hyperplane tables, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, components, rest, save

#: Signs of a hash table, at least; the vectors of a label for which these do, four times BLOCK to a bucket.  Twice as
#: many vectors take a sign more, so that buckets keep their size.
SIGNS, FEW = 8, 1 << 18
#: A pair at cosine 0.93 agrees in a sign with this probability, and is missed by all tables with MISSED at most.
AGREE, MISSED = 1 - math.acos(0.93) / math.pi, 0.0009
#: Vectors of one bucket that are compared as one block; larger buckets are compared block by block.
BLOCK = 1024


def signs_for(n: int) -> int:
    """Signs of a table for a label of ``n`` vectors."""
    return SIGNS + max(0, math.ceil(math.log2(max(1, n) / FEW)))


def tables_for(signs: int) -> int:
    """Tables that leave a pair at cosine 0.93 unmet with MISSED at most: 16 of 8 signs, 52 of 16."""
    return math.ceil(math.log(MISSED) / math.log(1 - AGREE**signs))


def planes(dim: int, tables: int, signs: int, seed: int = 9) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * signs))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _labels_of(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index reachable in a symmetric boolean matrix with a true diagonal."""
    lab = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, lab[None, :], len(lab)).min(axis=1)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _compare(ids, mult, x, keys, table: int, least: float, half: int | None):
    """Links inside a block, or between its first ``half`` vectors and the rest: (id, links, representative id).

    A pair is counted in the first table that it shares only.
    """
    n = len(ids)
    link = (x @ x.T) >= least
    for t in range(table):
        link &= keys[:, t][:, None] != keys[:, t][None, :]
    if half is not None:
        link[:half, :half] = False
        link[half:, half:] = False
    np.fill_diagonal(link, False)
    links = link @ mult
    if not links.any():
        return None
    lab = _labels_of(link | np.eye(n, dtype=bool))
    some = np.flatnonzero(links > 0)
    return ids[some], links[some], ids[lab[some]]


def near_vectors(rows: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``rows`` (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null and their cosine, in double precision, is at least
    ``least``.  Vectors that are null, zero, or hold null or non-finite components link with nothing; so do those of
    other lengths.  Equal vectors of a label count as one with a number of copies until the end; rows that repeat a
    vec_id are vectors of their own.  n_links counts linked vectors; component_id is the smallest vec_id that links
    reach; kept says whether it is the vector's own.  A null vec_id is a vector like others, but its component_id is
    that of the others it reaches or null.

    An empty table gives none; other columns are ignored.

    Each vector goes to one bucket in each of several tables, by label and the signs of random projections.  Their
    number grows with the logarithm of a label's vectors, and the tables with it so that recall at 0.93 stays
    above 0.999; so buckets do not grow with the table, and work grows little faster than the vectors.  In a bucket all cosines are taken as matrix products in blocks of BLOCK vectors; blocks of one bucket lie in different
    tasks.  A block yields sums of links per vector and one edge to a representative, never pairs.
    """
    exact = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(exact).alias("x"), F.col("label").cast("long").alias("label"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("x", lambda c: c != 0)
    key = F.when(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)), F.struct("label", F.size("x").alias("dim"), F.xxhash64("x").alias("a"), F.xxhash64(F.lit(7), "x", F.lit(1)).alias("b")))
    rows = rows.withColumn("key", key)
    reps = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("x").alias("x"))
    reps = save(reps.where("rep is not null").select("key", "rep", "mult", "x"), "embeddings-reps")
    reps_of = reps.select("rep", "mult", F.col("key.label").alias("label"), F.col("key.dim").alias("dim"), "x")
    more = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / FEW))).cast("int")
    signs = save(reps_of.groupBy("label", "dim").agg((SIGNS + more).alias("signs")), "embeddings-signs")
    bucketed = save(_hash(reps_of.join(signs, ["label", "dim"]), exact), "embeddings-keys")
    sent = bucketed.select("rep", "mult", "label", "dim", "x", "keys", F.posexplode("keys").alias("t", "k"))
    large = save(sent.groupBy("label", "dim", "t", "k").count().where(F.col("count") > BLOCK).select("label", "dim", "t", "k", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "embeddings-large")
    sent = sent.join(large, ["label", "dim", "t", "k"], "left")
    mine = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    sent = sent.withColumn("mine", mine).withColumn("other", other).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    places = ["label", "dim", "t", "k", "lo", "hi"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(n, *places).sortWithinPartitions(*places)
    found = save(sent.select(*places, "mine", "rep", "mult", "x", "keys").mapInPandas(_blocks(least), "rep long, links long, to long"), "embeddings-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("u"), F.col("to").alias("v")), "embeddings-components")
    done = reps.select("key", "rep", "mult").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    done = save(done.select("key", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "embeddings-done")
    out = rows.select("vec_id", "key").join(done, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _hash(reps: DataFrame, exact: str) -> DataFrame:
    def run(frames):
        claim("embeddings")
        for pdf in frames:
            for (dim, signs), part in pdf.groupby(["dim", "signs"], sort=False):
                tables, powers = tables_for(int(signs)), 1 << np.arange(int(signs))
                bits = (_unit(part.x) @ planes(int(dim), tables, int(signs)) > 0).reshape(len(part), tables, int(signs))
                yield part.drop(columns="signs").assign(keys=list((bits * powers).sum(axis=2)))
        rest()

    return reps.select("rep", "mult", "label", "dim", "signs", "x").mapInPandas(run, f"rep long, mult long, label long, dim int, x {exact}, keys array<long>")


def _blocks(least: float):
    places = ["label", "dim", "t", "k", "lo", "hi"]

    def one(part: pd.DataFrame):
        if len(part) < 2:
            return None
        lo, hi, t = int(part.lo.iloc[0]), int(part.hi.iloc[0]), int(part.t.iloc[0])
        half = None
        if lo != hi:
            part = pd.concat([part[part.mine == lo], part[part.mine == hi]])
            half = int((part.mine == lo).sum())
        return _compare(part.rep.to_numpy(), part.mult.to_numpy(), _unit(part.x), np.stack(part["keys"].to_numpy()), t, least, half)

    def run(frames):
        claim("embeddings")
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            p = pdf[places].to_numpy()
            cuts = np.flatnonzero((p[1:] != p[:-1]).any(axis=1)) + 1
            if not len(cuts):
                held = pdf
                continue
            yield from collect(pdf, [0, *cuts])
            held = pdf.iloc[cuts[-1] :]
        if held is not None and len(held):
            yield from collect(held, [0, len(held)])
        rest()

    def collect(pdf, bounds):
        got = [g for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1 and (g := one(pdf.iloc[a:b])) is not None]
        if got:
            yield pd.DataFrame({"rep": np.concatenate([g[0] for g in got]), "links": np.concatenate([g[1] for g in got]), "to": np.concatenate([g[2] for g in got])})

    return run
