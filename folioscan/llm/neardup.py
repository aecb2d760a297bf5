"""Near-duplicate documents: ProbMinHash of weighted word shingles, banding, exact verification, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, components, drop_saved, hash_words, mix64, rest, save

#: Words of a shingle, least similarity, bands and registers of a band.  A pair whose shingle sets have a similarity of
#: 0.8, the measure that decides, meets in a band with probability 0.99997, a pair at 0.3 with 0.06.
SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 26, 5
#: Documents that meet as many in one task of the last step, and their shingles.
BLOCK, BLOCK_SHINGLES = 192, 2 << 20
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of the whole if there are fewer, none if there are none."""
    words = hash_words((text or "").encode().split())
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = mix64(h * _C[0] + words[i : len(words) - n + 1 + i])
    return h


def prob_min_hash(h: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """The element that wins each of ``m`` registers.

    Every element is a Poisson process of points in time whose rate is its weight; each point falls into a random
    register, which the earliest point wins.  Two sketches agree in a register with the probability Jaccard similarity
    of the weights.  Points after the latest register's time can win nothing, so a process ends there.
    """
    time, winner = np.full(m, np.inf), np.zeros(m, np.uint64)
    t, live, step = np.zeros(len(h)), np.arange(len(h)), 0
    while len(live):
        c = max(1, min(64, m // len(live)))
        i = (np.arange(step, step + c, dtype=np.uint64) + np.uint64(1))[None, :]
        step += c
        x = mix64(h[live][:, None] + i * _C[1])
        gaps = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live][:, None]
        at = t[live][:, None] + np.cumsum(gaps, axis=1)
        t[live] = at[:, -1]
        good = np.flatnonzero(at.ravel() < time.max())
        if len(good):
            k = (mix64(x.ravel()[good] ^ _C[2]) % np.uint64(m)).astype(np.int64)
            when = at.ravel()[good]
            order = np.lexsort((when, k))
            k, good, when = k[order], good[order], when[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            k, good, when = k[first], good[first], when[first]
            better = when < time[k]
            time[k[better]], winner[k[better]] = when[better], h[live[good[better] // c]]
        live = live[t[live] < time.max()]
    return winner


def sketch(text: str | None, bands: int = BANDS, rows: int = ROWS):
    """Number of distinct shingles and a key per band.

    Bands come from a sketch in which every shingle weighs one, which estimates the similarity of the sets; where
    shingles repeat, as many more come from one with the weights 1 + ln(occurrences).  So texts that differ in how
    often a passage stands in them meet by what they hold, and texts with the same repeats by either.
    """
    h, n = np.unique(shingles(text), return_counts=True)
    if not len(h):
        return 0, None
    weights = [np.ones(len(h))] + ([1 + np.log(n)] if n.max() > 1 else [])
    key = np.arange(bands * len(weights), dtype=np.uint64)
    won = [prob_min_hash(h, w, bands * rows) for w in weights]
    for r in range(rows):
        key = mix64(key * _C[3] + np.concatenate([x[r::rows] for x in won]))
    return len(h), key.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, same binary, size int, keys array<long>"

    def run(batches):
        claim("neardup")
        for batch in batches:
            got = [sketch(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["doc_id", "same", "size", "keys"])
        rest()

    return docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), "text").mapInArrow(run, schema)


def jaccard(a: str, b: str) -> float:
    x, y = np.unique(shingles(a)), np.unique(shingles(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def _verify(pairs: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v: ids of documents) whose shingle sets are similar enough.  Reads only their texts."""
    needed = save(pairs.select("u").union(pairs.select("v")).distinct().select(F.col("u").alias("doc_id")), "near-needed")
    texts = save(docs.join(needed, "doc_id", "left_semi"), "near-texts")

    def run(batches):
        claim("neardup")
        held: tuple = ("", None)
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                b = b.as_py()
                if held[0] != b:  # pairs of one document tend to come together
                    held = (b, np.unique(shingles(b)))
                x, y = np.unique(shingles(a.as_py())), held[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
        rest()

    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")
    links = save(both.mapInArrow(run, "u long, v long"), "near-links")
    drop_saved(needed, texts)
    return links


def _compare_blocks(group: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """Links between members of a hub's group that are apart from it and all its members.

    group: hub, rep, apart, parts and wholes (blocks of those apart, and of all).  Each block of those apart meets each
    block of all in one task, which counts common shingles by matrix products and returns links only.
    """
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ours = group.where("apart").select("hub", "rep", F.lit(True).alias("ours"), spot("parts").alias("i"), every("wholes").alias("j"))
    theirs = group.select("hub", "rep", F.lit(False).alias("ours"), spot("wholes").alias("j"), every("parts").alias("i"))
    rows = ours.unionByName(theirs)
    needed = save(group.select(F.col("rep").alias("doc_id")).distinct(), "near-needed")
    texts = save(docs.join(needed, "doc_id", "left_semi"), "near-texts")
    rows = rows.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("neardup")
        ours = pdf.ours.to_numpy()
        ids, sets = pdf.rep.to_numpy(), [np.unique(shingles(t)) for t in pdf.text]
        n = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        in_ours = np.bincount(column, ours[owner]) > 0
        in_both = in_ours & (np.bincount(column, ~ours[owner]) > 0)
        keep = in_both[column]
        owner, column = owner[keep], (np.cumsum(in_both) - 1)[column[keep]]
        row = np.where(ours, np.cumsum(ours), np.cumsum(~ours)) - 1
        both = np.zeros((ours.sum(), (~ours).sum()), np.float32)
        for a in range(0, int(in_both.sum()), 8192):
            some = (column >= a) & (column < a + 8192)
            o, c = owner[some], column[some] - a
            left, right = np.zeros((both.shape[0], 8192), np.float32), np.zeros((both.shape[1], 8192), np.float32)
            mine = ours[o]
            left[row[o[mine]], c[mine]] = 1
            right[row[o[~mine]], c[~mine]] = 1
            both += left @ right.T
        u, v, nu, nv = ids[ours], ids[~ours], n[ours], n[~ours]
        x, y = np.nonzero((both >= least * (nu[:, None] + nv[None, :] - both.astype(np.float64)) - 1e-9) & (u[:, None] != v[None, :]))
        every, lab = np.concatenate([u, v]), np.arange(len(u) + len(v))
        y = y + len(u)
        while len(x) and (lab[x] != lab[y]).any():
            least_of = np.minimum(lab[x], lab[y])
            np.minimum.at(lab, x, least_of)
            np.minimum.at(lab, y, least_of)
        some = np.flatnonzero(lab != np.arange(len(lab)))  # what is linked, tied to one of its own: not all pairs
        return pd.DataFrame({"u": every[some], "v": every[lab[some]]})

    more = save(rows.groupBy("hub", "i", "j").applyInPandas(run, "u long, v long"), "near-more")
    drop_saved(needed, texts)
    return more


def near_documents(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id), n_shingles: a row per row of ``docs``.

    ``docs``: doc_id, text.  Two documents are linked if the sets of their 5-word shingles have a Jaccard similarity
    of at least ``least``; classes are what links connect.  Texts without words (null, empty, blank) are in classes of
    their own; rows that share a doc_id count as one document; rows without a doc_id link with nothing and are kept.

    Long texts are sketched and compared whole.  Equal texts are one document from the start, by 128 bits of hash.  In each bucket of a band all members are compared with one of them,
    the one that shares most buckets, so a bucket of n costs n - 1 pairs; what that connects, across all bands, is
    one component.  Members of a bucket that are not in the component of that one are then compared with all its
    buckets' members, in blocks whose common shingles are counted by matrix products; only links come out.  In
    groups of true copies nothing is left for this.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = save(_sketches(docs), "near-sketches")
    words = rows.where("size > 0 and doc_id is not null")
    reps = save(words.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("size", "keys"), "doc_id").alias("s")).select("same", "rep", "s.*"), "near-reps")
    banded = reps.select("rep", "size", F.posexplode("keys").alias("band", "key")).select("rep", "size", F.xxhash64("band", "key").alias("key"))
    shared = save(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
    members = save(banded.join(shared, "key"), "near-members")
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    degree = save(degree, "near-degree")
    ranked = members.join(degree, "rep")
    hubs = save(ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("rep"), "size")).alias("h")).select("key", (-F.col("h.rep")).alias("hub"), F.col("h.size").alias("hub_size")), "near-hubs")
    fits = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b)
    stars = members.join(hubs, "key").where((F.col("rep") != F.col("hub")) & fits(F.col("size"), F.col("hub_size")))
    stars = save(stars.select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct(), "near-stars")
    links = _verify(stars, docs, least)
    first = save(components(links, "near-first"), "near-first-found")

    of = first.select(F.col("id").alias("rep"), "component")
    group = members.join(hubs, "key").select("hub", "rep", "size").distinct().join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    group = save(group, "near-groups")
    drop_saved(shared, degree, members, hubs, stars)
    # The hub's component is found in its group, since it is a member of its own buckets.
    of_hub = group.where("hub = rep").select("hub", F.col("component").alias("hub_component"))
    named = group
    group = save(group.join(of_hub, "hub").select("hub", "rep", "size", (F.col("component") != F.col("hub_component")).alias("apart")), "near-apart")
    sizes = group.groupBy("hub").agg(F.count("*").alias("n"), F.sum("size").alias("held"), F.count_if("apart").alias("m"), F.sum(F.when(F.col("apart"), F.col("size"))).alias("held_apart")).where("m > 0")
    blocks = lambda n, held: F.greatest(F.ceil(F.col(n) / BLOCK), F.least(F.col(n), F.ceil(F.col(held) / BLOCK_SHINGLES))).cast("int")
    sizes = save(sizes.select("hub", blocks("m", "held_apart").alias("parts"), blocks("n", "held").alias("wholes")), "near-sizes")
    found = first
    if sizes.limit(1).count():
        more = _compare_blocks(group.join(sizes, "hub"), docs, least)
        found = components(links.union(more), "near-second")

    done = reps.select("same", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("same", F.coalesce("component", "rep").alias("class_id"))
    done = save(done, "near-done")
    drop_saved(reps, links, named, group, sizes)
    out = rows.select("doc_id", "same", "size").join(done, "same", "left")
    of = F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", of.alias("class_id"), F.coalesce(F.col("doc_id") == of, F.lit(True)).alias("kept"), F.col("size").cast("long").alias("n_shingles"))
