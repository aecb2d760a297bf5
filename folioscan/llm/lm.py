"""Deleted interpolation: n-gram estimates mixed by context frequency, with weights learned on held-out counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, hash_words, mix64, save

#: Bytes of text that are counted and scored together; one block is one group of rows.
BLOCK_BYTES = 8 << 20
#: One block in so many is left out of the counts while the weights are learned, and supplies the held-out counts.
FOLD = 10
#: Steps per factor of two in which probabilities are told apart while the weights are learned; 255 stands for zero.
STEPS, NONE = 4, 255
#: Context frequencies are told apart by powers of two, up to this one.
LEVELS = 32
_END = np.uint64(0x5D1E5D1E5D1E5D1F)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z put in lower case, then of its end."""
    return np.append(hash_words((text or "").encode().lower().split()), _END)


def _grams(texts, order: int):
    """Token keys of every order along a block, and where its texts begin.  Ends stand before the first token."""
    per_text = [tokens(t) for t in texts]
    sizes = np.array([len(t) for t in per_text])
    w = np.concatenate(per_text)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(w)) - np.repeat(starts, sizes)
    keys, key = [], np.zeros(len(w), np.uint64)
    for n in range(1, order + 1):
        back = np.full(len(w), _END)
        back[n - 1 :] = w[: len(w) - n + 1]
        back[place < n - 1] = _END
        key = mix64(key * _MIX[0] + back * _MIX[1] + np.uint64(n) * _MIX[2])
        keys.append(key)
    return keys, starts, sizes


def _pack(x: np.ndarray) -> bytes:
    """Byte planes of 64-bit numbers: small and similar ones leave planes of zeros, which compress away."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _buckets(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Bounds that cut sorted keys into ``n`` ranges of the 64-bit numbers."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]]).astype(int)


def blocks_of(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, train, block) and the number of blocks, which grows with the bytes of text."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(FOLD, math.ceil(size / block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), n


def _count_block(order: int, n_buckets: int):
    """A block's distinct n-grams in key order, cut by key ranges, with their counts in its training texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("lm")
        keys, _, sizes = _grams(pdf.text, order)
        train = np.repeat(pdf.train.to_numpy(), sizes)
        out = []
        for n, key in enumerate(keys, 1):
            own, inverse = np.unique(key, return_inverse=True)
            count = np.bincount(inverse[train], minlength=len(own))
            cut = _buckets(own, n_buckets)
            for b in range(n_buckets):
                a, z = cut[b], cut[b + 1]
                if z > a:
                    out.append((n, b, int(pdf.block.iloc[0]), _pack(np.diff(own[a:z], prepend=np.uint64(0))), _pack(count[a:z])))
        return pd.DataFrame(out, columns=["n", "bucket", "block", "keys", "counts"])

    return run


def _sum_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums the counts of one key range over all blocks and answers every block for the keys it asked about.

    ``rest`` (for blocks of the fold) are the counts without the fold.
    """
    keys = [np.cumsum(_unpack(k), dtype=np.uint64) for k in pdf["keys"]]
    counts = np.concatenate([_unpack(c) for c in pdf.counts]).astype(np.int64)
    sizes = [len(k) for k in keys]
    fold = (pdf.block % FOLD == 0).to_numpy()
    own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.bincount(inverse, counts, len(own)).astype(np.int64)
    rest = total - np.bincount(inverse, counts * np.repeat(fold, sizes), len(own)).astype(np.int64)
    out, at = [], 0
    for k, (block, size) in enumerate(zip(pdf.block, sizes, strict=True)):
        mine = inverse[at : at + size]
        at += size
        sums = [int((total > 0).sum()), int(total.sum()), int((rest > 0).sum()), int(rest.sum())] if k == 0 else [0, 0, 0, 0]
        out.append((pdf.n.iloc[0], pdf.bucket.iloc[0], block, _pack(total[mine]), _pack(rest[mine]) if fold[k] else None, *sums))
    return pd.DataFrame(out, columns=["n", "bucket", "block", "total", "rest", "types", "tokens", "types_rest", "tokens_rest"])


def _answers(got: pd.DataFrame, order: int, what: str) -> list[np.ndarray]:
    """Counts per order, in key order, out of a block's answers."""
    got = got.sort_values(["n", "bucket"])
    return [np.concatenate([_unpack(x) for x in got[what][got.n == n]]).astype(np.int64) for n in range(1, order + 1)]


def _estimates(keys, starts, sizes, counts, n_tokens: int):
    """Per token: bucket of its context's frequency, and the maximum-likelihood estimate of every order."""
    order = len(keys)
    per = [c[np.unique(k, return_inverse=True)[1]] for k, c in zip(keys, counts, strict=True)]
    ends = starts + sizes - 1
    estimates = [per[0] / max(1, n_tokens)]
    bucket = np.zeros(len(per[0]), np.int64)
    for n in range(2, order + 1):
        context = np.zeros(len(per[0]), np.int64)
        context[1:] = per[n - 2][:-1]
        # the first token's context is an end, whose count is that of any text's end; no longer context precedes it
        context[starts] = per[0][ends] if n == 2 else 0
        estimates.append(per[n - 1] / np.maximum(context, 1))
        seen = context > 0
        bucket[seen] = (n - 1) * LEVELS + np.minimum(LEVELS - 1, np.log2(context[seen]).astype(np.int64))
    return per[0], bucket, estimates


def learn_weights(events: dict[tuple[int, ...], int], order: int, uniform: float, rounds: int = 60) -> dict[int, np.ndarray]:
    """Mixture weights per context bucket by expectation-maximisation.

    events: (bucket, step of each order's estimate) to held-out count.  Weights are for the uniform estimate, then
    orders 1 to ``order``.  Buckets without events take the weights of all events together.
    """

    def em(rows):
        n = np.array([c for _, c in rows], float)
        q = np.array([k[1:] for k, _ in rows])
        p = np.concatenate([np.full((len(rows), 1), uniform), np.where(q == NONE, 0.0, 2.0 ** (-q / STEPS))], axis=1)
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            share = p * w
            share *= (n / share.sum(axis=1))[:, None]
            w = np.maximum(share.sum(axis=0) / n.sum(), 1e-7)
            w /= w.sum()
        return w

    rows = list(events.items())
    out = {b: em([x for x in rows if x[0][0] == b]) for b in {k[0] for k, _ in rows}}
    out[-1] = em(rows) if rows else np.full(order + 1, 1 / (order + 1))
    return out


def interpolated(docs: DataFrame, train: Column, order: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows teach; the others are held out.  The probability of a token mixes the estimates of
    orders 1 to ``order`` and a uniform one over the known tokens and one unknown, with weights that hang on the
    frequency of the longest known context.  The weights are learned on the training texts of one block in FOLD, by
    counts without them (the deleted counts); the final counts have all training texts.  base_score adds one to token
    counts.  A null text is empty, with an end alone; repeated rows count as often as they occur; without training
    texts every score comes from the uniform estimate.

    Texts are dealt into blocks of a bounded size by hash.  A block sends its distinct n-grams, cut into key ranges;
    each range is summed by one task and every block gets the counts it asked for.  So a frequent word is one entry
    per block, nothing is held in full anywhere, and ranges grow in number with the text.
    """
    rows, n = blocks_of(docs, train, block_bytes)
    n_buckets = max(1, n // 2)
    asked = rows.groupBy("block").applyInPandas(_count_block(order, n_buckets), "n int, bucket int, block long, keys binary, counts binary")
    answers = asked.groupBy("n", "bucket").applyInPandas(_sum_bucket, "n int, bucket int, block long, total binary, rest binary, types long, tokens long, types_rest long, tokens_rest long")
    answers = save(answers, "lm-counts")
    s = answers.where("n = 1").agg(*[F.sum(c) for c in ("types", "tokens", "types_rest", "tokens_rest")]).first()
    types, total, types_rest, rest = [x or 0 for x in s]

    def learn(key, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        keys, starts, sizes = _grams(pdf.text, order)
        _, bucket, estimates = _estimates(keys, starts, sizes, _answers(got, order, "rest"), rest)
        with np.errstate(divide="ignore"):
            steps = [np.where(p > 0, np.minimum(NONE - 1, np.rint(-STEPS * np.log2(np.where(p > 0, p, 1)))), NONE).astype(np.int64) for p in estimates]
        code = bucket
        for q in steps:
            code = code * 256 + q
        found, count = np.unique(code[np.repeat(pdf.train.to_numpy(), sizes)], return_counts=True)
        return pd.DataFrame({"event": found, "n": count})

    fold = rows.where(F.col("block") % FOLD == 0).groupBy("block").cogroup(answers.where(F.col("block") % FOLD == 0).groupBy("block"))
    held = fold.applyInPandas(learn, "event long, n long").groupBy("event").agg(F.sum("n").alias("n")).collect()
    digits = lambda e: (e >> 8 * order, *((e >> 8 * (order - 1 - k)) & 255 for k in range(order)))
    weights = learn_weights({digits(r["event"]): r["n"] for r in held}, order, 1 / (types_rest + 1))
    table = np.tile(weights[-1], (LEVELS * order, 1))
    for b, w in weights.items():
        if b >= 0:
            table[b] = w

    def score(key, pdf: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in names})
        keys, starts, sizes = _grams(pdf.text, order)
        count, bucket, estimates = _estimates(keys, starts, sizes, _answers(got, order, "total"), total)
        w = table[bucket]
        p = w[:, 0] / (types + 1)
        for k, e in enumerate(estimates, 1):
            p = p + w[:, k] * e
        add = lambda x: np.add.reduceat(x, starts)
        base = np.log10((count + 1) / (total + types + 1))
        return pd.DataFrame({"doc_id": pdf.doc_id, "held_out": ~pdf.train, "n_tokens": sizes, "n_known": add((count > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(np.log10(p))})

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
