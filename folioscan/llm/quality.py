"""Quality rules whose cutoffs hold the false rejection of good documents below a bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, hash_words, rest, save

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Cutoffs that are tried for a signal: 0 to BINS - 2; a document is rejected if its signal's bin is above the cutoff.
BINS = 128
#: Signals, each a ratio times a scale, cut to whole bins.
SIGNALS = ("symbols", "dup_lines", "repeats", "long_words", "short_words", "capitals", "non_letters")
UPPER = bytes(range(65, 91))
LOWER_OR_HIGH = bytes(range(97, 123)) + bytes(range(128, 256))


def repeat_words(words: list[bytes], n: int = 8) -> int:
    """How many words lie in windows of ``n`` words that are found twice or more in the text, first ones included."""
    if len(words) <= n:
        return 0
    h, k = hash_words(words), len(words) - n + 1
    w = np.zeros(k, np.uint64)
    for i in range(n):
        w = w * np.uint64(0x9E3779B97F4A7C15) + (h[i : i + k] ^ (h[i : i + k] >> np.uint64(29)))
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + n, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the bin of every signal."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum([text.count(c) for c in SPACES])
    symbols = sum([text.count(c) for c in SYMBOLS])
    lines = [x for x in raw.split(b"\n") if x and x.split(None, 1)] if b"\n" in raw else ([raw] if words else [])
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = len(raw) - len(raw.translate(None, LOWER_OR_HIGH)) + upper
    solid = len(raw) - sum([raw.count(c) for c in SPACES.encode()])
    mean = chars / n if n else 0.0
    share = lambda a, b, scale: min(BINS - 1, int(scale * a / b)) if b else 0
    long = min(BINS - 1, int(4 * mean))
    return n, chars, symbols, dup, repeats, (share(symbols, n, 64), share(dup, len(lines), 126), share(repeats, n, 126), long, BINS - 1 - long, share(upper, letters, 126), share(solid - letters, solid, 126))


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the five counts of :func:`measure` and ``bins``; a null text has no words."""
    schema = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bins array<int>"

    def run(batches):
        claim("quality")
        for batch in batches:
            got = [measure(t.as_py()) for t in batch.column(2)]
            cols = list(zip(*got, strict=True)) if got else [[] for _ in range(6)]
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array([list(x) for x in cols[5]], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[x.split(" ")[0] for x in schema.split(", ")])
        rest()

    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("null"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("stratum"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), exactly summed; the upper bound of k of n is at most p iff this is at most delta."""
    if k >= n:
        return 1.0
    at = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return min(1.0, math.fsum(math.exp(at(i)) for i in range(k + 1)))


def choose(good: np.ndarray, bad: np.ndarray, alpha: float, delta: float, lift: float) -> int:
    """The strictest cutoff whose rejected part of good documents is below ``alpha`` with error ``delta``; else BINS - 1.

    good, bad: documents per bin.  A cutoff that rejects bad documents less than ``lift`` times as often as good ones
    says nothing about quality and is passed over.  Cutoffs are tested from the loosest on up to the first that fails,
    an order fixed before the labels are seen, so each may use the whole of ``delta``.
    """
    n, m, best = int(good.sum()), int(bad.sum()), BINS - 1
    for c in range(BINS - 2, -1, -1):
        k, j = int(good[c + 1 :].sum()), int(bad[c + 1 :].sum())
        if not n or k > alpha * n or binomial_tail(k, n, alpha) > delta:
            break
        if j and j / m >= lift * k / n:
            best = c
    return best


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, lift: float = 3.0) -> DataFrame:
    """stratum, cuts (one bin per signal), good and bad documents seen: from :func:`features` and labels (doc_id, quality).

    Each signal may falsely reject alpha / number of signals of a stratum's good documents, so all of them together
    reject at most alpha; each sequence of tests (strata times signals) gets delta / their number, so with probability
    1 - delta all bounds hold.  With s strata, one of fewer than ln(delta / 7s) / ln(1 - alpha / 7) good labels gets
    no cutoff: 1474 for 4 strata.  Labelled documents are summed per stratum, signal and bin, whose number
    does not grow with the documents.  Documents with several labels count as bad if one says so; null labels are
    left out; a stratum without labels gets no cutoffs, and its documents stay.
    """
    truth = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = rows.where("not base_failed").join(truth, "doc_id").select("stratum", "quality", F.posexplode("bins").alias("signal", "bin"))
    counts = save(held.groupBy("stratum", "signal", "bin").agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad")), "quality-counts")
    tests = max(1, counts.select("stratum").distinct().count()) * len(SIGNALS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("quality")
        cuts, seen = [], (0, 0)
        for s in range(len(SIGNALS)):
            x = pdf[pdf.signal == s]
            good = np.bincount(x["bin"], x.good, BINS).astype(np.int64)
            bad = np.bincount(x["bin"], x.bad, BINS).astype(np.int64)
            seen = (int(good.sum()), int(bad.sum()))
            cuts.append(choose(good, bad, alpha / len(SIGNALS), delta / tests, lift))
        return pd.DataFrame({"stratum": [pdf.stratum.iloc[0]], "cuts": [cuts], "good": [seen[0]], "bad": [seen[1]]})

    return counts.groupBy("stratum").applyInPandas(run, "stratum string, cuts array<int>, good long, bad long")


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and ``failed`` (names of the signals above their cutoff).

    ``docs``: doc_id, text and the stratum's column.  A document fails the base if it has fewer than 20 words, or if
    over 30 % of them lie in repeated windows.  Null and empty texts have no words, so they fail it.  Repeated rows
    get equal verdicts; an empty table gives none.
    """
    rows = features(docs, stratum).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rows = save(rows, "quality-features")
    cuts = save(cutoffs(rows, labels, alpha, delta), "quality-cutoffs").select("stratum", "cuts")
    names = F.array(*[F.lit(s) for s in SIGNALS])
    over = F.transform(F.filter(F.arrays_zip(names.alias("name"), F.col("bins").alias("bin"), F.col("cuts").alias("cut")), lambda x: x["bin"] > x["cut"]), lambda x: x["name"])
    out = rows.join(cuts, "stratum", "left").withColumn("failed", F.when(F.col("cuts").isNotNull(), over).otherwise(F.array().cast("array<string>")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")
