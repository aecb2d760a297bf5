"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import base64
import functools
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, rest, save

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: At most so many documents and bytes of a language are fitted on, those with the smallest hashes; a documented bound.
FIT_DOCS, FIT_BYTES = 3000, 32 << 20
#: Steps per factor of two in which the hash is found that keeps to this bound.
HASH_STEPS = 64
#: Bytes of words that are summed many at a time; longer ones go one by one, unless so many of a length come together.
WORD_BYTES, MANY = 40, 100
#: Words that a worker remembers, words whose sums are taken together, and characters of texts.
KNOWN_WORDS, WORDS_AT_ONCE, CHARS_AT_ONCE = 150_000, 4_000, 600_000
#: Languages that are scored in one pass; more take further passes.
LANGS_AT_ONCE = 32
UNDETERMINED = "und"
#: Share of words that are taken to come from no language in particular, so that a passage in another language, or a
#: few words that a language hardly knows, cannot outweigh the rest of a text.
ELSEWHERE = 0.1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SCALE, _RESCALE = 1024.0, 24  # per byte, against underflow; every so many bytes the sums are brought back to one
_RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters; numbers that are no digits (such as one half) part them like other signs."""
    found = _RUNS(text)
    if text.isascii():
        return found
    return [x for w in found for x in ((w,) if w.isalpha() else "".join([c if c.isalpha() else " " for c in w]).split())]


def _in_words(piece: bytes) -> bool:
    """Whether a piece can be part of a word in lower case with a blank before it; characters cut in two may be any."""
    letters = piece.decode(errors="ignore").removeprefix(" ")
    return not letters or (letters.isalpha() and letters == letters.lower())


class Pieces:
    """A fixed vocabulary of byte strings, looked up many at a time by polynomial hashes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        pieces = sorted(found | {bytes([b]) for b in range(256)})
        self.longest = max(len(p) for p in pieces if _in_words(p))
        self.id = {p: i for i, p in enumerate(pieces)}
        self.n = len(pieces)
        with np.errstate(over="ignore"):
            keys = np.array([functools.reduce(lambda h, b: (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF, p, 0) for p in pieces], np.uint64)
        self.tables = []  # each holds what fits without collisions; the rest goes to the next
        left, bits = np.arange(self.n), 20
        for mult in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            mult, shift = np.uint64(mult), np.uint64(64 - bits)
            slot = (keys[left] * mult) >> shift
            _, first = np.unique(slot, return_index=True)
            at, key = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
            at[slot[first]], key[slot[first]] = left[first], keys[left[first]]
            self.tables.append((mult, shift, at, key))
            left, bits = np.delete(left, first), 16
            if not len(left):
                break
        else:
            raise ValueError("the vocabulary does not fit the lookup tables")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 for those of no piece."""
        out = np.full(len(h), -1, np.int32)
        for k, (mult, shift, at, key) in enumerate(self.tables):
            if k == 0:
                slot = (h * mult) >> shift
                hit = key[slot] == h
                out[hit] = at[slot[hit]]
                rest = np.flatnonzero(~hit)
            else:
                slot = (h[rest] * mult) >> shift
                hit = (key[slot] == h[rest]) & (at[slot] >= 0)
                out[rest[hit]] = at[slot[hit]]
        return out

    def grid(self, words: list[bytes]):
        """For words of one length: (i, j, rows, pieces) for every span that is a piece in some of them."""
        n = len(words[0])
        b = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n).astype(np.uint64) + np.uint64(1)
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _BASE + b[:, j - 1]
                p = self.find(h)
                rows = np.flatnonzero(p >= 0)
                if len(rows):
                    yield i, j, rows, p[rows]


@functools.lru_cache(maxsize=1)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


def spell(word: str) -> bytes:
    return b" " + word.encode()


def forward(v: Pieces, words: list[bytes], prob: np.ndarray) -> np.ndarray:
    """Natural log probability of each word under each language: the sum over all its segmentations into pieces.

    prob: pieces x languages.  Words are taken together by length; few long ones of a length one by one.
    """
    out = np.zeros((len(words), prob.shape[1]))
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, ks in by.items():
        if n > WORD_BYTES and (len(ks) < MANY or n > 64 * WORD_BYTES):
            for k in ks:
                out[k] = _forward_long(v, words[k], prob)
            continue
        together = max(1, WORDS_AT_ONCE * WORD_BYTES // max(n, WORD_BYTES))
        for a in range(0, len(ks), together):
            some, at = ks[a : a + together], 0
            alpha, logs = np.zeros((n + 1, len(some), prob.shape[1])), np.zeros(len(some))
            alpha[0] = 1.0
            for i, j, rows, p in v.grid([words[k] for k in some]):
                if i >= at + _RESCALE:  # what begins at i is complete; all that is still open begins here or further on
                    at, top = i, alpha[i].max(axis=1)
                    alpha[i : i + v.longest + 1] /= top[:, None]
                    logs += np.log(top)
                alpha[j, rows] += alpha[i, rows] * prob[p] * _SCALE ** (j - i)
            with np.errstate(divide="ignore"):
                out[some] = np.maximum(np.log(alpha[n]), -700.0) + logs[:, None] - n * math.log(_SCALE)
    return out


def _forward_long(v: Pieces, w: bytes, prob: np.ndarray) -> np.ndarray:
    window, logs = [np.ones(prob.shape[1])], np.zeros(prob.shape[1])  # the last sums, relative to exp(logs)
    for j in range(1, len(w) + 1):
        s = np.zeros(prob.shape[1])
        for m in range(1, min(len(window), v.longest) + 1):
            p = v.id.get(w[j - m : j])
            if p is not None:
                s += window[-m] * prob[p]
        window = [*window[-v.longest + 1 :], s]
        if s.max() < 1e-100:
            top = np.maximum(s, 1e-300)
            window, logs = [x / top for x in window], logs + np.log(top)
    return logs + np.log(window[-1])


def _parts(word: bytes) -> list[bytes]:
    """A word that is fitted on, in parts of WORD_BYTES at most, cut between characters: all of a long run teaches."""
    out = []
    while len(word) > WORD_BYTES:
        k = WORD_BYTES
        while k > WORD_BYTES - 4 and word[k] & 0xC0 == 0x80:
            k -= 1
        out.append(word[:k])
        word = word[k:]
    return [*out, word]


def fit(v: Pieces, counts: dict[bytes, int], rounds: int = 3, floor: float = 0.01) -> np.ndarray:
    """Piece probabilities of one language from word counts: expected piece counts over all segmentations, re-estimated."""
    prob = np.full(v.n, 1.0 / v.n)
    part_counts: Counter = Counter()
    for w, n in counts.items():
        for p in _parts(w):
            part_counts[p] += n
    by: dict[int, list[bytes]] = {}
    for w in part_counts:
        by.setdefault(len(w), []).append(w)
    for _ in range(rounds):
        expected = np.full(v.n, floor)
        for n, every in by.items():
            for a in range(0, len(every), WORDS_AT_ONCE):
                words = every[a : a + WORDS_AT_ONCE]
                times = np.array([part_counts[w] for w in words], float)
                spans = list(v.grid(words))
                alpha, beta = np.zeros((n + 1, len(words))), np.zeros((n + 1, len(words)))
                alpha[0] = beta[n] = 1.0
                for i, j, rows, p in spans:
                    alpha[j, rows] += alpha[i, rows] * prob[p] * _SCALE ** (j - i)
                for i, j, rows, p in reversed(spans):
                    beta[i, rows] += beta[j, rows] * prob[p] * _SCALE ** (j - i)
                share = times / np.maximum(alpha[n], 1e-300)
                for i, j, rows, p in spans:
                    expected += np.bincount(p, alpha[i, rows] * prob[p] * _SCALE ** (j - i) * beta[j, rows] * share[rows], v.n)
        prob = expected / expected.sum()
    return prob


def _chosen(rows: DataFrame, fit_docs: int, fit_bytes: int) -> DataFrame:
    """lang, text: rows of each language (lang, text, h) from the smallest hash on, up to ``fit_docs`` and ``fit_bytes``.

    Hashes are told apart by their size in HASH_STEPS steps per factor of two.  Rows and bytes are summed per language
    and step (map-side, some thousand sums a language however many rows there are); the last step that keeps to both
    bounds ends the choice, at the first one if none does.  Equal rows (id, text) count for the bound but teach once.
    """
    size = F.greatest(F.lit(1.0), F.shiftrightunsigned("h", 1).cast("double"))
    rows = rows.withColumn("step", F.floor(F.log2(size) * HASH_STEPS).cast("int"))
    upto = Window.partitionBy("lang").orderBy("step")
    sums = rows.groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sums = sums.withColumn("docs", F.sum("n").over(upto)).withColumn("bytes", F.sum("bytes").over(upto)).withColumn("k", F.row_number().over(upto))
    within = ((F.col("docs") <= fit_docs) & (F.col("bytes") <= fit_bytes)) | (F.col("k") == 1)
    bound = save(sums.where(within).groupBy("lang").agg(F.max("step").alias("last")), "langid-bound")
    return rows.join(bound, "lang").where("step <= last").dropDuplicates(["lang", "h"]).select("lang", "text")


def train(docs: DataFrame, learn: Column, path: str = VOCABULARY, fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """lang, prob (array by piece): fitted on rows where ``learn`` holds, on a bounded number of them.

    ``docs``: doc_id, text, lang; other columns are ignored.  Rows with null text or lang teach nothing; an empty table,
    or one without a language, gives no model.  The documents of a language are those with the smallest hashes of id
    and text: at most ``fit_docs`` of them, of ``fit_bytes`` bytes together, and one at least; a first pass finds the
    hash that bounds them, a second reads their texts and counts their words where they are; a language is fitted on
    the sums.  Words of any length teach, long runs in parts.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("h"), F.coalesce(learn, F.lit(False)).alias("learn"))
    rows = rows.where("learn and lang is not null and text is not null").drop("learn")

    def count(batches):
        claim("langid", _free)
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text.as_py().lower()))
            cells = [(lang, w, n) for lang, c in found.items() for w, n in c.items()] or [(None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])
        rest()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("langid", _free)
        prob = fit(vocabulary(path), {spell(w): n for w, n in zip(pdf.word, pdf.n, strict=True)})
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "prob": [prob]})

    counts = _chosen(rows, fit_docs, fit_bytes).mapInArrow(count, "lang string, word string, n long").where("lang is not null")
    return save(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).groupBy("lang").applyInPandas(run, "lang string, prob array<double>"), "langid-model")


def predict(docs: DataFrame, model: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """All columns of ``docs`` in the column ``row``, and lang_pred and score: the likeliest language and its posterior.

    Only the text is looked at, whatever other columns are named.  It is put in lower case and cut into runs of
    letters; what stands between is left out.  A null text, or one without letters, is ``und`` with score 0; so is
    every text if no language was learned.  Repeated rows get equal results, of equal likelihoods the first language by
    name wins, and an empty table gives none.  Texts are scored whole, long ones too: a word's probability is its
    language's, or with the chance ELSEWHERE that of all languages' mean.  Models come to each worker as piece
    probabilities, whose size is bounded by the fixed vocabulary and LANGS_AT_ONCE; more languages are scored in
    further passes, of which the best and the sum are taken.
    """
    langs = [r[0] for r in model.select("lang").orderBy("lang").collect()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if not langs:
        return docs.select(row, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    passes = [langs[a : a + LANGS_AT_ONCE] for a in range(0, len(langs), LANGS_AT_ONCE)]
    total = 0.0
    for names in passes:
        total = total + sum(np.array(r[0]) for r in model.where(F.col("lang").isin(names)).select("prob").collect())
    out = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))
    for k, names in enumerate(passes):
        found = {r["lang"]: r["prob"] for r in model.where(F.col("lang").isin(names)).collect()}
        shared = docs.sparkSession.sparkContext.broadcast((names, np.array([*(found[x] for x in names), total / len(langs)]).T.copy()))
        out = out.withColumn(f"p{k}", _scorer(shared, path)(F.col("text")))
    every = F.filter(F.array(*[F.col(f"p{k}") for k in range(len(passes))]), lambda p: p["lang"].isNotNull())
    top = F.array_max(F.transform(every, lambda p: p["top"]))
    best = F.filter(every, lambda p: p["top"] == F.array_max(F.transform(every, lambda q: q["top"])))
    out = out.select("row", F.get(best, F.lit(0))["lang"].alias("lang"), top.alias("top"), F.transform(every, lambda p: p["total"]).alias("sums"))
    share = 1 / F.aggregate("sums", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))
    return out.select("row", F.coalesce("lang", F.lit(UNDETERMINED)).alias("lang_pred"), F.when(F.col("lang").isNotNull(), F.least(share, F.lit(1.0))).otherwise(0.0).alias("score"))


_known: tuple = (None, {}, None)


def _scorer(shared, path: str):
    """lang, top, total of a text: the likeliest of the shared languages, its log likelihood, and that of all together.

    Only texts go to the workers and only three values come back; the rest of a row stays where it is.
    """

    @F.arrow_udf("struct<lang:string,top:double,total:double>")
    def score(text: pa.Array) -> pa.Array:
        return _score(text, shared, path)

    return score


def _free() -> None:
    global _known
    _known = (None, {}, None)
    vocabulary.cache_clear()


def _score(text: pa.Array, shared, path: str) -> pa.Array:
    global _known
    claim("langid", _free)
    v, (names, prob) = vocabulary(path), shared.value
    if _known[0] is not names:
        _known = (names, {}, np.zeros((KNOWN_WORDS, len(names))))
    out, at, n = [], 0, len(text)
    while at < n:
        end, size = at, 0
        while end < n and (end == at or size < CHARS_AT_ONCE):
            size += len(text[end].as_py() or "")
            end += 1
        out += _score_some(text.slice(at, end - at), v, names, prob)
        at = end
    rest()
    return pa.array([None if x is None else {"lang": x[0], "top": x[1], "total": x[2]} for x in out], pa.struct([("lang", pa.string()), ("top", pa.float64()), ("total", pa.float64())]))


def _score_some(texts: pa.Array, v: Pieces, names: list, prob: np.ndarray) -> list[tuple | None]:
    tokens = [words_of(t.lower()) if (t := x.as_py()) else [] for x in texts]
    sizes = np.array([len(t) for t in tokens])
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [w for t in tokens for w in t]
    codes, unique = pd.factorize(flat)
    _, row_of, table = _known
    if len(row_of) + len(unique) > KNOWN_WORDS:
        row_of.clear()
    fresh = [w for w in unique if w not in row_of]
    logs = np.zeros((0, len(names)))
    if fresh:
        logs = forward(v, [spell(w) for w in fresh], prob)
        logs = np.logaddexp(logs[:, :-1] + math.log(1 - ELSEWHERE), logs[:, -1:] + math.log(ELSEWHERE))
    if len(fresh) <= KNOWN_WORDS:
        table[len(row_of) : len(row_of) + len(fresh)] = logs
        row_of.update(zip(fresh, range(len(row_of), len(row_of) + len(fresh)), strict=True))
        per_word = table[[row_of[w] for w in unique]] if len(unique) else logs
    else:
        per_word = logs
    found: list[tuple | None] = [None] * len(sizes)
    has = np.flatnonzero(sizes > 0)
    if len(has):
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[has]
        sums = np.add.reduceat(per_word[codes], starts, axis=0)
        best = sums.argmax(axis=1)
        top = sums[np.arange(len(has)), best]
        total = top + np.log(np.exp(sums - top[:, None]).sum(axis=1))
        for k, j, t, s in zip(has, best, top, total, strict=True):
            found[k] = (names[j], float(t), float(s))
    return found
