"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import bpe, embeddings, langid, lengths, lines, lm, mixing, neardup, quality, warc
from folioscan.llm.common import components, crc_mod

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, key string, n_tokens int, block int, id int"
RND = random.Random(5)
VOCAB = ["".join(RND.choices("abcdefghij", k=RND.randint(2, 7))) for _ in range(400)]


def prose(n, rnd=RND):
    return " ".join(rnd.choices(VOCAB, k=n))


BODY = prose(120)
TEXTS = [
    BODY, BODY, BODY.replace(" ", "  ", 1), BODY + " extra", None, "", "  \n\t ", "one", "a b c d e", "\x85\xa0\x1c odd spaces",
    "line of text that is shared by many documents\n" + prose(30), "line of text that is shared by many documents\n" + prose(30), "line of text that is shared by many document\n" + prose(25),
    "line of text thatXis shared by many documents", prose(9000), "x" * 60_000, "tok " * 4000, "<|endoftext|> inside <|endoftext|>", "ünï çödé \U0001f600 中文", "same\nsame\n\nsame",
]


def rows():
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "é"][i % 4], 1, 2, "r", "k", 3, 4, 5) for i, t in enumerate(TEXTS)]
    return [*out, out[0], (None, "no id here at all", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_lm(spark, docs, none):
    got = lm.interpolated(docs, crc_mod("doc_id", 7) != 2, block_bytes=20_000).collect()
    assert len(got) == len(rows())
    tok = lambda t: [w for w in words((t or "").encode().lower().decode())] + [None]
    in_train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    count = collections.Counter(w for r in rows() if in_train(r[0]) for w in tok(r[1]))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for r in rows():
        t = tok(r[1])
        want[(r[0], not in_train(r[0]), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.interpolated(none, crc_mod("doc_id", 7) != 2).count() == 0
    held = lm.interpolated(docs, F.lit(False)).collect()
    assert len(held) == len(rows()) and all(r.n_known == 0 for r in held)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_learns(spark, order):
    rnd = random.Random(3)
    texts = [(i, " ".join(w for _ in range(20) for w in rnd.choice([("red", "fox"), ("blue", "sky"), ("old", "man")]))) for i in range(300)]
    got = lm.interpolated(spark.createDataFrame(texts, "doc_id long, text string"), crc_mod("doc_id", 7) != 2, order).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.75 * got[1]
    assert lm.learn_weights({(33, 4, 0): 90, (33, 4, 255): 10}, 2, 1e-3)[33].sum() == pytest.approx(1)


def near_lines(table, edits=2):
    """Plain version: (doc_id, line_no) to (kept, first_doc_id, first_line_no, distance) for rows of different doc_ids."""
    first, order, want = {}, [], {}
    for doc, text in table:
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\v\f\r")
            if not line:
                continue
            if line in first:
                want[doc, k] = (False, *first[line], 0)
                continue
            near = [(*first[o], far) for o in order if abs(len(o) - len(line)) <= edits and (far := distance(o, line)) <= min(edits, min(len(o), len(line)) // 10)]
            first[line] = (doc, k)
            order.append(line)
            want[doc, k] = (False, *min(near)) if near else (True, doc, k, None)
    return want


def test_lines(spark, docs, none):
    got = lines.duplicate_lines(docs).collect()
    want = near_lines(sorted({x[:2] for x in rows() if x[0] is not None}, key=lambda x: x[0]))
    assert {(r.doc_id, r.line_no): (r.kept, r.first_doc_id, r.first_line_no, r.distance) for r in got} == want
    assert {x[3] for x in want.values()} == {0, 1, None}
    kept = lines.without_duplicate_lines(docs)
    assert kept.columns == docs.columns
    by = {r.doc_id: r for r in kept.collect()}
    assert 1 not in by and by[19].text == "same\n" and by[19].n_chars == 5 and by[4].text is None and by[0].text == BODY
    assert lines.duplicate_lines(none).count() == 0 and lines.without_duplicate_lines(none).count() == 0


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j] + (x != y), d[j + 1] + 1, e[j] + 1))
        d = e
    return d[-1]


def changed(rnd, w, most):
    w = list(w)
    for _ in range(rnd.randint(0, most)):
        at = rnd.randrange(len(w))
        w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "y", "z", "a"])
    return "".join(w)


def test_edits_apart():
    rnd = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rnd.choices("ab", k=rnd.randint(0, 8))) for _ in range(2))
        for most in (0, 1, 2, 3):
            assert lines.edits_apart(a, b, most) == min(distance(a, b), most + 1)


@pytest.mark.parametrize("edits", [1, 2])
def test_near_lines_share_a_variant(edits):
    def keys(x):
        return {(kind, base, x[start : start + size], side, v) for kind, base, start, size in filter(None, lines.pieces(len(x), edits)) for side, w in lines.windows(x, kind, base, start, size) for v in lines.neighbourhood(w)}

    rnd, met = random.Random(7), 0
    for _ in range(8_000):
        a = "".join(rnd.choices(rnd.choice(["ab", "abcdefgh"]), k=rnd.choice([rnd.randint(8, 30), rnd.randint(30, 90), rnd.randint(90, 400)])))
        b = changed(rnd, a, edits)
        if a != b and lines.edits_apart(a, b, edits) <= lines.bound(min(len(a), len(b)), edits):
            met += 1
            assert keys(a) & keys(b), (a, b)
    assert met > 2000


@pytest.mark.parametrize("edits", [1, 2])
def test_pieces_are_alike_in_spark(spark, edits):
    text = "".join(random.Random(3).choices("abc déf", k=1200))
    df = spark.range(1, 1200).select("id", F.left(F.lit(text), F.col("id").cast("int")).alias("line"))
    by_key = {}
    for r in lines._with_keys(df, edits).collect():
        assert len(r["keys"]) == len(lines.pieces(r.id, edits))
        for key, p in zip(r["keys"], lines.pieces(r.id, edits), strict=True):
            assert (key is None) == (p is None)
            if p:
                assert p[3] > 0 and 0 <= p[2] <= r.id - p[3]
                by_key.setdefault((p[0], p[1], text[p[2] : p[2] + p[3]]), set()).add(key)
    assert all(len(x) == 1 for x in by_key.values()) and len(set().union(*by_key.values())) == len(by_key)


@pytest.mark.parametrize(("block", "edits"), [(512, 2), (8, 2), (8, 1)])
def test_lines_a_few_edits_apart(spark, monkeypatch, block, edits):
    monkeypatch.setattr(lines, "BLOCK", block)
    rnd = random.Random(9)
    bases = ["".join(rnd.choices("abc ", k=n)).strip().ljust(n, "x") for n in (5, 9, 10, 11, 19, 20, 21, 22, 24, 41, 80, 200)]
    some = [(k, changed(rnd, bases[k % len(bases)], 4).strip() or "x") for k in range(360)]
    got = {(r.doc_id, r.line_no): (r.kept, r.first_doc_id, r.first_line_no, r.distance) for r in lines.duplicate_lines(spark.createDataFrame(some, "doc_id long, text string"), edits).collect()}
    want = near_lines(some, edits)
    assert got == want and {x[3] for x in want.values()} == {0, None, *range(1, edits + 1)}


def test_lines_of_rows_that_share_a_doc_id(spark):
    other = "a line that stands elsewhere too"
    table = [(1, other), (5, f"{other}\nfirst own line of this row"), (5, f"second own line of that row\n{other}"), (5, f"second own line of that row\n{other}"), (7, "a line that stands elsewhere tooo")]
    left = collections.Counter((r.doc_id, r.text) for r in lines.without_duplicate_lines(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert left == {(1, other): 1, (5, "first own line of this row"): 1, (5, "second own line of that row"): 2}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    for r in rows():
        t, w = r[1] or "", words(r[1])
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        full = [x for x in t.split("\n") if words(x)]
        if r[0] is not None:
            b = by[r[0]]
            assert (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(cover))
            assert b.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (b.kept and b.base_failed)
    assert quality.quality(none, labels).count() == 0 and quality.quality(docs, labels.limit(0)).count() == len(rows())


def test_quality_bounds():
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((0, 50, 0.02), (3, 200, 0.05), (7, 300, 0.01), (20, 20, 0.5)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact(k, n, p))
    good, bad = np.zeros(quality.BINS, int), np.zeros(quality.BINS, int)
    good[5], bad[50] = 3000, 100
    c = quality.choose(good, bad, 0.01, 1e-5, 3.0)
    assert c == 5
    assert quality.choose(good // 3000, bad, 0.01, 1e-5, 3.0) == quality.BINS - 1  # too few to be sure


def test_quality_holds_its_bound():
    rnd = np.random.default_rng(1)
    broken = 0
    for _ in range(200):
        p = np.exp(-np.arange(quality.BINS) / 10.0)
        p /= p.sum()
        good, bad = rnd.multinomial(2000, p), rnd.multinomial(300, np.roll(p, 30))
        c = quality.choose(good, bad, 0.03, 0.05 / quality.BINS, 1.0)
        broken += p[c + 1 :].sum() > 0.03
    assert broken <= 20


def test_quality_gives_moderate_strata_cutoffs(spark):
    bins = lambda x: [x] + [0] * (len(quality.SIGNALS) - 1)
    data = [(i, f"={i % 4}", False, bins(60 if i >= 6400 else 5)) for i in range(6800)]
    labels = spark.createDataFrame([(i, int(i < 6400)) for i in range(6800)], "doc_id long, quality int")
    got = quality.cutoffs(spark.createDataFrame(data, "doc_id long, stratum string, base_failed boolean, bins array<int>"), labels).collect()
    assert len(got) == 4 and all((r.good, r.bad, r.cuts[0]) == (1600, 100, 5) for r in got)
    least = next(n for n in range(1, 5000) if quality.binomial_tail(0, n, 0.03 / 7) <= 0.05 / 28)
    assert least == 1474


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    want = collections.Counter()
    for r in rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(r[0], len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    got = bpe.encode_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.decoded == next(x[1] for x in rows() if x[0] == r.doc_id) for r in got if r.doc_id in (0, 14, 18))
    assert bpe.encode_documents(none).count() == 0
    own, rnd = bpe.tokenizer(bpe.TOKENIZER), random.Random(1)
    letters = [*"abcdeTHE\n\t  '.,!?019éß中文́\x1c\x85\xa0​\U0001f600²Ⅰ_", "<|endoftext|>", "'s", "'LL", " the", "ing"]
    for _ in range(3000):
        s = "".join(rnd.choices(letters, k=rnd.randint(0, 40)))
        assert own.encode(s) == t.encode(s, add_special_tokens=False).ids


def test_lengths(spark, docs, none):
    hist = lengths.length_histogram(docs)
    n = sorted(r.n_tokens for r in bpe.token_counts(docs).collect())
    got = hist.collect()
    assert {r.n_tokens: r.docs for r in got} == dict(collections.Counter(n))
    for r in got:
        assert r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.truncated_tokens == sum(min(x, r.n_tokens) for x in n) and r.truncated_tokens + r.cut_tokens == sum(n)
    limits = spark.createDataFrame([(x,) for x in (0, 1, 7, 500, 10**6)], "context_limit long")
    assert {r.context_limit: (r.docs_cut, r.tokens_kept) for r in lengths.at_limits(hist, limits).collect()} == {c: (sum(x > c for x in n), sum(min(x, c) for x in n)) for c in (0, 1, 7, 500, 10**6)}
    assert lengths.quantile(hist, 0.5).first()[0] == n[math.ceil(len(n) / 2) - 1]
    assert lengths.length_histogram(none).count() == 0 and lengths.at_limits(lengths.length_histogram(none), limits).first().tokens_kept == 0


def letters(t):
    """Runs of letters in lower case, by characters."""
    return "".join([c if c.isalpha() else " " for c in (t or "").lower()]).split()


def test_language(spark, docs, none):
    rnd = random.Random(4)
    make = lambda syllables: " ".join("".join(rnd.choices(syllables, k=3)) for _ in range(40))
    some = [(i, make(["tha", "ing", "wor"] if i % 2 else ["eau", "çon", "éli"]), "en" if i % 2 else "fr") for i in range(80)]
    train = spark.createDataFrame(some, "doc_id long, text string, lang string")
    model = langid.train(train, crc_mod("doc_id", 4) != 2)
    got = langid.predict(train, model).select("row.*", "lang_pred", "score").collect()
    assert all(r.lang == r.lang_pred and 0.9 < r.score <= 1 for r in got)
    odd = langid.predict(docs, model).select("row.*", "lang_pred", "score").collect()
    assert len(odd) == len(rows()) and all((r.lang_pred == "und" and r.score == 0) == (not letters(r.text)) for r in odd)
    assert langid.predict(none, model).count() == 0
    empty = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    no_lang = langid.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, no_lang).collect()} == {("und", 0.0)}
    signs = spark.createDataFrame([("½",), ("²³ Ⅷ",), ("①",), ("_ 12 ٣",), ("²the³",), ("½ wor",)], "text string")
    assert [r.lang_pred for r in langid.predict(signs.coalesce(1), model).collect()] == ["und"] * 4 + ["en"] * 2


def segmentations(v, w):
    """Every way to cut a word into pieces."""
    if not w:
        yield ()
    for k in range(1, len(w) + 1):
        if w[:k] in v.id:
            for rest in segmentations(v, w[k:]):
                yield (v.id[w[:k]], *rest)


@pytest.mark.parametrize("at_once", [32, 2])
def test_language_against_all_segmentations(spark, monkeypatch, at_once):
    monkeypatch.setattr(langid, "LANGS_AT_ONCE", at_once)
    v = langid.vocabulary(langid.VOCABULARY)
    table = [(1, "The cat sat.", "en"), (2, "a cat, a hat", "en"), (3, "le chat noir", "fr"), (4, "où été", "fr"), (5, "der hut", "de"), (6, "cat ou hut?", None), (7, None, "en"), (8, "un rat, the été", None)]
    model = langid.train(spark.createDataFrame(table, "doc_id long, text string, lang string"), F.lit(True))
    probs = {}
    for lang in ("de", "en", "fr"):
        counts = collections.Counter(langid.spell(w) for _, t, x in table if x == lang for w in letters(t))
        prob = np.full(v.n, 1 / v.n)
        for _ in range(3):
            expected = np.full(v.n, 0.01)
            for w, n in counts.items():
                every = list(segmentations(v, w))
                p = np.array([np.prod(prob[list(s)]) for s in every])
                for s, share in zip(every, n * p / p.sum(), strict=True):
                    np.add.at(expected, list(s), share)
            prob = expected / expected.sum()
        probs[lang] = prob
    assert all(np.allclose(r.prob, probs[r.lang]) for r in model.collect())
    probs["mean"] = sum(probs.values()) / 3
    of = lambda w, lang: sum(np.prod(probs[lang][list(s)]) for s in segmentations(v, langid.spell(w)))
    for r in langid.predict(spark.createDataFrame(table, "doc_id long, text string, lang string"), model).select("row.*", "lang_pred", "score").collect():
        logs = {x: sum(math.log(0.9 * of(w, x) + 0.1 * of(w, "mean")) for w in letters(r.text)) for x in ("de", "en", "fr")}
        best = max(logs, key=logs.get)
        assert (r.lang_pred, r.score) == (("und", 0.0) if r.text is None else (best, pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()))))


def test_languages_without_blanks_are_told_apart(spark):
    rnd = random.Random(2)
    make = lambda first: "".join(chr(first + rnd.randrange(60)) for _ in range(200))
    table = [(i, make(0x4E00 if i % 2 else 0x0E01 if i % 4 else 0x5F00), "zh" if i % 2 else "th" if i % 4 else "ja") for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df, crc_mod("doc_id", 4) != 2)).select("row.*", "lang_pred").collect()
    assert all(r.lang == r.lang_pred for r in got)
    assert langid._parts(("é" * 100).encode()) == [("é" * 20).encode()] * 5 and b"".join(langid._parts(b"x" * 95)) == b"x" * 95


def test_language_is_fitted_on_a_bounded_number(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"))
    rows = df.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    n = {r.lang: r["count"] for r in langid._chosen(rows, 1000, 1 << 20).groupBy("lang").count().collect()}
    assert 900 < n["a"] <= 1000 and n["b"] == 500
    assert 40 < langid._chosen(rows, 1000, 500).where("lang = 'a'").count() <= 62
    same = rows.select(F.lit("a").alias("lang"), F.lit("x").alias("text"), F.lit(5).cast("long").alias("h"))
    assert langid._chosen(same, 1000, 1 << 20).count() == 1


def test_forward_sums_all_segmentations():
    v = langid.vocabulary(langid.VOCABULARY)
    rnd = np.random.default_rng(0)
    prob = rnd.random((v.n, 2))
    prob /= prob.sum(axis=0)

    def brute(w):
        if not w:
            return np.ones(2)
        return sum((prob[v.id[w[:k]]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in v.id), np.zeros(2))

    some = [b" the", b" nation", b" \xc3\xa9t", b" zq"]
    assert np.allclose(langid.forward(v, some, prob), [np.log(brute(w)) for w in some])
    long = b" " + b"abcdefgh" * 5
    assert np.allclose(langid._forward_long(v, long[:40], prob), langid.forward(v, [long[:40]], prob)[0])
    assert np.isfinite(langid.forward(v, [b" " + b"q" * 50_000], prob)).all()
    many = [b" " + bytes(rnd.choice(list(b"aehinorst"), 130).tolist()) for _ in range(110)]
    assert np.allclose(langid.forward(v, many, prob), [langid._forward_long(v, w, prob) for w in many])


def test_warc_with_a_compressed_index(spark, tmp_path):
    import gzip
    import json

    records = [warc.warc_record(k, f"http://a.b/{k}", b"x" * k)[0] for k in range(40)]
    packed = [gzip.compress(r) for r in records]
    at = [sum(map(len, packed[:k])) for k in range(41)]
    line = lambda k: f"com,a)/{k} 20200101000000 {json.dumps({'offset': str(at[k]), 'length': str(len(packed[k])), 'filename': 'data.warc.gz'})}\n".encode()
    parts = [gzip.compress(b'!meta 0 {"format": "x"}\n' + b"".join(map(line, range(25)))), gzip.compress(b"".join(map(line, range(25, 40))))]
    second = b'!meta 0 {"format": "cdxj-gzip-1.0", "filename": "index.cdx.gz"}\ncom,a)/0 20200101000000 {"offset": 0, "length": 9, "filename": "index.cdx.gz"}\n'
    members = [("datapackage.json", b"{}"), ("indexes/index.idx", second), ("indexes/index.cdx.gz", b"".join(parts)), ("archive/data.warc.gz", b"".join(packed))]
    (tmp_path / "one.wacz").write_bytes(warc.zip_stored(members))
    got = warc.read_archives(spark.createDataFrame([("one.wacz",)], "archive string"), f"file://{tmp_path}").collect()
    assert sorted((r.page_id, r.url, r.payload) for r in got) == [(k, f"http://a.b/{k}", "x" * k) for k in range(40)]


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/é x", "<p>hi</p>"), (2, None, "<p>hi</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50_000), (None, "u", "<p>hi</p>"), (None, None, "alone"), (2, None, "<p>hi</p>"), (1, "again", "<p>hi</p>")]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, bytes int, digest string")
    folder = tmp_path.as_uri()
    got = warc.read_archives(warc.write_archives(df, folder, archive_bytes=40_000), folder).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = collections.Counter()
    for i, _, h in pages:
        f = first.get(h or "")
        revisit = f is not None and f != i
        want[(i, len((h or "").encode()), sha(h or ""), "revisit" if revisit else "response", f if revisit else None, None if revisit else h or "")] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload) for r in got) == want
    big = warc.read_archives(warc.write_archives(df, folder, min_bytes=100), folder, payload=False)
    assert big.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    import zipfile

    members = [("archive/data.warc.gz", b"abc" * 1000), ("indexes/index.cdxj", b""), ("é", b"z")]
    raw = warc.zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == members
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        for name, data in members:
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
        z.comment = b"PK\5\6 in a comment"
    for data in (raw, other.getvalue()):
        f = io.BytesIO(data)
        found = warc.zip_directory(f, len(data))
        assert list(found) == [m for m, _ in members]
        for name, want in members:
            f.seek(warc.member_start(f, found[name]))
            assert f.read(found[name]["size"]) == want
    with pytest.raises(ValueError):
        warc.zip_directory(io.BytesIO(b"no"), 2)


def brute_classes(texts):
    sets = {}
    for i, t in texts:
        w = words(t)
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    lab = {i: i for i in sets}
    while True:
        new = {i: min([lab[j] for j in sets if j == i or (sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]) for i in sets}
        if new == lab:
            return lab
        lab = new


def test_near_documents(spark, docs, none):
    rnd = random.Random(8)
    base = [prose(100, rnd).split() for _ in range(4)]
    texts = [r[:2] for r in rows() if r[0] is not None][:-1]
    for k in range(120):  # copies with one to four words changed: some are linked by others only
        w = list(base[k % 4])
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(100)] = "changed" + str(rnd.randrange(10**6))
        texts.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame([*texts, (0, BODY), (None, BODY)], "doc_id long, text string")
    got = neardup.near_documents(df).collect()
    want = brute_classes(texts)
    assert len(got) == len(texts) + 2 and {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got if r.doc_id is not None) and [r.kept for r in got if r.doc_id is None] == [True]
    assert neardup.near_documents(none).count() == 0


def test_prob_min_hash():
    a = neardup.mix64(np.arange(1, 301, dtype=np.uint64))
    w, v = np.ones(300), np.ones(300)
    w[:50], v[250:] = 3.0, 2.0
    share = np.mean(neardup.prob_min_hash(a[:280], w[:280], 4000) == neardup.prob_min_hash(a[20:], v[20:], 4000))
    both = range(20, 280)
    ratio = lambda j, x, y: max((x[j] if j < 280 else 0) / 1, 0)  # noqa: E731, F841
    wa, vb = np.where(np.arange(300) < 280, w, 0), np.where(np.arange(300) >= 20, v, 0)
    exact = sum(1 / np.maximum(wa / wa[i], vb / vb[i]).sum() for i in both)
    assert share == pytest.approx(exact, abs=0.03)


def test_embeddings(spark):
    rnd = np.random.default_rng(3)
    x = rnd.standard_normal((60, 16)).astype(np.float32)
    x = np.concatenate([x, x[:20] + rnd.standard_normal((20, 16)).astype(np.float32) * 0.3, x[:5], x[:3] * 2])
    data = [(i, [float(c) for c in v], int(i % 2)) for i, v in enumerate(x)]
    data += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] + [1.0] * 15, 1), (204, data[0][1], None), (205, data[0][1][:8], 0), (206, [], 0), data[0]]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "vec_id long, embedding array<float>, label int, mult int, key string")
    got = embeddings.near_vectors(df).collect()
    ok = [k for k, d in enumerate(data) if d[1] and None not in d[1] and np.isfinite(d[1]).all() and any(d[1]) and d[2] is not None]
    links = {k: {j for j in ok if j != k and len(data[j][1]) == len(data[k][1]) and data[j][2] == data[k][2] and np.dot(data[j][1], data[k][1]) / np.linalg.norm(data[j][1]) / np.linalg.norm(data[k][1]) >= 0.93} for k in ok}
    lab = {k: data[k][0] for k in range(len(data))}
    for _ in range(20):
        lab = {k: min([lab[k], *(lab[j] for j in links.get(k, ()))]) for k in lab}
    want = collections.Counter((data[k][0], len(links.get(k, ())), lab[k], lab[k] == data[k][0]) for k in lab)
    assert collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_embedding_recall(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)  # blocks of large buckets meet in different tasks
    rnd = np.random.default_rng(6)
    centre = rnd.standard_normal((10, 64))
    x = (centre[np.arange(600) % 10] + rnd.standard_normal((600, 64)) * 0.22).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    real = int(((y @ y.T >= 0.93).sum() - 600))
    found = embeddings.near_vectors(df).agg(F.sum("n_links")).first()[0]
    assert real > 2000 and 0.97 * real <= found <= real


def test_embeddings_in_double_precision(spark):
    data = [(1, [1e300, 1e300], 1), (2, [1.0, 1.0], 1), (3, [-1e-300, -1e-300], 1), (4, [1.0, 1.0 + 1e-12], 1), (5, [1e300, float("inf")], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1), 5: (0, 5)}


def test_signs_and_tables_grow_with_the_vectors(spark, monkeypatch):
    assert [embeddings.signs_for(n) for n in (1, 1 << 18, 1 << 19, 1 << 30)] == [8, 8, 9, 20] and embeddings.tables_for(8) == 16
    for signs in range(8, 24):
        assert (1 - embeddings.AGREE**signs) ** embeddings.tables_for(signs) <= embeddings.MISSED
    rnd = np.random.default_rng(6)
    centre = rnd.standard_normal((10, 64))
    compared = {}
    for n in (400, 1600):
        monkeypatch.setattr(embeddings, "FEW", 100)  # as if a label were large
        x = (centre[np.arange(n) % 10] + rnd.standard_normal((n, 64)) * 0.22).astype(np.float32)
        y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
        real, found = int((y @ y.T >= 0.93).sum() - n), embeddings.near_vectors(df).agg(F.sum("n_links")).first()[0]
        assert 0.98 * real <= found <= real
        compared[n] = embeddings.signs_for(n)
    assert compared == {400: 10, 1600: 12}


def test_repeated_paragraphs_do_not_hide_near_copies(spark):
    rnd = random.Random(12)
    table = []
    for k in range(40):
        body, passage = prose(140, rnd), prose(60, rnd)
        table += [(100 + 2 * k, f"{body}\n{passage}"), (101 + 2 * k, f"{body}\n" + f"{passage}\n" * (20, 100)[k % 2])]
    got = {r.doc_id: r.class_id for r in neardup.near_documents(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert all(got[i] == i - i % 2 for i, _ in table) and brute_classes(table) == got


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows()) and all(r.size == len(words(r.row.text)) and r.taken == r.copies * r.size <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    names = sorted({r.row.source for r in got if r.row.source is not None}) + [None]
    size = {s: sum(r.size for r in got if r.row.source == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target, left = {}, dict(weight)
    while True:
        level = (1.5 * total - sum(target.values())) / sum(left.values())
        over = [s for s in left if level * left[s] > 2 * size[s]]
        if not over:
            target |= {s: level * left[s] for s in left}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            del left[s]
    for r in got:
        assert r.source_size == size[r.row.source] and r.target == pytest.approx(target[r.row.source])
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda x: collections.Counter((r.doc_id, r.taken) for r in x)
    assert key(got) == key(again)
    assert mixing.repeat_rows(mixing.mix(docs)).count() == sum(r.copies for r in got) and mixing.repeat_rows(mixing.mix(docs)).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, "w " * rnd.randint(0, 60), "abc"[min(2, i % 7)]) for i in range(3000)], "doc_id long, text string, source string")
    for r in mixing.mix(df).groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target


def plain_mix(table):
    """Copies of each row (doc_id, text, source): systematic sampling along (size, group, doc_id) within a source."""
    size = {k: len(words(r[1])) for k, r in enumerate(table)}
    names = sorted({r[2] for r in table if r[2] is not None}) + ([None] if any(r[2] is None for r in table) else [])
    total = {s: sum(size[k] for k, r in enumerate(table) if r[2] == s) for s in names}
    weight, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}
    while left := [s for s in names if s not in target]:
        level = (1.5 * sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * total[s]]
        target |= {s: 2 * total[s] for s in over} or {s: level * weight[s] for s in left}
    md5, copies = (lambda x, n: int(hashlib.md5(x.encode()).hexdigest()[:n], 16)), {}
    for s in names:
        e, u = (target[s] / total[s] if total[s] else 0), md5("mix:" + ("n" if s is None else f"s{s}"), 8) / 2**32
        key = lambda k: (size[k], md5("" if table[k][0] is None else str(table[k][0]), 3), table[k][0] or -1)
        for rank, k in enumerate(sorted((k for k, r in enumerate(table) if r[2] == s), key=key), 1):
            copies[k] = int(min(math.floor(e * rank + u) - math.floor(e * (rank - 1) + u), math.ceil(e)))
    return copies


def plain_pipeline(spark, table):
    """What the pipeline leaves of rows (doc_id, text, lang, source, n_chars), each step in plain Python."""
    from tokenizers import Tokenizer

    v = langid.vocabulary(langid.VOCABULARY)
    df = spark.createDataFrame([r[:5] for r in table], "doc_id long, text string, lang string, source string, n_chars long")
    model = {r.lang: np.array(r.prob) for r in langid.train(df, crc_mod("doc_id", 4) != 2).collect()}
    prob = np.array([*model.values(), sum(model.values()) / len(model)]).T if model else None
    left = []
    for r in table:
        if model and (spelt := [langid.spell(w) for w in letters(r[1])]):
            p = np.exp(langid.forward(v, spelt, prob))
            logs = np.log(0.9 * p[:, :-1] + 0.1 * p[:, -1:]).sum(axis=0)
            if 1 / np.exp(logs - logs.max()).sum() >= 0.5:
                left.append(r)
    verdict = near_lines(sorted({r[:2] for r in left if r[0] is not None}))
    rows = []
    for r in left:
        kept = [x for i, x in enumerate(r[1].split("\n")) if r[0] is None or verdict.get((r[0], i), (True,))[0]]
        if len(kept) == r[1].count("\n") + 1 or words("\n".join(kept)):
            rows.append((r[0], "\n".join(kept), r[3]))
    classes = brute_classes([r[:2] for r in rows if r[0] is not None])
    rows = [*{r[0]: r for r in rows if r[0] is not None and classes[r[0]] == r[0]}.values(), *(r for r in rows if r[0] is None)]
    copies, t = plain_mix(rows), Tokenizer.from_file(bpe.TOKENIZER)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for k, (doc_id, text, _) in enumerate(rows):
        ids = t.encode(text, add_special_tokens=False).ids
        want[(doc_id, len(ids), sha(",".join(map(str, ids))), sha(text))] += copies[k]
    return +want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    more = [(100 + k, prose(rnd.randint(30, 60), rnd), "en", "abc"[k % 3], 1, 2, "r", "k", 3, 4, 5) for k in range(40)]
    near = [(200 + k, r[1] + " tail", "en", "a", 1, 2, "r", "k", 3, 4, 5) for k, r in enumerate(more[:5])]
    table = [*[r for r in rows() if r[1] is None or len(r[1]) < 30_000], *more, *near]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got, want = collections.Counter(map(tuple, out.collect())), plain_pipeline(spark, table)
    assert got == want and len(want) > 30 and max(want.values()) > 1


@pytest.mark.parametrize("case", ["empty", "no language", "no doc_id"])
def test_pipeline_on_odd_tables(spark, tmp_path, case):
    import corpus_pipeline

    table = [] if case == "empty" else [(None if case == "no doc_id" else k, prose(20 + k), "en" if case == "no doc_id" else None, None, 1, 2, "r", "k", 3, 4, 5) for k in range(6)]
    spark.createDataFrame(table, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    left = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in left] == ([] if case != "no doc_id" else [None] * len(left)) and bool(left) == (case == "no doc_id")


def test_a_worker_frees_what_another_operator_left(monkeypatch):
    from folioscan.llm import common

    freed = []
    monkeypatch.setattr(common, "_held", ("", None))
    for owner in ("a", "a", "b", "b", "a"):
        common.claim(owner, lambda owner=owner: freed.append(owner))
    assert freed == ["a", "b"]
    langid.vocabulary(langid.VOCABULARY)
    langid._free()
    assert langid.vocabulary.cache_info().currsize == 0


def test_quality_cutoffs_against_a_plain_version(spark):
    rnd = random.Random(17)
    table, labels = [], []
    for i in range(9000):
        stratum, bad = "=ab"[i % 2 + 1], rnd.random() < 0.2
        table.append((i, stratum, i % 50 == 0, [min(127, int(rnd.expovariate(1 / (25 if bad and s < 3 else 4)))) for s in range(len(quality.SIGNALS))]))
        labels.append((i, None if i % 31 == 0 else int(not bad)))
    df = spark.createDataFrame(table, "doc_id long, stratum string, base_failed boolean, bins array<int>")
    got = {r.stratum: (r.cuts, r.good, r.bad) for r in quality.cutoffs(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    truth, tests = dict(labels), 2 * len(quality.SIGNALS)
    alpha, delta = 0.03 / len(quality.SIGNALS), 0.05 / tests
    for name in "ab":
        rows = [(b, truth[i]) for i, s, failed, b in table if s == name and not failed and truth[i] is not None]
        good, bad = [b for b, q in rows if q], [b for b, q in rows if not q]
        cuts = []
        for s in range(len(quality.SIGNALS)):
            best = 127
            for c in range(126, -1, -1):
                k, j, n = sum(b[s] > c for b in good), sum(b[s] > c for b in bad), len(good)
                if sum(math.comb(n, x) * alpha**x * (1 - alpha) ** (n - x) for x in range(k + 1)) > delta:
                    break
                if j and j / len(bad) >= 3 * k / n:
                    best = c
            cuts.append(best)
        assert got[name] == (cuts, len(good), len(bad)) and min(cuts[:3]) < 127
