"""Line deduplication: equal lines by hash, lines a few edits apart by a join of deletion neighbourhoods."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, drop_saved, hash_words, rest, save

#: Insertions, deletions and substitutions that make near lines of each other, at most (1 or 2); and the characters of
#: the shorter line that each edit needs, so that the bound grows with the line and no line becomes another word.
EDITS, CHARS_PER_EDIT = 2, 10
#: Characters of the windows whose deletion neighbourhoods are joined.
WINDOW = 16
#: Lines that share a key and meet in one group, and their characters; more are dealt to blocks of about so many.
BLOCK, BLOCK_CHARS = 512, 16 << 20
BLANKS = " \t\n\x0b\x0c\r"


def bound(chars: int, edits: int = EDITS) -> int:
    """Edits that a line of ``chars`` characters may be from a longer one to count as near."""
    return min(edits, chars // CHARS_PER_EDIT)


Piece = tuple[int, int, int, int]


def _cut(n: int, k: int, q: int) -> list[Piece]:
    """Pieces of a line of ``n`` characters for a shorter one whose parts, k + 1 of them, have ``q``.

    Lengths and places keep their three leading binary digits, so that neighbouring q mostly give the same pieces.
    """
    step = 1 << max(0, q.bit_length() - 3)
    g = q // step * step
    if k == 1:
        return [(3, 0, 0, g), (4, 0, n - g, g)]
    base = g + step
    size = (2 * q - 1 - base) // step * step
    return [(0, 0, 0, g), (1, base, base, size), (1, base, base + 1, size), (2, 0, n - g, g)]


def pieces(n: int, edits: int = EDITS) -> list[Piece | None]:
    """(kind, base, start, size) of the pieces that a line of ``n`` characters is looked up by; None stands for repeated ones.

    Two near lines share a piece's kind, base and text.  The shorter line (of m characters) in thirds for two edits, in
    halves for one: some part is untouched.  If it is the first (kinds 0, 3) or the last (2, 4), both lines share what
    stands at that end.  If it is the middle one alone (1), one edit is before it and moves it by one at most, so one
    line has the piece at ``base`` and the other there or one further on.  Either line may be the shorter, so every m
    from n - edits on counts; from a length on, these have two sizes of parts at most.
    """
    if n >= edits * (CHARS_PER_EDIT + 1):
        one, other = (_cut(n, edits, q // (edits + 1)) for q in (n, n - edits))
        return one + [None if p == o else p for p, o in zip(other, one, strict=True)]
    shorter = [(m, bound(m, edits)) for m in range(n, max(0, n - edits - 1), -1)]
    return list(dict.fromkeys(p for m, k in shorter if n - m <= k and k for p in _cut(n, k, m // (k + 1))))


def _with_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``lines`` (line, and other columns) with ``keys``: hashes of the :func:`pieces` of each line, in their order.

    Plain expressions, which Spark compiles, for all but the shortest lines; for these a table of their pieces.  Places
    are worked out column by column, each once.
    """
    least, names, n, line = edits * (CHARS_PER_EDIT + 1), lines.columns, F.col("n"), F.col("line")
    x = lines.withColumn("n", F.char_length("line"))
    x = x.select("*", *[F.floor((n - less) / (edits + 1)).cast("int").alias(f"q{k}") for k, less in enumerate((0, edits))])

    def step(q):
        out = F.when(q < 8, 1)
        for e in range(1, 28):
            out = out.when(q < 8 << e, 1 << e)
        return out

    x = x.select("*", *[step(F.col(f"q{k}")).alias(f"s{k}") for k in (0, 1)])
    x = x.select("*", *[F.expr(f"q{k} - q{k} % s{k} AS g{k}") for k in (0, 1)])
    x = x.select("*", *[F.expr(f"g{k} + s{k} AS base{k}") for k in (0, 1)])
    x = x.select("*", *[F.expr(f"(2 * q{k} - 1 - base{k}) - (2 * q{k} - 1 - base{k}) % s{k} AS size{k}") for k in (0, 1)])
    key = lambda kind, base, start, size: F.xxhash64(kind, base, line.substr(start + 1, size))
    out, zero = [], F.lit(0)
    for k in (0, 1):
        g, base, size = F.col(f"g{k}"), F.col(f"base{k}"), F.col(f"size{k}")
        begin, end = (key(F.lit(kind), zero, start, g) for kind, start in zip((3, 4) if edits == 1 else (0, 2), (zero, n - g), strict=True))
        middle = [] if edits == 1 else [key(F.lit(1), base, base, size), key(F.lit(1), base, base + 1, size)]
        if k:
            begin, end = (F.when(F.expr("g1 <> g0"), c) for c in (begin, end))
            middle = [F.when(F.expr("base1 <> base0 OR size1 <> size0"), c) for c in middle]
        out += [begin, *middle, end]
    kind = "array<struct<kind:int,base:int,start:int,size:int>>"
    table = F.array(*[F.array(*[F.struct(*map(F.lit, p)) for p in pieces(i, edits)]).cast(kind) for i in range(least)])
    short = F.transform(F.get(table, n), lambda p: key(p["kind"], p["base"], p["start"], p["size"]))
    return x.select(*names, F.when(n >= least, F.array(*out)).otherwise(short).alias("keys"))


def windows(line: str, kind: int, base: int, start: int, size: int) -> list[tuple[int, str]]:
    """(side, characters): where near lines that share a piece have at most one edit left, in one of these at least.

    Beside an untouched part the lines stand side by side, as they do at both their ends.  Of the parts that are not
    untouched one has at most one edit; windows lie in each, at the border where the lines are aligned.
    """
    w = min(WINDOW, size)
    if kind in (0, 3):
        found = [(1, line[size : size + w])]
        return found if kind == 3 else [*found, (2, line[len(line) - w :])]
    if kind == 1:
        return [(0, line[start - min(WINDOW, base) : start])]
    return [(0, line[:w])] if kind == 4 else [(0, line[:w]), (1, line[start - w : start])]


def neighbourhood(window: str) -> set[str]:
    """The window and all that one deletion makes of it.

    Windows of one size that begin where two texts are aligned, with at most one edit between them, share a member.
    """
    return {window, *(window[:i] + window[i + 1 :] for i in range(len(window)))}


def _agreed(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def edits_apart(a: str, b: str, most: int) -> int:
    """Least number of insertions, deletions and substitutions that make one text of the other; most + 1 if it is over ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    k = _agreed(a, b)
    a, b = a[k:], b[k:]
    if not a or not b:
        return len(a) + len(b)
    if not most:
        return 1
    found = most
    for x, y in ((a[1:], b[1:]), (a[1:], b), (a, b[1:])):
        found = min(found, edits_apart(x, y, found - 1) if found else 0)
    return found + 1


def _sharing(unique: DataFrame) -> DataFrame:
    """(a, slot): lines, and which of their pieces, that may share a piece with another line.

    Keys of pieces come in order over all partitions, and a row stays if it has its neighbour's key.  So no key's lines
    are held or counted together, and a key of very many lines is cut like any other; rows at the edge of a batch stay
    without a look, which costs a few more lines further on and loses none.
    """
    rows = unique.select("a", F.posexplode("keys").alias("slot", "key")).where("key is not null")
    rows = rows.repartitionByRange("key", "a").sortWithinPartitions("key")

    def run(batches):
        claim("lines")
        for batch in batches:
            key = batch.column(2).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.ones(len(key), bool)
            keep[1:-1] = same[1:] | same[:-1]
            yield batch.select(["a", "slot"]).filter(pa.array(keep))
        rest()

    return rows.mapInArrow(run, "a long, slot int")


def _variants(texts: DataFrame, edits: int) -> DataFrame:
    """(key, win, a, b, size): the deletion neighbourhoods of the windows beside each line's shared pieces, as hashes.

    ``win`` is the key of the window itself, ``size`` the line's characters.
    """

    def some(rows):
        found = []  # row, piece, window
        for r, (_, _, line, slots) in enumerate(rows):
            every = pieces(len(line), edits)
            for slot in slots:
                kind, base, start, size = every[slot]
                found += [(r, f"{kind} {base} ".encode() + line[start : start + size].encode("utf-8", "surrogatepass"), side, w) for side, w in windows(line, kind, base, start, size)]
        if not found:
            return None
        shared = hash_words([f[1] for f in found])
        hashed, count = [], np.zeros(len(found), np.int64)
        for k, ((_, _, side, w), h) in enumerate(zip(found, shared, strict=True)):
            every = neighbourhood(w)
            every.remove(w)
            head = h.tobytes() + bytes([side])
            hashed += [head + v.encode("utf-8", "surrogatepass") for v in (w, *every)]
            count[k] = 1 + len(every)
        key = hash_words(hashed).view(np.int64)
        first = np.cumsum(count) - count
        at = np.repeat(np.array([f[0] for f in found]), count)
        a, b, size = (np.array([v(r) for r in rows], np.int64) for v in (lambda r: r[0], lambda r: r[1], lambda r: len(r[2])))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.repeat(key[first], count), a[at], b[at], size[at])], names=["key", "win", "a", "b", "size"])

    def run(batches):
        claim("lines")
        for batch in batches:
            rows, held = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                held += 40 * len(row[3]) + len(row[2]) // 64
                if held > 100_000:
                    if (got := some(rows)) is not None:
                        yield got
                    rows, held = [], 0
            if rows and (got := some(rows)) is not None:
                yield got
        rest()

    return texts.select("a", "b", "line", "slots").mapInArrow(run, "key long, win long, a long, b long, size long")


def _near(members: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(a, b, first, far): in every group, or block of one, the earliest line near to each line, and the edits between.

    members: key, win, a, b, n and chars (lines of the key, and their characters).  Groups come in order, one after the
    other.  Lines are looked through from the earliest on up to the first near one, so of many true copies few are
    compared, and no pairs are listed.  Two lines with the same window meet under that window's own key only.  Each
    block of a large group meets each other one (role 0: looked through, 1: looks, 2: both).
    """
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("chars") / BLOCK_CHARS))).cast("int")
    spot, every = F.pmod(F.xxhash64("a", "b"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
    deal = lambda role, f: F.transform(every, lambda k: F.struct(F.lit(role).alias("role"), *f(k)))
    ours = deal(1, lambda k: (spot.alias("i"), k.alias("j")))
    theirs = deal(0, lambda k: (k.alias("i"), spot.alias("j")))
    alone = F.array(F.struct(F.lit(2).alias("role"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = members.select("key", "win", "a", "b", F.inline(F.when(parts == 1, alone).otherwise(F.concat(ours, theirs))))
    order = ["key", "i", "j"]
    rows = dealt.join(texts.select("a", "b", "first", "line"), ["a", "b"])
    rows = rows.repartition(*order).sortWithinPartitions(*order, "first", "role").select(*order, "win", "role", "a", "b", "first.doc_id", "first.line_no", "first.t", "line")

    def run(batches):
        claim("lines")
        group, held = None, []
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != group:
                    group, held = r[:3], []
                win, role, me, place, line = r[3], r[4], r[5:7], r[7:10], r[10]
                if role:
                    own, n = r[0] == win, len(line)
                    for other_win, other_place, other in held:
                        if (own or other_win != win) and other_place != place:
                            most = bound(min(n, len(other)), edits)
                            if (far := edits_apart(other, line, most)) <= most:
                                out.append((*me, *other_place, far))
                                break
                if role != 1:
                    held.append((win, place, line))
            kinds = {"a": pa.int64(), "b": pa.int64(), "doc_id": pa.int64(), "line_no": pa.int32(), "t": pa.int64(), "far": pa.int32()}
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))
        rest()

    return rows.mapInArrow(run, "a long, b long, doc_id long, line_no int, t long, far int")


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), line_no (from 0), line: every line of ``docs`` that has a word, without the blanks around it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''")


def _judged(docs: DataFrame, edits: int) -> DataFrame:
    """doc_id, t, line_no, and ``to``: the earliest line that is equal (far 0) or near (far over 0) to one that goes, else null."""
    lines = _with_keys(line_table(docs), edits)
    lines = save(lines.select("doc_id", "t", "line_no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), "keys"), "lines")
    unique = save(lines.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no", "t")).alias("first"), F.count("*").alias("times"), F.first("keys").alias("keys")), "lines-unique")
    slots = _sharing(unique).groupBy("a").agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    survivors = save(unique.select("a", "b", "first").join(slots, "a"), "lines-survivors")

    holders = save(survivors.select("first.doc_id").distinct(), "lines-holders")
    held = line_table(docs.select("doc_id", "text").join(holders, "doc_id", "left_semi"))
    at_first = survivors.select("a", "b", "first", "slots", "first.doc_id", "first.line_no", "first.t")
    texts = save(held.join(at_first, ["doc_id", "line_no", "t"]).select("a", "b", "first", "line", "slots").dropDuplicates(["a", "b"]), "lines-texts")
    drop_saved(holders, survivors)

    variants = save(_variants(texts, edits), "lines-variants")
    own = F.min("win") == F.col("key")
    shared = variants.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("chars"), ((F.min("win") != F.max("win")) | own).alias("meet")).where("n > 1 and meet")
    shared = save(shared.select("key", "n", "chars"), "lines-shared")
    members = save(variants.join(shared, "key"), "lines-members")
    drop_saved(variants, shared)
    near = _near(members, texts, edits).groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no", "t", "far")).alias("near"))
    near = save(near, "lines-near")
    drop_saved(texts, members)

    verdicts = save(unique.where("times > 1").select("a", "b", "first").join(near, ["a", "b"], "full"), "lines-verdicts")
    drop_saved(unique, near)
    out = lines.select("doc_id", "t", "line_no", "a", "b").join(verdicts, ["a", "b"], "left")
    equal = F.struct("doc_id", "line_no", "t") > F.col("first")
    first = F.struct("first.doc_id", "first.line_no", "first.t", F.lit(0).alias("far"))
    return out.select("doc_id", "t", "line_no", F.when(equal, first).otherwise(F.col("near")).alias("to"))


def duplicate_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """A row per line with a word: doc_id, line_no, kept, first_doc_id, first_line_no, distance.

    ``docs``: doc_id, text; other columns are ignored.  Lines are compared without the blanks around them.  A line goes
    if an equal line is earlier (distance 0), or if an earlier line is near: within one edit (insertion, deletion,
    substitution) for every ten characters of the shorter of the two, and within ``edits`` in all.  first_doc_id and
    first_line_no name the earliest such line, or the line itself if it stays.  Earlier means a smaller doc_id, then a
    smaller line number, then the smaller hash of the whole text (where rows of one doc_id differ).  Rows that repeat
    doc_id and text are one document; rows without a doc_id or text have no lines; an empty table gives none.  Lines of
    any length are compared whole; what a task holds is bounded by blocks of lines and of characters.

    Equal lines become one, by 128 bits of hash.  Of the rest, only those that share a whole piece (see :func:`pieces`)
    with another line can have a partner.  They emit the deletion neighbourhoods of the windows beside those pieces;
    lines with an equal variant meet, their edit distance is taken on the whole texts, and the earliest is kept.
    """
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    to = lambda c: F.coalesce(F.col(f"to.{c}"), F.col(c)).alias(f"first_{c}")
    return _judged(docs, edits).select("doc_id", "line_no", F.col("to").isNull().alias("kept"), to("doc_id"), to("line_no"), F.col("to.far").alias("distance"))


def without_duplicate_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of ``docs`` without the lines that :func:`duplicate_lines` drops; rows left without a word go.

    Columns keep their names and order; n_chars, if there is one, is the new text's length where lines went.  Rows that
    had no word from the start, and rows without a doc_id, stay as they are.  A row loses lines by its own text's verdicts only,
    also where rows of one doc_id differ.
    """
    gone = save(_judged(docs, edits).where("to is not null").groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line_no")).alias("gone")), "lines-gone")
    text, kind = F.col("row.text").cast("string"), docs.schema["text"].dataType
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    rows = rows.join(gone, ["doc_id", "t"], "left").select("row", "gone")

    @F.arrow_udf("string")
    def left(text: pa.Array, gone: pa.Array) -> pa.Array:
        claim("lines")
        return pa.array([_without(t.as_py(), g.as_py()) if g.is_valid else None for t, g in zip(text, gone, strict=True)], pa.string())

    has = F.col("gone").isNotNull()
    done = rows.withColumn("new", left(F.when(has, text), F.col("gone"))).where(~has | F.col("new").isNotNull())
    fresh = {"text": F.when(has, F.col("new").cast(kind)).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        chars = F.char_length(F.when(has, F.col("new")).otherwise(text))
        fresh["n_chars"] = F.when(has, chars.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[(fresh[c] if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns])


def _without(text: str, gone: list[int]) -> str | None:
    """A text without some of its lines; None if no word is left."""
    drop = set(gone)
    text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in drop])
    return text if text.strip(BLANKS) else None
