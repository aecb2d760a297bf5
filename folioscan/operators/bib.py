"""BibTeX sources: entries with exact spans, macros, derived fields and warnings."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrow import rows_of

#: Macros that every source knows, and entry types that catalogues index well.
MONTHS = {m[:3].lower(): m for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")}
INDEXABLE = ("article", "inproceedings", "incollection", "conference", "proceedings")

_HEAD = re.compile(r"@([a-zA-Z]+)\s*([{(])")
_STRUCTURE = re.compile(r"\\.|[{}()%]", re.S)
_FIELD = re.compile(r"([\w.:+/-]+)\s*(=?)\s*", re.A)
_VALUE = {"{": re.compile(r"\\.|[{}]", re.S), '"': re.compile(r'\\.|[{}"]', re.S)}
_BARE = re.compile(r"[^\s,#]*")


def _body_end(src: str, opened: int, braces: bool) -> int:
    """Where the entry opened at ``opened`` closes (position of the sign), or the length of the source if it does not.

    Between the fields of a braced entry a per cent sign hides the rest of its line.
    """
    depth, hidden = 0, opened
    for m in _STRUCTURE.finditer(src, opened):
        if m.start() < hidden or m[0][0] == "\\":
            continue
        if m[0] == "%" and braces and depth == 1:
            stop = src.find("\n", m.start())
            hidden = len(src) if stop < 0 else stop
        elif m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if braces and not depth:
                return m.start()
        elif m[0] == ")" and not braces and not depth:
            return m.start()
    return len(src)


def _group_end(body: str, at: int) -> int:
    """Behind the braced or quoted group at ``at``; the end of the body if it never closes."""
    sign, depth = body[at], 0
    for m in _VALUE[sign].finditer(body, at if sign == "{" else at + 1):
        depth += (m[0] == "{") - (m[0] == "}")
        if m[0] == ("}" if sign == "{" else '"') and not depth:
            return m.end()
    return len(body)


def _parts(body: str, at: int) -> tuple[int, list[str]]:
    """The pieces of a value that begins at ``at``, joined by ``#``, and where it ends."""
    found = []
    while at < len(body):
        end = _group_end(body, at) if body[at] in '{"' else _BARE.match(body, at).end()
        found.append(body[at:end])
        more = re.compile(r"\s*#\s*").match(body, end)
        if not more:
            return end, found
        at = more.end()
    return at, found


def _fields(body: str, at: int) -> Iterator[tuple[str, int, int, list[str]]]:
    """(name, start, end, pieces) of the fields of a body, from behind its key."""
    while at < len(body):
        at = re.compile(r"[\s,]*").match(body, at).end()
        if body[at : at + 1] == "%":
            stop = body.find("\n", at)
            if stop < 0:
                return
            at = stop + 1
            continue
        m = _FIELD.match(body, at)
        if not m:
            return
        if not m[2]:
            at = m.end() + 1
            continue
        at, pieces = _parts(body, m.end())
        yield m[1].lower(), m.end(), m.end() + len(body[m.end() : at].rstrip()), pieces


def _bare(piece: str) -> str:
    piece = piece.strip()
    return piece[1:-1] if len(piece) > 1 and piece[0] + piece[-1] in ("{}", '""') else piece


def parse(src: str) -> tuple[list[dict], list[dict]]:
    """Entries and warnings of one source.  Both entries of a doubled key are kept; one without a key is not."""
    breaks = [m.start() for m in re.finditer("\n", src)]
    line = lambda i: 1 + bisect.bisect_left(breaks, i)
    entries, warnings, macros, seen, at = [], [], {}, {}, 0
    while (at := src.find("@", at)) >= 0:
        before = src[src.rfind("\n", 0, at) + 1 : at]
        if re.search(r"(?<!\\)%", before):
            stop = src.find("\n", at)
            at = len(src) if stop < 0 else stop + 1
            continue
        head = _HEAD.match(src, at)
        if not head:
            at += 1
            continue
        start, kind, opened = at, head[1].lower(), head.end() - 1
        close = _body_end(src, opened, head[2] == "{")
        at = min(close + 1, len(src))
        if kind in ("comment", "preamble"):
            continue
        if close >= len(src):
            warnings.append({"line": line(start), "message": f"@{kind} is not closed before the end of the source"})
        body = src[opened + 1 : at - 1]
        if kind == "string":
            if m := re.match(r"\s*([\w.:+/-]+)\s*=\s*(.*)$", body, re.S | re.A):
                macros[m[1].lower()] = _bare(m[2])
            continue
        key = re.match(r"\s*([^,\s{}()]+)\s*,", body)
        if not key:
            warnings.append({"line": line(start), "message": f"@{kind} has no key and is left out"})
            continue
        if key[1] in seen:
            warnings.append({"line": line(start), "message": f'key "{key[1]}" was defined on line {seen[key[1]]}'})
        seen.setdefault(key[1], line(start))
        fields = {n: (opened + 1 + a, opened + 1 + z, body[a:z], pieces) for n, a, z, pieces in _fields(body, key.end())}
        entries.append({"type": kind, "key": key[1], "line": line(start), "start": start, "end": at, "fields": fields})
    known = MONTHS | macros
    for e in entries:
        e["fields"] = {n: {"raw": raw, "value": "".join(_bare(p) if p[:1] in ("{", '"') else known.get(p.lower(), p) for p in map(str.strip, pieces)), "value_start": a, "value_end": z} for n, (a, z, raw, pieces) in e["fields"].items()}
    return entries, warnings


def plain(c: Column) -> Column:
    """A field's value without LaTeX: accents give their letter, commands and braces go, blanks are one.  Null is empty."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"""\\['"`^~=.uvHtcdb]\s*\{?([a-zA-Z])\}?""", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\\[a-zA-Z]+\s*", " "), "[{}]", ""), r"\s+", " "))


def entries(sources: DataFrame) -> DataFrame:
    """A row per entry of ``sources`` (doc_id, src), with its spans, fields and what follows from them."""
    field = pa.struct([("raw", pa.string()), ("value", pa.string()), ("value_start", pa.int32()), ("value_end", pa.int32())])
    types = {"type": pa.string(), "key": pa.string(), "line": pa.int32(), "start": pa.int32(), "end": pa.int32(), "fields": pa.map_(pa.string(), field)}

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for doc_id, src in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = parse(src)[0] if src else []
                ids += [doc_id] * len(got)
                rows += [e | {"fields": list(e["fields"].items())} for e in got]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[n] for r in rows], t) for n, t in types.items())], names=["doc_id", *types])

    rows = sources.selectExpr("cast(doc_id as long) doc_id", "src").mapInArrow(run, "doc_id long, type string, key string, line int, start int, end int, fields map<string,struct<raw:string,value:string,value_start:int,value_end:int>>")
    get = lambda n: F.col("fields")[n]["value"]
    first = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs])
    year = F.regexp_extract(plain(get("year")), "([0-9]{4})", 1)
    url_doi = F.when(F.contains(get("url"), F.lit("doi.org")), X.clean_doi(get("url")))
    return rows.select(
        "*", plain(get("title")).alias("title"), F.coalesce(get("author"), F.lit("")).alias("author"), F.when(year != "", year).alias("year"), F.coalesce(X.clean_doi(get("doi")), url_doi).alias("doi"),
        F.coalesce(*[X.arxiv_id(get(n)) for n in ("eprint", "url", "note", "journal", "howpublished")]).alias("arxiv"), F.coalesce(first(*[plain(get(n)) for n in ("journal", "booktitle", "publisher")]), F.lit("")).alias("venue"),
        F.coalesce(get("url"), F.lit("")).alias("url"), F.col("type").isin(*INDEXABLE).alias("indexable"),
    )


def warnings(sources: DataFrame) -> DataFrame:
    """doc_id, line, message: what is wrong in ``sources`` (doc_id, src): keys defined again or absent, entries that never close."""
    return rows_of(sources, ["src"], lambda src: [(w["line"], w["message"]) for w in parse(src)[1]], [("line", "int", pa.int32()), ("message", "string", pa.string())])
