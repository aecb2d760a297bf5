"""Mending of bibliographies and citations: the text with its edits, and a log of what was changed."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import rows_of
from . import bib
from .scan import apply_edits, shown
from .tex import CITE_COMMANDS

#: Fixed value: the indent of fields where a source shows none.
INDENT = "  "
DECISION = "array<struct<key:string,action:string,reason:string,corrections:array<struct<field:string,current:string,correct:string>>>>"
_CITE = re.compile(r"\\(" + "|".join(sorted(CITE_COMMANDS, key=len, reverse=True)) + r")s?\*?(?:\s*\[[^\]]*\]){0,2}\s*\{([^{}]*)\}", re.I)
_CHANGES = ("changes", "array<struct<line:int,action:string,detail:string>>", pa.list_(pa.struct([("line", pa.int32()), ("action", pa.string()), ("detail", pa.string())])))


def _change(line: int, action: str, detail: str) -> dict:
    return {"line": line, "action": action, "detail": detail}


def fix_bibliography(src: str, decisions: list[dict]) -> tuple[str, list[dict]]:
    """The source without removed entries and with corrected fields; fields that are missing are put behind the key."""
    by_key = {d["key"]: d for d in decisions}
    edits, log = [], []
    for e in bib.parse(src)[0]:
        d = by_key.get(e["key"], {"action": "keep"})
        if d["action"] == "remove":
            blanks = re.compile(r"[ \t]*\n*").match(src, e["end"])
            edits.append((e["start"], blanks.end(), ""))
            log.append(_change(e["line"], "removed entry", f"@{e['type']}{{{e['key']}}}: {d['reason'] or 'not found in any source'}"))
        for c in (d["corrections"] or []) if d["action"] == "fix" else []:
            field, new = e["fields"].get(c["field"].lower()), f"{{{c['correct']}}}"
            if field:
                edits.append((field["value_start"], field["value_end"], new))
            else:
                entry = src[e["start"] : e["end"]]
                indent = re.search(r"\n([ \t]+)[A-Za-z0-9_]", entry)
                at = e["start"] + entry.index(",") + 1
                edits.append((at, at, f"\n{indent[1] if indent else INDENT}{c['field']} = {new},"))
            before = "(missing)" if c["current"] is None else c["current"]
            log.append(_change(e["line"], "corrected field" if field else "added field", f"{e['key']}.{c['field']}: {shown(before)} → {shown(c['correct'])}"))
    return apply_edits(src, edits), log


def fixed_bibliographies(sources: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, fixed, changes.  ``sources``: doc_id, src.  ``decisions``: doc_id, key, action (keep, fix or remove), reason, corrections.

    Decisions of a source are gathered by doc_id (as many as it has entries) and go to it in one join.  Null sources stay null.
    """
    per = decisions.groupBy("doc_id").agg(F.collect_list(F.struct("key", "action", "reason", "corrections")).alias("d"))
    both = sources.join(per, "doc_id", "left").withColumn("d", F.coalesce("d", F.array().cast(DECISION)))
    out = rows_of(both, ["src", "d"], lambda s, d: [fix_bibliography(s, d)], [("fixed", "string", pa.string()), _CHANGES])
    return _with_nulls(out, sources, "src")


def _with_nulls(out: DataFrame, sources: DataFrame, column: str) -> DataFrame:
    none = sources.where(F.col(column).isNull()).select(F.col("doc_id").cast("long"), F.lit(None).cast("string").alias("fixed"), F.array().cast(_CHANGES[1]).alias("changes"))
    return out.unionByName(none)


def prune_citations(src: str, removed: list[str]) -> tuple[str, list[dict]]:
    """The source without citations of ``removed`` keys; a command left with none goes with the tie or blank before it."""
    gone, edits, log = set(removed), [], []
    for m in _CITE.finditer(src):
        if re.search(r"(?<!\\)%", src[src.rfind("\n", 0, m.start()) + 1 : m.start()]):
            continue
        keys = [k for x in m[2].split(",") if (k := x.strip())]
        left = [k for k in keys if k not in gone]
        if len(left) == len(keys):
            continue
        line, name = 1 + src.count("\n", 0, m.start()), f"\\{m[1].lower()}"
        old = f"{name}{{{m[2].strip()}}}"
        if left:
            edits.append((*m.span(2), ", ".join(left)))
            log.append(_change(line, "pruned citation keys", f"{old} → {name}{{{', '.join(left)}}}"))
            continue
        before, after = src[m.start() - 1 : m.start()] if m.start() else "", src[m.end() : m.end() + 1]
        tied = before == "~" or (before == " " and (not after or after.isspace() or after in ".,;)"))
        edits.append((m.start() - tied, m.end(), ""))
        log.append(_change(line, "removed citation", old))
    return apply_edits(src, edits), log


def fixed_citations(sources: DataFrame, removed: DataFrame) -> DataFrame:
    """doc_id, fixed, changes.  ``sources``: doc_id, text (LaTeX).  ``removed``: doc_id, key."""
    per = removed.groupBy("doc_id").agg(F.collect_set("key").alias("gone"))
    both = sources.join(per, "doc_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<string>")))
    out = rows_of(both, ["text", "gone"], lambda s, g: [prune_citations(s, g)], [("fixed", "string", pa.string()), _CHANGES])
    return _with_nulls(out, sources, "text")
