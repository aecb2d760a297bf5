"""Citations in LaTeX sources, and what they lack or leave unused."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import rows_of

#: Commands that cite.
CITE_COMMANDS = (
    "cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "citeyearpar", "citenum", "citetext", "parencite", "textcite", "autocite", "smartcite", "footcite",
    "footcitetext", "supercite", "fullcite", "footfullcite", "nocite", "citefield",
)
CITE = r"\\(?:" + "|".join(CITE_COMMANDS) + r")s?\*?(?:\s*\[[^\]]*\]){0,2}\s*\{[^{}]*\}"


def citations(docs: DataFrame) -> DataFrame:
    """doc_id, command, keys: each citation outside of comments.  ``docs``: doc_id, text, filetype (only tex counts).

    A comment runs from an unescaped per cent sign to the end of its line; a citation that begins there is dropped, one
    that begins before is whole, even if it has such a sign inside.
    """
    # Either a whole comment or a citation: whichever begins first in a line takes its text.
    found = F.regexp_extract_all("text", F.lit(r"(?i)(?<!\\)%[^\n]*|" + CITE), F.lit(0))
    rows = docs.where("filetype = 'tex'").select("doc_id", F.explode(found).alias("m")).where(~F.col("m").startswith("%"))
    keys = F.filter(F.transform(F.split(F.regexp_extract("m", r"\{([^{}]*)\}$", 1), ","), lambda k: F.trim(k)), lambda k: k != "")
    return rows.select("doc_id", F.lower(F.regexp_extract("m", r"(?i)^\\([a-z]+?)s?(?=\*|\s|\[|\{)", 1)).alias("command"), keys.alias("keys"))


_SPANS = re.compile(r"(?<!\\)%[^\n]*|\\(?P<command>(?:" + "|".join(CITE_COMMANDS) + r")s?)(?P<star>\*?)(?P<options>(?:\s*\[[^\]]*\]){0,2})\s*\{(?P<keys>[^{}]*)\}", re.I)


def _spans(text: str) -> list[tuple]:
    breaks, out = [m.start() for m in re.finditer("\n", text)], []
    for m in _SPANS.finditer(text):
        if m["command"]:
            keys = [k.strip() for k in m["keys"].split(",")]
            out.append((m["command"], bool(m["star"]), m["options"], [k for k in keys if k], m.start(), m.end(), m.start("keys"), 1 + bisect.bisect_left(breaks, m.start())))
    return out


def citation_spans(docs: DataFrame) -> DataFrame:
    """doc_id, command, star, options, keys, start, end, keys_start, line: each citation outside of comments with its place.

    Commands are as they are written; places are code points from 0, lines count from 1.  ``docs`` is that of ``citations``.
    """
    ints = [(n, "int", pa.int32()) for n in ("start", "end", "keys_start", "line")]
    schema = [("command", "string", pa.string()), ("star", "boolean", pa.bool_()), ("options", "string", pa.string()), ("keys", "array<string>", pa.list_(pa.string())), *ints]
    return rows_of(docs.where("filetype = 'tex' and contains(text, '{')"), ["text"], _spans, schema)


def used_keys(cites: DataFrame) -> DataFrame:
    """doc_id, key: keys that a document cites, each once; ``*`` is no key."""
    return cites.select("doc_id", F.explode("keys").alias("key")).where("key <> '*'").distinct()


def cross_check(used: DataFrame, defined: DataFrame) -> DataFrame:
    """key, state: ``missing`` for keys that are used but not defined, ``unused`` for those defined but not used."""
    u, d = used.select("key").distinct(), defined.select("key").distinct()
    return u.join(d, "key", "left_anti").withColumn("state", F.lit("missing")).unionByName(d.join(u, "key", "left_anti").withColumn("state", F.lit("unused")))


def bib_resources(docs: DataFrame) -> DataFrame:
    """doc_id, resource: bibliography files that sources (doc_id, text, filetype; only tex counts) name outside of comments, without their ``.bib``."""
    found = F.regexp_extract_all("text", F.lit(r"(?<!\\)%[^\n]*|\\(?:bibliography|addbibresource)\s*(?:\[[^\]]*\])?\{[^}]*\}"), F.lit(0))
    rows = docs.where("filetype = 'tex'").select("doc_id", F.explode(found).alias("m")).where(~F.col("m").startswith("%"))
    names = F.transform(F.split(F.regexp_extract("m", r"\{([^}]*)\}$", 1), ","), lambda x: F.regexp_replace(F.trim(x), r"(?i)\.bib$", ""))
    return rows.select("doc_id", F.explode(F.filter(names, lambda x: x != "")).alias("resource"))
