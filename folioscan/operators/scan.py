"""The guarded scan: every match of every rule, judged by where it stands, one row per finding."""

from __future__ import annotations

import bisect
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.arrow import rows_of
from ..functions.regex_compat import SPACE_CODES, anchors, to_python
from . import rules as R

SPACE = {chr(c) for c in SPACE_CODES}
FINDING = (
    "id int, rule_id string, category string, severity string, fix string, converted string, match string, start int, end int, sentence_start int, "
    "sentence_end int, line int, context string, quoted boolean, review_reason string, in_comment boolean, selected boolean"
)
_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
#: Thresholds of the findings on whole documents.
MANY_WORDS, EM_DASHES, SEMICOLONS, FEWEST_SEMICOLONS = 200, 6, 20, 8
FEWEST_SENTENCES, FEWEST_TRANSITIONS, TRANSITION_SHARE, SENTENCE_CHARS, STYLE_PHRASES = 8, 3, 0.18, 20, 5
DOCUMENT_CONTEXT = "(document-level metric)"
#: What a log calls each fix, and the characters of a detail that it shows.
LOGGED, SHOWN = {R.REMOVE_SENTENCE: "removed sentence", R.REMOVE_MATCH: "removed", R.CONVERT: "converted"}, 110


def _compiled(rules: tuple[R.Rule, ...] | None = None):
    return _patterns(tuple(R.RULES) if rules is None else rules)


@functools.lru_cache(maxsize=4)
def _patterns(rules: tuple[R.Rule, ...]):
    alternatives = lambda names: "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    environment = lambda names: re.compile(rf"\\begin\{{({alternatives(names)})\}}")
    return {
        "rules": [(r, to_python(r.pattern, r.flags), anchors(r.pattern, r.flags)) for r in rules],
        "skip": environment(R.SKIPPED_ENVIRONMENTS),
        "quote": environment(R.QUOTED_ENVIRONMENTS),
        "verb": re.compile(r"\\verb\*?(?![a-zA-Z])([^\n\r\u2028\u2029])"),
        "inline": re.compile(r"\\lstinline(?:\[[^\]]*\])?([^\n\r\u2028\u2029])"),
        "braced": re.compile(r"\\(?:enquote|say|textquote)\*?[" + "".join(SPACE) + r"]*\{"),
        "reported": to_python(R.REPORTED_WORDS.replace(" ", "\\x20"), "i"),
        "macro": re.compile(r"\\(?:re)?newcommand|\\def(?![A-Za-z0-9_])"),
        "abbreviation": re.compile(r"(?<![A-Za-z0-9_])(?:" + alternatives(R.ABBREVIATIONS) + r")\.$", re.I | re.A),
        "initial": re.compile(r"(?:^|[" + "".join(SPACE) + r"])[A-Z]\.$"),
        "transition": to_python(r"^(?:" + "|".join(t.replace(" ", r"\s+") for t in R.TRANSITIONS) + r")\b", "i"),
        "sentence": re.compile(r"[.!?][" + "".join(SPACE) + "]+"),
        "word": re.compile("[^" + "".join(SPACE) + "]+"),
    }


class Text:
    """One document with what its guards need, each worked out once."""

    def __init__(self, text: str, filetype: str, rules: tuple[R.Rule, ...] | None = None):
        self.text, self.tex, self.c = text, filetype == "tex", _compiled(rules)
        self.breaks = [i for i, ch in enumerate(text) if ch == "\n"] if "\n" in text else []

    def line(self, at: int) -> int:
        return 1 + bisect.bisect_left(self.breaks, at)

    def line_start(self, at: int) -> int:
        k = bisect.bisect_left(self.breaks, at)
        return self.breaks[k - 1] + 1 if k else 0

    def _environments(self, pattern: re.Pattern) -> list[tuple[int, int]]:
        out, at = [], 0
        while m := pattern.search(self.text, at):
            close = f"\\end{{{m[1]}}}"
            end = self.text.find(close, m.end())
            at = len(self.text) if end < 0 else end + len(close)
            out.append((m.start(), at))
        return out

    @functools.cached_property
    def skipped(self) -> list[tuple[int, int]]:
        if not self.tex:
            return []
        out = self._environments(self.c["skip"])
        for name in ("verb", "inline"):  # the delimiter that opens also closes, even a brace
            for m in self.c[name].finditer(self.text):
                end = self.text.find(m[1], m.end())
                out.append((m.start(), len(self.text) if end < 0 else end + 1))
        return out

    @functools.cached_property
    def quoted_ranges(self) -> list[tuple[int, int]]:
        if not self.tex:
            return []
        out = self._environments(self.c["quote"])
        for m in self.c["braced"].finditer(self.text):
            depth, i = 1, m.end()
            while i < len(self.text) and depth:
                ch = self.text[i]
                i += 2 if ch == "\\" else 1
                depth += (ch == "{") - (ch == "}")
            out.append((m.start(), i))
        return out

    def commented(self, at: int) -> bool:
        return self.tex and re.search(r"(?<!\\)%", self.text[self.line_start(at) - 1 if self.line_start(at) else 0 : at]) is not None

    def in_quotes(self, at: int) -> bool:
        blank = self.text.rfind("\n\n", 0, at + 2)
        before = self.text[max(blank, 0) : at]
        if before.count("\u201c") > before.count("\u201d") or before.count("``") > before.count("''"):
            return True
        return len(re.findall(r'(?<!\\)"', before)) % 2 == 1

    def _ends_sentence(self, i: int) -> bool:
        ch, t = self.text[i], self.text
        if ch in "!?":
            return True
        if ch != "." or (i + 1 < len(t) and t[i + 1] not in SPACE):
            return False
        before = t[max(0, i - 10) : i + 1]
        return not (self.c["abbreviation"].search(before) or self.c["initial"].search(before))

    @functools.cached_property
    def stops(self) -> list[int]:
        """Where sentences end: positions of their last character."""
        return [m.start() for m in re.finditer(r"[.!?]", self.text) if self._ends_sentence(m.start())]

    @functools.cached_property
    def blanks(self) -> list[int]:
        """Positions of line breaks that another line break follows."""
        return [i for i in self.breaks if self.text[i + 1 : i + 2] == "\n"]

    def sentence(self, start: int, end: int) -> tuple[int, int]:
        """The sentence around [start, end): back to a stop or a blank line, on to the next, with the blanks behind it."""
        t, n = self.text, len(self.text)
        k, b = bisect.bisect_left(self.stops, start), bisect.bisect_left(self.blanks, start - 1)
        s = max(self.stops[k - 1] + 1 if k else 0, self.blanks[b - 1] + 2 if b else 0)
        while s < start and t[s] in SPACE:
            s += 1
        e = max(start, end)
        k, b = bisect.bisect_left(self.stops, e), bisect.bisect_left(self.blanks, e)
        stop = self.stops[k] + 1 if k < len(self.stops) else n
        e = min(stop, self.blanks[b] if b < len(self.blanks) else n)
        while e < n and t[e] in " \t":
            e += 1
        if t[e : e + 1] == "\n" and t[e + 1 : e + 2] != "\n":
            e += 1
        return s, e


def convert(rule_id: str, match: str) -> str | None:
    """What a match of a converting rule becomes."""
    if rule_id == "md-bold":
        return f"\\textbf{{{match[2:-2]}}}"
    if rule_id == "md-link":
        label, _, url = match[1:-1].partition("](")
        return f"\\href{{{url}}}{{{label}}}"
    return {"\u00a0": " ", "\u201c": "``", "\u201d": "''", "\u2018": "`", "\u2019": "'"}.get(match)


def densities(text: str, filetype: str) -> dict[str, int]:
    """Counts that the findings on whole documents hang on."""
    c = _compiled()
    dashes = text.count("\u2014") + (len(re.findall(r"(?<!-)---(?!-)", text)) if filetype == "tex" else 0)
    space = "".join(SPACE)
    sentences = [s for x in c["sentence"].split(text) if len(s := x.strip(space)) > SENTENCE_CHARS]
    return {"words": len(c["word"].findall(text)), "em_dashes": dashes, "semicolons": text.count(";"), "sentences": len(sentences), "transitions": sum(bool(c["transition"].match(s)) for s in sentences)}


def findings(text: str, filetype: str, rules: tuple[R.Rule, ...] | None = None) -> list[dict]:
    """All findings of one text, by start; ids number them by rule first.  ``rules``: those registered, unless given."""
    doc, out = Text(text, filetype, rules), []
    within = lambda ranges, at: any(a <= at < z for a, z in ranges)
    low = text.lower()
    for rule, pattern, need in doc.c["rules"]:
        if rule.tex_only and not doc.tex:
            continue
        if need and not any(a in (low if "i" in rule.flags else text) for a in need):
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            while start < end - 1 and (text[start] in SPACE or text[start] in ".!?"):
                start += 1
            if within(doc.skipped, start):
                continue
            ss, se = doc.sentence(start, end)
            reason = None
            if rule.category == "chat-artifact":
                if doc.in_quotes(start):
                    reason = "quoted"
                elif within(doc.quoted_ranges, start):
                    reason = "quote/table environment"
                elif rule.id in R.REPORTED_RULES and doc.c["reported"].search(f"{text[ss:start]} {text[end:se]}"):
                    reason = "reported speech"
            if rule.id == "md-bold" and doc.c["macro"].search(text[doc.line_start(start) : start]):
                reason = "macro definition"
            quoted = reason is not None
            severity = "medium" if quoted and rule.severity == "high" else rule.severity
            safe = severity == "high" or (severity == "medium" and rule.fix != R.FLAG and rule.preselect)
            out.append({
                "rule_id": rule.id, "category": rule.category, "severity": severity, "fix": R.FLAG if quoted else rule.fix, "converted": (rule.becomes(m[0]) if rule.becomes else convert(rule.id, m[0])) if rule.fix == R.CONVERT else None,
                "match": m[0], "start": start, "end": end, "sentence_start": ss, "sentence_end": se, "line": doc.line(start), "context": text[ss:se][:300], "quoted": quoted, "review_reason": reason,
                "in_comment": doc.commented(start), "selected": not quoted and safe,
            })
    d = densities(text, filetype)
    long = d["words"] > MANY_WORDS
    style = sum(f["rule_id"] == "style-phrases" for f in out)
    share = d["transitions"] / d["sentences"] if d["sentences"] else 0
    for rule_id, severity, match, fires in (
        ("em-dash-density", "low", "\u2014", long and d["em_dashes"] / d["words"] * 1000 > EM_DASHES),
        ("semicolon-density", "low", ";", long and d["semicolons"] >= FEWEST_SEMICOLONS and d["semicolons"] / d["words"] * 1000 > SEMICOLONS),
        ("transition-density", "low", "", d["sentences"] >= FEWEST_SENTENCES and d["transitions"] >= FEWEST_TRANSITIONS and share > TRANSITION_SHARE),
        ("style-density", "medium", "", style >= STYLE_PHRASES),
    ):
        if fires:
            out.append({"rule_id": rule_id, "category": "style", "severity": severity, "fix": R.FLAG, "match": match, "start": 0, "end": 0, "sentence_start": 0, "sentence_end": 0, "line": 1, "context": DOCUMENT_CONTEXT, "quoted": False, "in_comment": False, "selected": False})
    for k, f in enumerate(out):
        f["id"] = k
    return sorted(out, key=lambda f: f["start"])


def shown(s: str | None, n: int = SHOWN) -> str:
    """White space as single blanks, cut to ``n`` characters with an ellipsis."""
    s = re.sub(r"\s+", " ", s or "").strip()
    return s[: n - 1] + "…" if len(s) > n else s


def collapse_blank(text: str) -> str:
    """Three or more line breaks become two, then blanks before a line break go."""
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", text))


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Splice (start, end, replacement) edits; overlapping ones become one, which removes if any of them does."""
    merged: list[list] = []
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
            merged[-1][2] = merged[-1][2] if new and merged[-1][2] else ""
        else:
            merged.append([start, end, new])
    kept = [0, *(e[1] for e in merged)]
    return "".join([text[a:e[0]] + e[2] for a, e in zip(kept, merged, strict=False)]) + text[kept[-1] :]


def scan(docs: DataFrame) -> DataFrame:
    """A row per finding: doc_id and the columns of FINDING.  ``docs``: doc_id, text, filetype.  Null texts have none."""
    names = [x.split(" ")[0] for x in FINDING.split(", ")]
    types = [_TYPES[x.split(" ")[1]] for x in FINDING.split(", ")]
    rules = tuple(R.RULES)  # workers import the module afresh and know of no others

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for doc_id, text, filetype in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = findings(text, filetype, rules) if text else []
                ids += [doc_id] * len(got)
                rows += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True))], names=["doc_id", *names])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "filetype").mapInArrow(run, f"doc_id long, {FINDING}")


def _comment(text: str, at: int) -> tuple[int, int]:
    """The comment around ``at``: with its line break if nothing stands before it."""
    begin = text.rfind("\n", 0, at) + 1
    sign = next((m.start() for m in re.finditer(r"(?<!\\)%", text[:at]) if m.start() >= begin), begin)
    stop = text.find("\n", at)
    stop = len(text) if stop < 0 else stop
    return (begin, min(stop + 1, len(text))) if sign == begin else (sign, stop)


def mend(text: str, filetype: str, rules: tuple[R.Rule, ...] | None = None) -> tuple[str, list[dict]]:
    """The text with all selected findings mended, and a log: sentences or matches removed, or matches converted."""
    edits, log = [], []
    for f in findings(text, filetype, rules):
        if not f["selected"]:
            continue
        start, end, what = f["start"], f["end"], f["match"]
        if f["fix"] == R.CONVERT:
            edits.append((start, end, f["converted"]))
        elif f["fix"] == R.REMOVE_MATCH:
            after = text[end : end + 1]
            if after == " " and (start == 0 or text[start - 1] in SPACE):  # no doubled blanks
                end += 1
            elif text[start - 1 : start] == " " and (not after or after in SPACE or after in ".,;)"):
                start -= 1
            edits.append((start, end, ""))
        else:
            span = _comment(text, start) if f["in_comment"] else (f["sentence_start"], f["sentence_end"])
            edits.append((*span, ""))
            what = text[slice(*span)]
        becomes = "" if f["converted"] is None else f" → {shown(f['converted'])}"
        log.append({"line": f["line"], "action": LOGGED[f["fix"]], "detail": f"{f['rule_id']}: {shown(what)}{becomes}"})
    return collapse_blank(apply_edits(text, edits)), log


def fix(text: str, filetype: str, rules: tuple[R.Rule, ...] | None = None) -> str:
    """The text with all selected findings mended."""
    return mend(text, filetype, rules)[0]


def fixed(docs: DataFrame) -> DataFrame:
    """doc_id, fixed: every text with its selected findings mended (null stays null)."""
    rules = tuple(R.RULES)

    def run(batches):
        for batch in batches:
            new = [None if t is None else fix(t, k, rules) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["doc_id", "fixed"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text", "filetype").mapInArrow(run, "doc_id long, fixed string")


def changes(docs: DataFrame) -> DataFrame:
    """doc_id, line, action, detail: a row per change that mending makes."""
    rules = tuple(R.RULES)
    log = lambda text, filetype: [(c["line"], c["action"], c["detail"]) for c in mend(text, filetype, rules)[1]]
    return rows_of(docs, ["text", "filetype"], log, [("line", "int", pa.int32()), ("action", "string", pa.string()), ("detail", "string", pa.string())])
