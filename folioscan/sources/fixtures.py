"""Views over the test tables that give the rules something to find, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Put behind every document's text, by doc_id.
ARTEFACTS = [
    "As an AI language model, this is uncertain.", "Certainly! Here is the revised text.", "Let me know if you need more.", "I hope this helps with the draft.", "We show [insert result here] in full.",
    "A TODO remains: [TODO check numbers].", "It was shown before [citation needed] that this holds.", "See Figure X for details.", "A plethora of methods delve into the topic.", "\\cite{smith2020, jones2021} agree.",
    "% \\cite{hidden} is out", "Some **bold claim** stands.", "\\citep[see][p. 2]{lee2019} and \\nocite{*} too.", "I cannot access the file.", "You're absolutely right about that.",
    "The doi:10.1000/abc.12 and arXiv:2106.01234v2 say so.", "Thank you for pointing that out.", "\\textcite{smith2020} and \\cite{kim2022}.", "nothing to see", "Feel free to adjust the wording.", "Overall, the \u201cquoted\u201d text delves into a myriad of things.",
]


def corpus(docs: DataFrame) -> DataFrame:
    """doc_id, filetype, text: every document with an artefact behind it."""
    pick = F.element_at(F.array(*[F.lit(a) for a in ARTEFACTS]), (F.col("doc_id") % len(ARTEFACTS)).cast("int") + 1)
    kind = F.when(F.col("doc_id") % 4 == 0, "txt").when(F.col("doc_id") % 4 == 1, "bib").otherwise("tex")
    return docs.select("doc_id", kind.alias("filetype"), F.concat("text", F.lit("\n"), pick).alias("text"))


def _corpus_sql() -> str:
    items = ", ".join("'" + s.replace("'", "''") + "'" for s in ARTEFACTS)
    return f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'bib' ELSE 'tex' END AS filetype, text || chr(10) || ([{items}])[(doc_id % {len(ARTEFACTS)})::INT + 1] AS text FROM documents"


#: The same for DuckDB.
CORPUS_SQL = _corpus_sql()


#: Openings of documents that put a phrase where a guard must judge it: filetype, opening, what mending makes of it.
GUARD_CASES = [
    ("txt", "A first point. I hope this helps. Next one.", "A first point. Next one."),
    ("txt", "He said \u201cI hope this helps\u201d.", None),
    ("tex", "``I hope this helps'' it said.", None),
    ("txt", 'It is "I hope this helps" there.', None),
    ("txt", 'An open " sign.\n\nI hope this helps.', 'An open " sign.\n\n'),
    ("tex", "\\begin{quote}I hope this helps. \\end{quote}", None),
    ("tex", "\\enquote{a {b} I hope this helps. } x.", None),
    ("tex", "The response was: as an AI model I stop.", None),
    ("tex", "\\newcommand{\\b}{**x**}", None),
    ("tex", "\\begin{verbatim}I hope this helps.\\end{verbatim}", None),
    ("tex", "\\verb|I hope this helps| ends.", None),
    ("tex", "% I hope this helps.\nNext line.", "Next line."),
    ("tex", "Text. % I hope this helps\nNext line.", "Text. \nNext line."),
    ("txt", "So it was [citation needed] that day.", "So it was that day."),
    ("txt", "We saw it [citation needed].", "We saw it."),
    ("tex", "See [a label](http://b.c/d) now.", "See \\href{http://b.c/d}{a label} now."),
    ("tex", "A \u201cword\u201d here.", None),
    ("txt", "Fig. 2 is by J. Smith et al. there. I hope this helps! Next.", "Fig. 2 is by J. Smith et al. there. Next."),
    ("txt", "Done. Certainly! Here is the text.", "Done. "),
    ("txt", "If you have any further questions, ask.", None),
    ("txt", "nothing to see", None),
    ("txt", "a\u200bb here.", "ab here."),
    ("bib", "\\begin{verbatim}I hope this helps. \\end{verbatim}", "\\end{verbatim}"),
]

#: What the scan must find there: case, rule, category, severity, fix, converted, match, signs before its start, sentence,
#: reason, whether in a comment, whether selected, and the log of its mending.
GUARD_FINDINGS = [
    (0, "hope-helps", "chat-artifact", "high", "remove-sentence", None, "I hope this helps", 0, "I hope this helps. ", None, False, True, "removed sentence|hope-helps: I hope this helps."),
    (1, "hope-helps", "chat-artifact", "medium", "flag", None, "I hope this helps", 0, "He said \u201cI hope this helps\u201d.", "quoted", False, False, None),
    (2, "hope-helps", "chat-artifact", "medium", "flag", None, "I hope this helps", 0, "``I hope this helps'' it said.", "quoted", False, False, None),
    (3, "hope-helps", "chat-artifact", "medium", "flag", None, "I hope this helps", 0, 'It is "I hope this helps" there.', "quoted", False, False, None),
    (4, "hope-helps", "chat-artifact", "high", "remove-sentence", None, "I hope this helps", 0, "I hope this helps.", None, False, True, "removed sentence|hope-helps: I hope this helps."),
    (5, "hope-helps", "chat-artifact", "medium", "flag", None, "I hope this helps", 0, "\\begin{quote}I hope this helps. ", "quote/table environment", False, False, None),
    (6, "hope-helps", "chat-artifact", "medium", "flag", None, "I hope this helps", 0, "\\enquote{a {b} I hope this helps. ", "quote/table environment", False, False, None),
    (7, "ai-self-ref", "chat-artifact", "medium", "flag", None, "as an AI model", 0, "The response was: as an AI model I stop.", "reported speech", False, False, None),
    (8, "md-bold", "paste-artifact", "medium", "flag", "\\textbf{x}", "**x**", 0, "\\newcommand{\\b}{**x**}", "macro definition", False, False, None),
    (11, "hope-helps", "chat-artifact", "high", "remove-sentence", None, "I hope this helps", 0, "% I hope this helps.\n", None, True, True, "removed sentence|hope-helps: % I hope this helps."),
    (12, "hope-helps", "chat-artifact", "high", "remove-sentence", None, "I hope this helps", 0, "% I hope this helps\nNext line.", None, True, True, "removed sentence|hope-helps: % I hope this helps"),
    (13, "citation-needed", "placeholder", "medium", "remove-match", None, "[citation needed]", 0, "So it was [citation needed] that day.", None, False, True, "removed|citation-needed: [citation needed]"),
    (14, "citation-needed", "placeholder", "medium", "remove-match", None, "[citation needed]", 0, "We saw it [citation needed].", None, False, True, "removed|citation-needed: [citation needed]"),
    (15, "md-link", "paste-artifact", "medium", "convert", "\\href{http://b.c/d}{a label}", "[a label](http://b.c/d)", 0, "See [a label](http://b.c/d) now.", None, False, True, "converted|md-link: [a label](http://b.c/d) \u2192 \\href{http://b.c/d}{a label}"),
    (16, "smart-quotes-tex", "paste-artifact", "medium", "convert", "``", "\u201c", 0, "A \u201cword\u201d here.", None, False, False, None),
    (16, "smart-quotes-tex", "paste-artifact", "medium", "convert", "''", "\u201d", 0, "A \u201cword\u201d here.", None, False, False, None),
    (17, "hope-helps", "chat-artifact", "high", "remove-sentence", None, "I hope this helps", 0, "I hope this helps! ", None, False, True, "removed sentence|hope-helps: I hope this helps!"),
    (18, "chat-opener", "chat-artifact", "high", "remove-sentence", None, ". Certainly! Here is", 2, "Certainly! Here is the text.", None, False, True, "removed sentence|chat-opener: Certainly! Here is the text."),
    (19, "if-questions", "chat-artifact", "medium", "flag", None, "If you have any further questions", 0, "If you have any further questions, ask.", None, False, False, None),
    (21, "invisible-unicode", "paste-artifact", "medium", "remove-match", None, "\u200b", 0, "a\u200bb here.", None, False, True, "removed|invisible-unicode: \u200b"),
    (22, "hope-helps", "chat-artifact", "high", "remove-sentence", None, "I hope this helps", 0, "\\begin{verbatim}I hope this helps. ", None, False, True, "removed sentence|hope-helps: \\begin{verbatim}I hope this helps."),
]


def guarded(docs: DataFrame) -> DataFrame:
    """doc_id, k, filetype, opening, text: every document's whole text behind an opening and a blank line."""
    case = F.element_at(F.array(*[F.struct(F.lit(kind).alias("filetype"), F.lit(text).alias("opening")) for kind, text, _ in GUARD_CASES]), (F.col("doc_id") % len(GUARD_CASES)).cast("int") + 1)
    x = docs.where("doc_id is not null and text is not null").select("doc_id", "text", (F.col("doc_id") % len(GUARD_CASES)).cast("int").alias("k"), case.alias("c"))
    return x.select("doc_id", "k", "c.filetype", "c.opening", F.concat("c.opening", F.lit("\n\n"), "text").alias("text"))


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


#: The same for DuckDB: cases c, findings e in them, and documents g with their opening.
GUARDED_SQL = f"""WITH c(k, filetype, opening, mended) AS {_values((k, a, b, b if m is None else m) for k, (a, b, m) in enumerate(GUARD_CASES))},
e(k, rule_id, category, severity, fix, converted, match, skip, sentence, review_reason, in_comment, selected, log) AS {_values(GUARD_FINDINGS)},
g AS (SELECT doc_id, text, c.* FROM documents JOIN c ON c.k = doc_id % {len(GUARD_CASES)} WHERE text IS NOT NULL) """
