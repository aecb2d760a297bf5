"""Rules, guards, edits, citations and functions on small cases; every query with SQL against DuckDB."""

import collections
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscan import linkage_queries as L
from folioscan import queries as Q
from folioscan.functions import text as X
from folioscan.functions.regex_compat import anchors, to_java, to_python
from folioscan.operators import scan as S
from folioscan.operators import tex
from folioscan.operators.rules import RULES, Rule

#: A text for each rule that it must find.
POSITIVE = {
    "ai-self-ref": "Speaking as an AI language model we stop.", "llm-self-ref": "And as a large\nlanguage model it ended.", "i-am-ai": "I'm just an AI here.", "no-opinions": "I don't have personal opinions on it.", "cutoff": "Until my knowledge cutoff it held.",
    "cannot-fulfill": "I am unable to browse it.", "sorry-but-i": "I'm sorry, but I must stop.", "chat-opener": "Done. Sure! Here is it.", "heres-your": "Here's your text.", "ive-updated": "I have now revised the part.", "here-you-go": "Here you go:", "hope-helps": "I hope this helps.",
    "let-me-know": "Let me know if anything fails.", "feel-free": "Feel free to tweak it.", "would-you-like": "Would you like me to go on?", "anything-else": "Is there anything else I can do?", "glad-help": "I'm happy to assist.", "youre-right": "You are quite right.",
    "thanks-pointing": "Thanks for clarifying.", "apologize-confusion": "We apologise for any oversight.", "good-catch": "Great point, it is.", "understand-concern": "I fully understand your point.", "as-per-request": "As per your prompt it is.", "chatgpt-ui": "x\nCopy code\ny",
    "if-questions": "If you have any further questions, ask.", "dont-hesitate": "Do not hesitate to contact us.", "ai-attribution": "This abstract was drafted with ChatGPT.", "placeholder-bracket": "Yes [your name].", "todo-bracket": "See [TBD].", "citation-needed": "So [citation needed].",
    "author-year-placeholder": "So (Author et al., 2020).", "generic-cite-key": "\\cite{ref1}", "figure-x": "In Table ?? it is.", "insert-figure": "Insert figure here.", "lorem": "Lorem ipsum.", "md-bold": "A **b** c", "md-heading": "# Head", "md-fence": "```python", "md-link": "[a](http://b.c)",
    "invisible-unicode": "a\u200bb", "nbsp-tex": "a\u00a0b", "emoji-tex": "a \U0001f600", "smart-quotes-tex": "\u201ca\u201d", "bullet-tex": "\u2022 a", "style-phrases": "A plethora of it.", "summary-hint": "Here's a brief overview.",
}
NEGATIVE = ["The AI model was trained.", "We hope the reader sees that it helps.", "The rights of users.", "you are right-handed", "todo list [see x]", "A figure is here.", "caf\u00e9as an ai\u00e9"]


@pytest.mark.parametrize("rule", [r.id for r in RULES])
def test_every_rule_finds_its_text(rule):
    assert rule in {f["rule_id"] for f in S.findings(POSITIVE[rule], "tex")}


def test_negatives_and_filetypes():
    assert not [f for t in NEGATIVE[:-1] for f in S.findings(t, "txt") if f["selected"]]
    assert S.findings(NEGATIVE[-1], "txt")  # boundaries are those of ASCII words
    assert not S.findings("A **b** c", "txt")


@pytest.mark.parametrize(
    ("text", "rule", "severity", "selected", "reason"),
    [
        ("He said \u201cI hope this helps\u201d.", "hope-helps", "medium", False, "quoted"),
        ("``I hope this helps'' it said", "hope-helps", "medium", False, "quoted"),
        ('It is "I hope this helps" there', "hope-helps", "medium", False, "quoted"),
        ('a " b\n\nI hope this helps.', "hope-helps", "high", True, None),
        ("\\begin{quote}I hope this helps.\\end{quote}", "hope-helps", "medium", False, "quote/table environment"),
        ("\\enquote{a {b} I hope this helps} x", "hope-helps", "medium", False, "quote/table environment"),
        ("The response was: as an AI model I stop.", "ai-self-ref", "medium", False, "reported speech"),
        ("\\newcommand{\\b}{**x**}", "md-bold", "medium", False, "macro definition"),
        ("I hope this helps.", "hope-helps", "high", True, None),
    ],
)
def test_guards(text, rule, severity, selected, reason):
    f = next(f for f in S.findings(text, "tex") if f["rule_id"] == rule)
    assert (f["severity"], f["selected"], f["review_reason"]) == (severity, selected, reason)


def test_skipped_ranges_and_comments():
    for t in ("\\begin{verbatim}I hope this helps.\\end{verbatim}", "\\begin{minted}I hope this helps.", "\\verb|I hope this helps|", "\\lstinline{I hope this helps} and {"):
        assert not S.findings(t, "tex")
    assert [f["in_comment"] for f in S.findings("a \\% b I hope this helps.\n% I hope this helps.", "tex")] == [False, True]


def test_sentences_and_edits():
    t = "See Fig. 2 for J. Smith et al. there. I hope this helps. Next one."
    f = S.findings(t, "txt")[0]
    assert t[f["sentence_start"] : f["sentence_end"]] == "I hope this helps. " and S.fix(t, "txt") == "See Fig. 2 for J. Smith et al. there. Next one."
    assert S.apply_edits("abcdef", [(1, 3, "X"), (2, 4, ""), (5, 5, "p"), (5, 5, "q")]) == "aepqf"
    assert S.fix("a [citation needed] b", "txt") == "a b" and S.fix("A **b** c", "tex") == "A \\textbf{b} c" and S.fix("[a](http://b.c)", "tex") == "\\href{http://b.c}{a}"
    assert S.fix("x % I hope this helps\ny", "tex") == "x\ny" or S.fix("x % I hope this helps\ny", "tex") == "x \ny"
    assert S.fix("% I hope this helps\ny", "tex") == "y" and S.collapse_blank("a\n\n\n\nb  \n") == "a\n\nb\n"
    for t in POSITIVE.values():
        for f in S.findings(t, "tex"):
            assert 0 <= f["sentence_start"] <= f["start"] < f["end"] <= len(t)


def test_densities():
    words = "word " * 201
    ids = lambda t, k="txt": {f["rule_id"] for f in S.findings(t, k)}
    assert "em-dash-density" in ids(words + "\u2014 " * 3) and "em-dash-density" not in ids(words) and "em-dash-density" in ids(words + "a---b " * 3, "tex")
    assert "semicolon-density" in ids(words + "; " * 9) and "semicolon-density" not in ids("; " * 9)
    assert "transition-density" in ids("Moreover this is quite a long sentence. " * 4 + "This is quite a long sentence too. " * 6)
    assert "style-density" in ids("A plethora of it. " * 5)


def test_anchors_are_in_every_match():
    for r in RULES:
        need, m = anchors(r.pattern, r.flags), to_python(r.pattern, r.flags).search(POSITIVE[r.id])
        assert m and (not need or any(a in (m[0].lower() if "i" in r.flags else m[0]) for a in need)), r.id


def test_java_and_python_agree(spark):
    texts = [*POSITIVE.values(), *NEGATIVE, "", "as\u00a0an AI"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = df.select("i", *[F.regexp_count("t", F.lit(to_java(r.pattern, r.flags))).alias(f"r{k}") for k, r in enumerate(RULES)]).collect()
    for row in got:
        for k, r in enumerate(RULES):
            assert row[f"r{k}"] == len(to_python(r.pattern, r.flags).findall(texts[row.i])), (r.id, texts[row.i])


def test_citations(spark):
    t = "\\cite{a, b} \\Citep*[see][p. 2]{c}\n% \\cite{gone}\n\\% \\autocites{d}{e} \\nocite{*} \\citefoo{x}"
    df = spark.createDataFrame([(1, t, "tex"), (2, "\\cite{z}", "txt"), (3, None, "tex")], "doc_id long, text string, filetype string")
    got = tex.citations(df)
    assert [(r.command, r["keys"]) for r in got.collect()] == [("cite", ["a", "b"]), ("citep", ["c"]), ("autocite", ["d"]), ("nocite", ["*"])]
    defined = spark.createDataFrame([("a",), ("q",)], "key string")
    assert {(r.key, r.state) for r in tex.cross_check(tex.used_keys(got), defined).collect()} == {("b", "missing"), ("c", "missing"), ("d", "missing"), ("q", "unused")}


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert one(X.normalize_title(F.lit("{\\em \u00c9tude} -- on $x$"))) == "etude on x" and one(X.normalize_title(F.lit(None).cast("string"))) == ""
    assert one(X.title_similarity(F.lit("a b"), F.lit("a b"))) == 1 and one(X.title_similarity(F.lit(""), F.lit("a"))) == 0 and one(X.title_similarity(F.lit("deep nets"), F.lit("nets deep"))) == 1
    assert one(X.author_last_names(F.lit("van der Berg, Rianne and M\u00fcller and Ada {Love} and others"))) == ["vanderberg", "muller", "love"]
    assert one(X.author_overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(X.arxiv_id(F.lit("arXiv:2106.01234v2"))) == "2106.01234" and one(X.arxiv_id(F.lit("abs/hep-th/9901001"))) == "hep-th/9901001" and one(X.arxiv_id(F.lit("2106.01234"))) == "2106.01234" and one(X.arxiv_id(F.lit("x"))) is None
    assert one(X.clean_doi(F.lit("https://doi.org/10.1000/a.b)."))) == "10.1000/a.b" and one(X.clean_doi(F.lit("11.1/a"))) is None


def test_new_rules_can_be_registered(spark, monkeypatch):
    monkeypatch.setattr(S.R, "RULES", list(RULES))
    S.R.register_rule(Rule("own", "style", "low", r"\bfoo bar\b", "i", "flag"))
    S.R.register_rule(Rule("caps", "style", "medium", r"\bshout\b", "", "convert", becomes=str.upper))
    assert [f["rule_id"] for f in S.findings("a Foo\nbar", "txt")] == ["own"]
    df = spark.createDataFrame([(1, "a Foo\nbar to shout"), (2, None)], "doc_id long, text string").withColumn("filetype", F.lit("txt"))
    assert [(r.rule_id, r.converted) for r in S.scan(df).collect()] == [("own", None), ("caps", "SHOUT")]
    assert [r.fixed for r in S.fixed(df).collect()] == ["a Foo\nbar to SHOUT", None] and [r.detail for r in S.changes(df).collect()] == ["caps: shout \u2192 SHOUT"]


@pytest.mark.parametrize("name", sorted(Q.ORACLES | L.ORACLES))
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    at = "/root/testdata/sf0.001"
    if not Path(at).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in Path(at).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = (Q.QUERIES | L.QUERIES)[name](spark, at)
    sql = con.execute((Q.ORACLES | L.ORACLES)[name])
    cols = [d[0] for d in sql.description]
    assert sorted(cols) == sorted(df.columns)
    rows = collections.Counter(sql.fetchall())
    assert rows and collections.Counter(tuple(r[c] for c in cols) for r in df.collect()) == rows


def test_entry_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['folioscan.llm'] = None; import __spark_entry__ as e; assert 'q_findings' in e.queries() and not [q for q in e.queries() if q.startswith('op')] and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0


def test_pdf_lines_cover_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(200))), (2, "one two"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.page): r.text for r in Q.q_pdf_lines(spark, str(tmp_path)).collect()}
    assert sorted(got) == [(1, k) for k in range(1, 11)] + [(2, 1)]
    assert "".join("".join(got[1, k].split()) for k in range(1, 11)) == "".join(f"w{k}" for k in range(200)) and got[2, 1].split() in (["one", "two"], ["onetwo"])


def test_rule_hits_have_every_rule(spark, tmp_path):
    spark.createDataFrame([(1, "You are absolutely right."), (2, "You are right-handed")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.rule_id: r for r in Q.q_rule_hits(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(r.id for r in RULES)
    texts = [r for r in Q.corpus(spark, str(tmp_path)).collect()]
    for rule in RULES:
        n = [len(re.findall(to_python(rule.pattern, rule.flags), r.text)) if r.filetype == "tex" or not rule.tex_only else 0 for r in texts]
        assert (got[rule.id].docs, got[rule.id].hits) == (sum(x > 0 for x in n), sum(n)), rule.id
    assert got["youre-right"].hits >= 1
