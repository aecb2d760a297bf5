"""Answers of services, files, places of citations and the demo paper."""

import pytest
from pyspark.sql import functions as F

from folioscan import source_queries as Q
from folioscan.functions import text as X
from folioscan.operators import bib, tex
from folioscan.operators import scan as S
from folioscan.sources import demo, files, payloads

BODIES = {
    payloads.S2: '{"data": [{"title": "A", "authors": [{"name": "X Y"}], "year": 0, "venue": "", "externalIds": {"ArXiv": "2001.00001"}}, {"title": ""}, {"title": "B"}]}',
    payloads.CROSSREF: '{"message": {"title": "[Note] on {x}", "author": [{"family": "Z"}], "published": {"date-parts": [[2001, 2]]}, "DOI": "10.1/a", "publisher": "P"}}',
    payloads.OPENALEX: '{"results": [{"title": "C", "doi": "https://doi.org/10.1/c", "authorships": [{"author": {"display_name": "U V"}}, {"author": {}}]}]}',
    payloads.DBLP: '{"result": {"hits": {"hit": [{"info": {"title": "D.", "authors": {"author": {"@pid": "1", "text": "M N 0002"}}, "year": "1999"}}, {"info": {"title": "E", "authors": {"author": "O P"}}}, {"info": {}}]}}}',
}
FOUND = {
    payloads.S2: [(0, "A", ["X Y"], None, None, "2001.00001", ""), (2, "B", [], None, None, None, "")],
    payloads.CROSSREF: [(0, "[Note] on {x}", ["Z"], 2001, "10.1/a", None, "P")],
    payloads.OPENALEX: [(0, "C", ["U V"], None, "10.1/c", None, "")],
    payloads.DBLP: [(0, "D", ["M N"], 1999, None, None, ""), (1, "E", ["O P"], None, None, None, "")],
}


@pytest.mark.parametrize("source", list(BODIES))
def test_candidates(spark, source):
    answers = spark.createDataFrame([(1, BODIES[source]), (2, None), (3, ""), (4, "no json"), (5, "{}")], "id long, body string")
    rows = payloads.candidates(answers, source).orderBy("id", "rank").collect()
    assert [(r.id, *[r[c] for c in ("rank", "title", "authors", "year", "doi", "arxiv", "venue")]) for r in rows] == [(1, *f) for f in FOUND[source]]


def test_files(spark, tmp_path):
    for name, content in {"a.tex": b"caf\xc3\xa9", "b.BIB": b"@misc{a, b = 1}", "c.md": b"no", "sub/d.Pdf": b"%PDF", "e.bbl": b"z", "h.txt": b"", "f.latex": b"x", "g.txt": b"y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.file.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {n: (r.filetype, r.text, r.content and bytes(r.content)) for n, r in rows.items()} == {
        "a.tex": ("tex", "café", None), "b.BIB": ("bib", "@misc{a, b = 1}", None), "d.Pdf": ("pdf", None, b"%PDF"), "e.bbl": ("tex", "z", None), "f.latex": ("tex", "x", None), "g.txt": ("txt", "y", None),
    }
    assert len({r.doc_id for r in rows.values()}) == 6


def test_demo_paper(spark):
    """Its faults are those planted: none in the verbatim part, three phrases of style, no key without an entry."""
    docs = demo.demo(spark)
    found = S.scan(docs.where("filetype = 'tex'")).collect()
    assert sorted((f.line, f.rule_id, f.selected) for f in found) == [
        (6, "chat-opener", True), (6, "heres-your", True), (8, "style-phrases", False), (8, "style-phrases", False), (8, "style-phrases", False), (10, "md-bold", True),
        (11, "ai-self-ref", True), (11, "cannot-fulfill", True), (12, "placeholder-bracket", True), (16, "hope-helps", True), (16, "let-me-know", True),
    ]
    used = tex.used_keys(tex.citations(docs))
    entries = bib.entries(docs.where("filetype = 'bib'").withColumnRenamed("text", "src"))
    assert used.count() == entries.count() == 4 and tex.cross_check(used, entries.select("key")).count() == 0
    assert [r.resource for r in tex.bib_resources(docs).collect()] == ["refs"]


def test_citation_spans_and_warnings(spark):
    docs = spark.createDataFrame([(1, "a \\Cites* [x]\n{k, ,l}%\\cite{m}", "tex"), (2, None, "tex"), (3, "", "tex"), (4, "\\cite{a}", "txt")], "doc_id long, text string, filetype string")
    assert [tuple(r) for r in tex.citation_spans(docs).collect()] == [(1, "Cites", True, " [x]", ["k", "l"], 2, 21, 15, 1)]
    src = spark.createDataFrame([(1, "@misc{a, b = 1}\n@misc{a, b = 2"), (2, None), (3, "")], "doc_id long, src string")
    assert [(r.doc_id, r.line) for r in bib.warnings(src).collect()] == [(1, 2), (1, 2)]


def test_search_words(spark):
    t = spark.createDataFrame([("A {Big} x-ray of é 12 three four five six seven eight nine",), (None,), ("",)], "t string")
    assert [r[0] for r in t.select(X.search_words(F.col("t"))).collect()] == ["big ray of 12 three four five six", "", ""]


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    due = con.execute(Q.ORACLES[name])
    columns = sorted(c[0] for c in due.description)
    order = [[c[0] for c in due.description].index(c) for c in columns]
    got = sorted(map(repr, map(tuple, Q.QUERIES[name](spark, at).select(*[f"`{c}`" for c in columns]).collect())))
    assert got and got == sorted(repr(tuple(r[i] for i in order)) for r in due.fetchall())
