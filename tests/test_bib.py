"""BibTeX parsing: spans, macros, comments, doubled keys, broken entries."""

from pyspark.sql import functions as F

from folioscan.operators import bib, pdf

SRC = """@string{jml = {J. of ML}} @comment{@x{y, a = 1}} me@mail.org
@Article{a1, title = {The {Deep} \\'{e}tude}, author = "Lee, A. and {Kim and Sons}", year = {in 2019}, journal = jml # ", " # 12,
  % note = {hidden},
  month = Jan, url = {https://doi.org/10.1000/x.1}}
% @misc{gone, title = {no}}
@misc(b2, title = "a {"}b{"} c", eprint = {2106.01234v2})
@misc{a1, note = unknown}
@book{, title = {no key}}
@misc{last, title = {open"""


def test_entries_and_warnings():
    entries, warnings = bib.parse(SRC)
    assert [(e["type"], e["key"], e["line"]) for e in entries] == [("article", "a1", 2), ("misc", "b2", 6), ("misc", "a1", 7), ("misc", "last", 9)]
    f = entries[0]["fields"]
    assert f["journal"]["value"] == "J. of ML, 12" and f["month"]["value"] == "January" and f["author"]["value"] == "Lee, A. and {Kim and Sons}" and "note" not in f
    for e in entries:
        assert SRC[e["start"]] == "@" and all(SRC[x["value_start"] : x["value_end"]] == x["raw"] for x in e["fields"].values())
    assert entries[1]["fields"]["title"]["value"] == 'a {"}b{"} c' and entries[2]["fields"]["note"]["value"] == "unknown"
    assert [w["line"] for w in warnings] == [7, 8, 9] and "a1" in warnings[0]["message"]
    assert bib.parse("") == ([], []) and bib.parse("@") == ([], [])


def test_derived_fields(spark):
    df = spark.createDataFrame([(1, SRC), (2, None), (3, "")], "doc_id long, src string")
    rows = bib.entries(df).collect()
    assert len(rows) == 4
    a, b = rows[0], rows[1]
    assert (a.title, a.year, a.doi, a.venue, a.indexable) == ("The Deep etude", "2019", "10.1000/x.1", "J. of ML, 12", True)
    assert (b.arxiv, b.year, b.indexable) == ("2106.01234", None, False)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(bib.plain(F.lit("\\textbf{Deep}"))) == "extbfDeep"  # the letters of accents are taken for one


def test_pages(spark):
    items = [(1, 1, 0, "a", 0.0, 0.0, 5.0), (1, 1, 1, "b", 7.0, 1.0, 5.0), (1, 1, 2, "c", 12.5, 0.0, 5.0), (1, 1, 3, " d", 30.0, 0.0, None), (1, 1, 4, "e", 0.0, 9.0, 1.0), (1, 301, 0, "z", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(items, "doc_id long, page int, seq int, str string, x double, y double, width double")
    assert [(r.page, r.text) for r in pdf.page_texts(df).collect()] == [(1, "a bc d\ne")]
