"""Reports and the scan over a stream."""

from folioscan.operators import report
from folioscan.operators.scan import scan
from folioscan.streaming.scan import scan_stream, write_findings

TEXT = "A plethora of | things.\n\nI hope this helps. See [TBD]."


def test_report(spark):
    df = spark.createDataFrame([(7, TEXT, "txt"), (8, "clean", "txt")], "doc_id long, text string, filetype string")
    rows = report.markdown(scan(df)).collect()
    assert [r.doc_id for r in rows] == [7]
    lines = rows[0].report.splitlines()
    assert lines[0] == "# Document 7" and lines[2] == "high 1, medium 1, low 1"
    assert [x.split(" | ")[0] for x in lines[6:]] == ["| high", "| medium", "| low"] and "A plethora of \\| things." in lines[8]


def test_stream(spark, tmp_path):
    schema = "doc_id long, text string, filetype string, at timestamp"
    rows = spark.sql("SELECT 1L AS doc_id, 'I hope this helps.' AS text, 'txt' AS filetype, timestamp'2024-01-01 00:00:00' AS at")
    for k in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for once, n in ((None, 2), ("at", 1)):
        out = str(tmp_path / f"out{once}")
        q = write_findings(scan_stream(stream, once), out, str(tmp_path / f"ck{once}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        found = spark.read.parquet(out)
        assert found.count() == n and found.first().rule_id == "hope-helps"


def test_combined_report(spark):
    files = spark.createDataFrame([(7, "a.txt", "txt", 2048), (8, "b.tex", "tex", 10)], "doc_id long, name string, kind string, size long")
    df = spark.createDataFrame([(7, TEXT, "txt")], "doc_id long, text string, filetype string")
    cited = [(7, "k", "A | title", "fixable", ["CrossRef"], [("year", "1999", "2001", False)], "", "fix"), (7, "l", None, "notfound", [], [], "none", "remove")]
    verdicts = spark.createDataFrame(cited, "doc_id long, key string, title string, status string, checked array<string>, corrections array<struct<field:string,current:string,correct:string,soft:boolean>>, note string, action string")
    checks = spark.createDataFrame([(7, "m", "missing"), (7, "u", "unused")], "doc_id long, key string, state string")
    got = {r.doc_id: r.report for r in report.combined(files, scan(df), verdicts, checks).collect()}
    for part in ("- `a.txt` (txt, 2.0 KB)", "| text findings | 3 (1 high, 1 medium, 1 low) |", "| citations checked | 2 |", "| ❌ not found | 1 |", "| cited but not defined | `m` |", "| defined but not cited | 1 |", "A \\| title", "year: 1999 → 2001"):
        assert part in got[7], part
    assert "None; that no rule" in got[8] and "## Citations" not in got[8] and "(tex, 10 B)" in got[8]


def test_log_of_changes(spark):
    from folioscan.operators.scan import changes, fix, mend

    df = spark.createDataFrame([(7, TEXT, "txt"), (8, None, "txt"), (9, "A **b** c", "tex")], "doc_id long, text string, filetype string")
    rows = sorted((r.doc_id, r.line, r.action, r.detail) for r in changes(df).collect())
    assert [r[:3] for r in rows] == [(7, 3, "removed sentence"), (9, 1, "converted")] and rows[1][3] == "md-bold: **b** → \\textbf{b}"
    assert mend(TEXT, "txt")[0] == fix(TEXT, "txt")


def test_archives(spark, tmp_path):
    import io
    import zipfile

    from folioscan.sources.archives import archives, write_archives

    df = spark.createDataFrame([(1, "é.txt", "text é"), (1, "a/b.txt", None), (2, "c", "")], "doc_id long, name string, content string")
    got = {r.doc_id: bytes(r.archive) for r in archives(df).collect()}
    with zipfile.ZipFile(io.BytesIO(got[1])) as z:
        assert z.namelist() == ["a/b.txt", "é.txt"] and z.read("é.txt").decode() == "text é" and z.testzip() is None
    rows = write_archives(df, f"file://{tmp_path}/out").collect()
    assert {r.doc_id: (tmp_path / "out" / f"{r.doc_id}.zip").read_bytes() for r in rows} == got
