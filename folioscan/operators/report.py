"""The report: counts by severity and a table of findings, as rows and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The order of severities, and the characters of evidence that a table shows.
SEVERITY_RANK, SHOWN = {"high": 0, "medium": 1, "low": 2}, 120


def rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv]), severity)


def short(c: Column, n: int = SHOWN) -> Column:
    """White space as single blanks, cut to ``n`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 1)), F.lit("…"))).otherwise(t)


def cell(c: Column) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown(findings: DataFrame) -> DataFrame:
    """doc_id, report: Markdown per document with counts by severity and its findings, the most severe first.

    One shuffle by document brings its findings together; their number per document is that of one text's matches.
    """
    line = F.format_string("| %s | %d | %s | %s |", "severity", "line", "rule_id", cell(short(F.col("context"))))
    rows = findings.groupBy("doc_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
        F.array_sort(F.collect_list(F.struct(rank(F.col("severity")).alias("r"), "line", "id", line.alias("text")))).alias("found"),
    )
    head = F.format_string("# Document %d\n\nhigh %d, medium %d, low %d\n\n| severity | line | rule | evidence |\n|---|---|---|---|\n", "doc_id", *SEVERITY_RANK)
    return rows.select("doc_id", F.concat(head, F.array_join(F.transform("found", lambda x: x["text"]), "\n"), F.lit("\n")).alias("report"))


#: What a report calls each verdict and each fix.
STATUS_LABELS = {"verified": "✅ verified", "fixable": "🔧 fixable", "suspect": "⚠️ suspect", "notfound": "❌ not found", "unverifiable": "❔ unverifiable", "error": "⚡ check failed", "skipped": "⏭ skipped", "checking": "⏳ checking"}
FIX_LABELS = {"remove-sentence": "remove sentence", "remove-match": "remove", "convert": "convert", "flag": "review manually"}
ACTION_LABELS = {"remove": "remove entry and its citations", "fix": "correct fields from the matched record", "keep": "keep"}
TITLE_SHOWN, VALUE_SHOWN = 80, 40


def label(c: Column, labels: dict[str, str]) -> Column:
    """What ``labels`` calls a value, else the value itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c], c)


def file_size(c: Column) -> Column:
    """Bytes as B, KB or MB."""
    return F.when(c > 1 << 20, F.format_string("%.1f MB", c / (1 << 20))).when(c > 1 << 10, F.format_string("%.1f KB", c / (1 << 10))).otherwise(F.format_string("%d B", c.cast("long")))


def _table(rows: DataFrame, order: list[Column], text: Column, name: str, *more: Column) -> DataFrame:
    """doc_id, name: the lines of a table, in order."""
    lines = F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{k}") for k, c in enumerate([*order, text])])))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x[f"o{len(order)}"]), "\n").alias(name), *more)


def combined(files: DataFrame, findings: DataFrame, verdicts: DataFrame, checks: DataFrame) -> DataFrame:
    """doc_id, report: Markdown with files, summary, findings and citations of every document in ``files``.

    ``files``: doc_id, name, kind, size.  ``findings``: those of scan().  ``verdicts``: doc_id, key, title, status, checked,
    corrections, note, action.  ``checks``: doc_id, key, state (missing or unused).  Each is brought together by document
    once, so that the joins meet one row a document.
    """
    blank = F.lit("")
    f = _table(files, [F.col("name")], F.format_string("- `%s` (%s, %s)", "name", "kind", file_size(F.col("size"))), "files")
    evidence = short(F.coalesce("context", "match", blank))
    found_line = F.format_string("| %s | %d | %s | %s | %s |", "severity", "line", "rule_id", cell(evidence), F.when(F.col("selected"), label(F.col("fix"), FIX_LABELS)).otherwise("review manually"))
    t = _table(findings, [rank(F.col("severity")), F.col("line"), F.col("id")], found_line, "found", F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK])
    change = F.transform("corrections", lambda c: F.concat(c["field"], F.lit(": "), short(F.coalesce(c["current"], blank), VALUE_SHOWN), F.lit(" → "), short(c["correct"], VALUE_SHOWN)))
    problem = F.when(F.size("corrections") > 0, F.array_join(change, "; ")).otherwise(F.coalesce("note", blank))
    cited = F.format_string("| %s | `%s` | %s | %s | %s | %s |", label(F.col("status"), STATUS_LABELS), cell(F.col("key")), cell(short(F.coalesce("title", blank), TITLE_SHOWN)), F.array_join("checked", ", "), cell(problem), label(F.col("action"), ACTION_LABELS))
    v = _table(verdicts, [F.col("key")], cited, "cited", F.count("*").alias("entries"), *[F.count_if(F.col("status") == s).alias(f"s_{s}") for s in STATUS_LABELS])
    k = checks.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("state") == "missing", F.concat(F.lit("`"), "key", F.lit("`"))))).alias("missing"), F.count_if(F.col("state") == "unused").alias("unused"))
    x = f.join(t, "doc_id", "left").join(v, "doc_id", "left").join(k, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    lines = [
        F.format_string("| text findings | %d (%d high, %d medium, %d low) |", n("n"), *[n(s) for s in SEVERITY_RANK]), F.format_string("| citations checked | %d |", n("entries")),
        *[F.when(F.col(f"s_{s}") > 0, F.format_string(f"| {text} | %d |", f"s_{s}")) for s, text in STATUS_LABELS.items()],
        F.when(F.size("missing") > 0, F.concat(F.lit("| cited but not defined | "), F.array_join("missing", ", "), F.lit(" |"))), F.when(F.col("unused") > 0, F.format_string("| defined but not cited | %d |", "unused")),
    ]
    section = lambda title, head, c: F.when(c.isNotNull(), F.concat(F.lit(f"\n## {title}\n\n{head}\n{'|---' * (head.count('|') - 1)}|\n"), c, F.lit("\n")))
    return x.select("doc_id", F.concat(
        F.lit("# Report\n\n## Files\n\n"), "files", F.lit("\n\n## Summary\n\n| check | result |\n|---|---|\n"), F.concat_ws("\n", *lines), F.lit("\n"),
        F.coalesce(section("Findings", "| severity | line | rule | evidence | action |", F.col("found")), F.lit("\n## Findings\n\nNone; that no rule matches does not prove who wrote a text.\n")),
        F.coalesce(section("Citations", "| status | key | title | checked against | problem | action |", F.col("cited")), blank), F.lit("\nEvery finding is a lead, not a verdict.\n"),
    ).alias("report"))
