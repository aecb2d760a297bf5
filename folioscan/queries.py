"""The queries of the document audit, and the same in DuckDB's SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions.regex_compat import anchors, to_java, to_re2
from .operators import bib, pdf, report, tex
from .operators import scan as S
from .operators.rules import RULES
from .sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_DUCK = f"WITH corpus AS ({fixtures.CORPUS_SQL}) "
#: RE2 has no lookahead: where a rule ends in this one, the SQL takes off the matches that the sign follows.
_NO_HYPHEN = "(?!-)"


def q_rule_hits(spark, sf_dir):
    """Documents and matches per rule: one projection with a count per rule, summed before anything is shuffled.

    A rule's pattern runs on the texts that hold one of its anchors only.
    """
    docs = corpus(spark, sf_dir).withColumn("low", F.lower("text"))

    def count(r):
        c, need = F.regexp_count("text", F.lit(to_java(r.pattern, r.flags))), anchors(r.pattern, r.flags)
        gates = [F.col("filetype") == "tex"] if r.tex_only else []
        if need:
            gates.append(functools.reduce(lambda x, y: x | y, [F.contains(F.col("low" if "i" in r.flags else "text"), F.lit(a)) for a in need]))
        return F.when(functools.reduce(lambda x, y: x & y, gates), c).otherwise(0) if gates else c

    counts = [count(r).alias(f"r{k}") for k, r in enumerate(RULES)]
    sums = docs.select(*counts).agg(*[f(F.col(f"r{k}")).cast("long").alias(f"{n}{k}") for k in range(len(RULES)) for n, f in (("h", F.sum), ("d", lambda c: F.sum((c > 0).cast("int"))))])
    rows = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.col(f"d{k}").alias("docs"), F.col(f"h{k}").alias("hits")) for k, r in enumerate(RULES)])
    return sums.select(F.inline(rows))


def _rule_hits_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    found = lambda p, r: f"len(regexp_extract_all(text, {q(to_re2(p, r.flags))}))"
    hits = lambda r: found(r.pattern, r) if not r.pattern.endswith(_NO_HYPHEN) else found(p := r.pattern.removesuffix(_NO_HYPHEN), r) + " - " + found(p + "-", r)
    one = lambda r: f"SELECT {q(r.id)} AS rule_id, CASE WHEN {'filetype = ' + q('tex') if r.tex_only else 'true'} THEN {hits(r)} ELSE 0 END AS n FROM corpus"
    return _DUCK + "SELECT rule_id, count(*) FILTER (n > 0)::BIGINT AS docs, sum(n)::BIGINT AS hits FROM (" + " UNION ALL ".join(one(r) for r in RULES) + ") GROUP BY rule_id"


def q_findings(spark, sf_dir):
    """Every finding, judged by its guards."""
    return S.scan(corpus(spark, sf_dir))


def q_rule_severity(spark, sf_dir):
    """Findings and selected findings per rule and severity."""
    return q_findings(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.sum(F.col("selected").cast("long")).alias("selected"))


def q_fixed(spark, sf_dir):
    """Mended texts by their hash and length."""
    return S.fixed(corpus(spark, sf_dir)).select("doc_id", F.md5(F.col("fixed").cast("binary")).alias("fixed_md5"), F.length("fixed").cast("long").alias("fixed_chars"))


def q_metrics(spark, sf_dir):
    """Counts behind the densities, and which densities are high."""
    docs = corpus(spark, sf_dir)
    sentences = F.filter(F.transform(F.split("text", to_java(r"[.!?]\s+", ""), -1), lambda s: F.regexp_replace(s, to_java(r"^\s+|\s+$", ""), "")), lambda s: F.length(s) > S.SENTENCE_CHARS)
    opener = to_java("^(?:" + "|".join(S.R.TRANSITIONS) + ")", "i") + "(?![A-Za-z0-9_])"
    dashes = F.regexp_count("text", F.lit("\u2014")) + F.when(F.col("filetype") == "tex", F.regexp_count("text", F.lit("(?<!-)---(?!-)"))).otherwise(0)
    x = docs.select("doc_id", F.regexp_count("text", F.lit(to_java(r"[^\s]+", ""))).alias("words"), dashes.alias("em_dashes"), F.regexp_count("text", F.lit(";")).alias("semicolons"), sentences.alias("s"))
    x = x.select("doc_id", "words", "em_dashes", "semicolons", F.size("s").alias("sentences"), F.size(F.filter("s", lambda s: s.rlike(opener))).alias("transitions"))
    long = F.col("words") > S.MANY_WORDS
    return x.select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("words", "em_dashes", "semicolons", "sentences", "transitions")],
        (long & (F.col("em_dashes") * 1000 > S.EM_DASHES * F.col("words"))).alias("many_em_dashes"),
        (long & (F.col("semicolons") >= S.FEWEST_SEMICOLONS) & (F.col("semicolons") * 1000 > S.SEMICOLONS * F.col("words"))).alias("many_semicolons"),
        ((F.col("sentences") >= S.FEWEST_SENTENCES) & (F.col("transitions") >= S.FEWEST_TRANSITIONS) & (F.col("transitions") * 100 > 18 * F.col("sentences"))).alias("many_transitions"),
    )


_OPENERS = to_re2("|".join(S.R.TRANSITIONS), "")
_BLANK, _NOT_BLANK = to_re2(r"[\s]", ""), to_re2(r"[^\s]", "")
_METRICS_SQL = _DUCK + rf""", s AS (SELECT doc_id, filetype, text, list_filter(list_transform(string_split_regex(text, '[.!?]{_BLANK}+'), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: length(x) > 20) AS s FROM corpus),
m AS (SELECT doc_id, len(regexp_extract_all(text, '{_NOT_BLANK}+'))::BIGINT AS words,
 (length(text) - length(replace(text, '—', '')) + CASE WHEN filetype = 'tex' THEN len(list_filter(regexp_extract_all(text, '-+'), lambda x: length(x) = 3)) ELSE 0 END)::BIGINT AS em_dashes,
 (length(text) - length(replace(text, ';', '')))::BIGINT AS semicolons, len(s)::BIGINT AS sentences, len(list_filter(s, lambda x: regexp_matches(x, '(?i)^(?:{_OPENERS})\b')))::BIGINT AS transitions FROM s)
SELECT *, words > 200 AND em_dashes * 1000 > 6 * words AS many_em_dashes, words > 200 AND semicolons >= 8 AND semicolons * 1000 > 20 * words AS many_semicolons,
 sentences >= 8 AND transitions >= 3 AND transitions * 100 > 18 * sentences AS many_transitions FROM m"""


def q_cites(spark, sf_dir):
    """Keys cited per document."""
    return tex.used_keys(tex.citations(corpus(spark, sf_dir)))


def _defined(spark):
    return spark.sql("SELECT * FROM VALUES ('smith2020'), ('lee2019'), ('other1999') AS d(key)")


def q_cross_check(spark, sf_dir):
    """Keys cited but not defined, and defined but not cited."""
    return tex.cross_check(q_cites(spark, sf_dir), _defined(spark))


_CITES_SQL = _DUCK + r""", lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM corpus WHERE filetype = 'tex'),
live AS (SELECT doc_id, regexp_extract(l, '^((?:[^%\\]|\\.)*)', 1) AS l FROM lines),
cites AS (SELECT doc_id, unnest(regexp_extract_all(l, '(?i)\\(?:CMDS)s?\*?(?:\s*\[[^\]]*\]){0,2}\s*\{([^{}]*)\}', 1)) AS k FROM live),
used AS (SELECT DISTINCT doc_id, trim(k) AS key FROM (SELECT doc_id, unnest(string_split(k, ',')) AS k FROM cites) WHERE trim(k) NOT IN ('', '*')) """.replace("CMDS", "|".join(tex.CITE_COMMANDS))
_CHECK_SQL = _CITES_SQL + """, d(key) AS (VALUES ('smith2020'), ('lee2019'), ('other1999'))
SELECT key, 'missing' AS state FROM (SELECT key FROM used EXCEPT SELECT key FROM d) UNION ALL SELECT key, 'unused' AS state FROM (SELECT key FROM d EXCEPT SELECT key FROM used)"""


def _titles(spark, sf_dir):
    """Two titles and author fields per run of fourteen words of a document, the second with changes that hang on doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    words = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+").alias("w"))
    runs = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 14).cast("int"))).alias("run"))
    runs = runs.select("doc_id", "run", F.slice("w", F.col("run") * 14 + 1, 14).alias("w"))
    some = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    names = lambda a: F.array_join(F.transform(F.slice("w", a, 3), lambda x: F.concat(F.lit("N"), F.regexp_replace(x, "[{}]", ""))), " and ")
    change = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{\\em "), some(1, 8), F.lit("}"))).when(F.col("doc_id") % 3 == 1, some(2, 8)).otherwise(some(1, 6))
    return runs.select("doc_id", "run", some(1, 8).alias("a"), change.alias("b"), names(9).alias("names"), names(10).alias("others"))


def q_title_similarity(spark, sf_dir):
    """Normalised titles and their similarity, and the overlap of last names."""
    t = _titles(spark, sf_dir).select("doc_id", "run", X.normalize_title(F.col("a")).alias("a"), X.normalize_title(F.col("b")).alias("b"), X.author_last_names(F.col("names")).alias("n"), X.author_last_names(F.col("others")).alias("m"))
    return t.select("doc_id", "run", "a", "b", F.round(X.title_similarity(F.col("a"), F.col("b")), 4).cast("decimal(10,4)").alias("similarity"), F.round(X.author_overlap(F.col("n"), F.col("m")), 4).cast("decimal(10,4)").alias("overlap"))


def _plain_sql(c: str) -> str:
    return f"strip_accents(lower({c}))"


_TITLE_SQL = rf"""WITH v AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[ \t-\r]+') AS w FROM documents WHERE doc_id IS NOT NULL), r AS (SELECT doc_id, unnest(range((len(w) - 1) // 14 + 1)) AS i, w FROM v),
w AS (SELECT doc_id, i::INT AS run, w[i * 14 + 1:i * 14 + 14] AS w FROM r),
t AS (SELECT doc_id, run, array_to_string(w[1:8], ' ') AS a, CASE doc_id % 3 WHEN 0 THEN '{{\em ' || array_to_string(w[1:8], ' ') || '}}' WHEN 1 THEN array_to_string(w[2:9], ' ') ELSE array_to_string(w[1:6], ' ') END AS b,
 list_transform(w[9:11], lambda x: 'N' || regexp_replace(x, '[{{}}]', '', 'g')) AS n, list_transform(w[10:12], lambda x: 'N' || regexp_replace(x, '[{{}}]', '', 'g')) AS m FROM w),
u AS (SELECT doc_id, run, {{norm_a}} AS a, {{norm_b}} AS b, {{last_n}} AS n, {{last_m}} AS m FROM t)
SELECT doc_id, run, a, b, CAST(round(CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 ELSE greatest(1 - levenshtein(a, b) / greatest(length(a), length(b)),
 len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))) END, 4) AS DECIMAL(10,4)) AS similarity,
 CAST(round(CASE WHEN len(n) = 0 THEN 1 WHEN len(m) = 0 THEN 0 ELSE len(list_filter(n, lambda x: list_contains(m, x))) / len(n) END, 4) AS DECIMAL(10,4)) AS overlap FROM u"""
_norm = lambda c: "trim(regexp_replace(" + _plain_sql(f"regexp_replace(regexp_replace({c}, '\\\\[a-zA-Z]+\\s*', ' ', 'g'), '[{{}}$\\\\]', '', 'g')") + ", '[^a-z0-9]+', ' ', 'g'))"
_last = lambda c: f"list_filter(list_transform({c}, lambda x: regexp_replace({_plain_sql('trim(CASE WHEN contains(x, chr(44)) THEN split_part(x, chr(44), 1) ELSE x END)')}, '[^a-z-]', '', 'g')), lambda x: x <> '')"
_TITLE_SQL = _TITLE_SQL.replace("{norm_a}", _norm("a").replace("{{}}", "{}")).replace("{norm_b}", _norm("b").replace("{{}}", "{}")).replace("{last_n}", _last("n")).replace("{last_m}", _last("m"))


def q_identifiers(spark, sf_dir):
    """DOIs and arXiv ids in the texts."""
    raw = F.regexp_extract("text", r"(?:doi:|doi\.org/)[^ \t-\r]+", 0)
    return corpus(spark, sf_dir).select("doc_id", X.clean_doi(raw).alias("doi"), X.arxiv_id(F.col("text")).alias("arxiv")).where("doi is not null or arxiv is not null")


_IDS_SQL = _DUCK + r""", r AS (SELECT doc_id, regexp_extract(text, '(?:doi:|doi\.org/)[^ \t-\r]+') AS raw, regexp_extract(text, '(?i)(?:arxiv[:\s/]*|abs/)([0-9]{4}\.[0-9]{4,5})', 1) AS arxiv FROM corpus),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(raw, '(?i)^(?:https?://)?(?:dx\.)?doi\.org/', ''), '(?i)^doi:\s*', ''), '[.,;)\]}]+$', '') AS d, arxiv FROM r)
SELECT doc_id, CASE WHEN regexp_matches(d, '^10\.[0-9]{4,9}/\S+$') THEN d END AS doi, nullif(arxiv, '') AS arxiv FROM c WHERE regexp_matches(d, '^10\.[0-9]{4,9}/\S+$') OR arxiv <> ''"""


def q_report_summary(spark, sf_dir):
    """Findings per severity, per category, and in all."""
    f = q_findings(spark, sf_dir)
    return f.groupingSets([[F.col("severity")], [F.col("category")], []], F.col("severity"), F.col("category")).agg(F.count("*").alias("n"), F.sum(F.col("selected").cast("long")).alias("selected"))


def q_report_markdown(spark, sf_dir):
    """A Markdown report per document that has findings."""
    return report.markdown(q_findings(spark, sf_dir))


def q_crc32(spark, sf_dir):
    """Checksums of the texts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc32"))


def _bib_sources(spark, sf_dir):
    """A BibTeX source of one or two entries per document, with the letters of its whole text as a title."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    title = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")
    one = F.format_string('@Article{k%d,\n  title = {The {X} %s},\n  author = "Lee, A. and Kim, B.", year = %d,\n  doi = {https://doi.org/10.1000/%d}, month = mar # " 3"\n}\n', F.col("doc_id"), title, 1990 + F.col("doc_id") % 35, F.col("doc_id"))
    two = F.when(F.col("doc_id") % 3 == 0, F.format_string("@misc(k%d, title = {Again}, eprint = {2106.%05d})\n", F.col("doc_id"), F.col("doc_id") % 100000)).otherwise("% @misc{gone, title = {x}}\n")
    return docs.select("doc_id", F.concat(one, two).alias("src"))


def q_bib_entries(spark, sf_dir):
    """Parsed entries with what follows from their fields."""
    e = bib.entries(_bib_sources(spark, sf_dir))
    return e.select("doc_id", "type", "key", "line", F.trim(F.regexp_replace("title", " +", " ")).alias("title"), "year", "doi", "arxiv", F.coalesce(F.col("fields")["month"]["value"], F.lit("")).alias("month"))


_BIB_SQL = """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g') AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, 'article' AS type, 'k' || doc_id AS key, 1::INT AS line, trim(regexp_replace('The X ' || t, ' +', ' ', 'g')) AS title, (1990 + doc_id % 35)::VARCHAR AS year, '10.1000/' || doc_id AS doi, NULL::VARCHAR AS arxiv, 'March 3' AS month FROM d
UNION ALL SELECT doc_id, 'misc', 'k' || doc_id, 6::INT, 'Again', NULL, NULL, '2106.' || lpad((doc_id % 100000)::VARCHAR, 5, '0'), '' FROM d WHERE doc_id % 3 = 0"""


def q_duplicate_keys(spark, sf_dir):
    """Keys that a source defines more than once."""
    return bib.entries(_bib_sources(spark, sf_dir)).groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")


def q_pdf_lines(spark, sf_dir):
    """Pages put together from all words of documents, laid out in lines of seven, three to a page."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    words = docs.select("doc_id", F.posexplode(F.split("text", r"[ \t-\r]+")).alias("seq", "str"))
    k = F.col("seq") % 21
    items = words.select("doc_id", F.floor(F.col("seq") / 21 + 1).alias("page"), "seq", "str", ((k % 7) * 10.0 + (F.col("seq") % 2)).alias("x"), (F.floor(k / 7) * 12.0).alias("y"), F.lit(9.5).alias("width"))
    return pdf.page_texts(items)


_PDF_SQL = r"""WITH w AS (SELECT doc_id, string_split_regex(text, '[ \t-\r]+') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT doc_id, unnest(w) AS str, unnest(range(len(w))) AS seq FROM w),
p AS (SELECT doc_id, seq // 21 + 1 AS page, seq, str, (seq % 21) % 7 * 10.0 + seq % 2 AS x, ((seq % 21) // 7) * 12.0 AS y FROM i WHERE seq < 300 * 21),
g AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py, lag(str) OVER v AS ps FROM p WINDOW v AS (PARTITION BY doc_id, page ORDER BY seq))
SELECT doc_id, page, string_agg(CASE WHEN ps IS NULL THEN '' WHEN abs(y - py) >= 2 THEN chr(10) WHEN ps <> '' AND x - (px + 9.5) > 1 THEN ' ' ELSE '' END || str, '' ORDER BY seq) AS text FROM g GROUP BY doc_id, page"""


def _guarded(spark, sf_dir):
    return fixtures.guarded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def q_guard_findings(spark, sf_dir):
    """Every column of the findings in the openings of documents, whose guards, sentences and places are all different."""
    docs = _guarded(spark, sf_dir)
    found = S.scan(docs).join(docs.select("doc_id", F.length("opening").alias("n")), "doc_id").where("end > start and end <= n")
    return found.select("doc_id", *[x.split(" ")[0] for x in S.FINDING.split(", ") if not x.startswith("id ")])


_GUARD_FINDINGS_SQL = fixtures.GUARDED_SQL + """, p AS (SELECT g.doc_id, e.*, g.opening, strpos(g.opening, e.match) - 1 + e.skip AS start, strpos(g.opening, e.sentence) - 1 AS ss FROM g JOIN e USING (k))
SELECT doc_id, rule_id, category, severity, fix, converted, match, start::INT AS start, (start + length(match) - skip)::INT AS "end", ss::INT AS sentence_start, (ss + length(sentence))::INT AS sentence_end,
 (1 + length(opening[:start]) - length(replace(opening[:start], chr(10), '')))::INT AS line, sentence AS context, review_reason IS NOT NULL AS quoted, review_reason, in_comment, selected FROM p"""


def q_guard_severity(spark, sf_dir):
    """Findings in the openings per rule, severity and category, and how many are selected."""
    f = q_guard_findings(spark, sf_dir)
    return f.groupBy("rule_id", "severity", "category").agg(F.count("*").alias("n"), F.count_if("selected").alias("selected"))


_GUARD_SEVERITY_SQL = fixtures.GUARDED_SQL + "SELECT rule_id, severity, category, count(*) AS n, count(*) FILTER (selected) AS selected FROM g JOIN e USING (k) GROUP BY ALL"


def q_guard_fixes(spark, sf_dir):
    """Whole mended texts by hash and length."""
    return S.fixed(_guarded(spark, sf_dir)).select("doc_id", F.md5(F.col("fixed").cast("binary")).alias("fixed_md5"), F.length("fixed").cast("long").alias("fixed_chars"))


_GUARD_FIXES_SQL = fixtures.GUARDED_SQL + r""", m AS (SELECT doc_id, mended || chr(10) || chr(10) || CASE WHEN filetype = 'tex' THEN regexp_replace(text, '\*\*([^*\n]{1,120})\*\*', '\\textbf{\1}', 'g') ELSE text END AS t FROM g),
f AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+\n', chr(10), 'g') AS t FROM m) SELECT doc_id, md5(t) AS fixed_md5, length(t)::BIGINT AS fixed_chars FROM f"""


def q_guard_changes(spark, sf_dir):
    """The log of what mending changes in the openings."""
    docs = _guarded(spark, sf_dir)
    last = F.regexp_count("opening", F.lit("\n")) + 1
    return S.changes(docs).join(docs.select("doc_id", last.alias("last")), "doc_id").where("line <= last").drop("last")


_GUARD_CHANGES_SQL = fixtures.GUARDED_SQL + """SELECT doc_id, (1 + length(opening[:strpos(opening, match) - 1]) - length(replace(opening[:strpos(opening, match) - 1], chr(10), '')))::INT AS line,
 split_part(log, '|', 1) AS action, split_part(log, '|', 2) AS detail FROM g JOIN e USING (k) WHERE log IS NOT NULL"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (q_rule_hits, q_findings, q_rule_severity, q_fixed, q_metrics, q_cites, q_cross_check, q_title_similarity, q_identifiers, q_report_summary, q_report_markdown, q_crc32, q_bib_entries, q_duplicate_keys, q_pdf_lines, q_guard_findings, q_guard_severity, q_guard_fixes, q_guard_changes)}
ORACLES: dict[str, str] = {"q_rule_hits": _rule_hits_sql(), "q_metrics": _METRICS_SQL, "q_cites": _CITES_SQL + "SELECT doc_id, key FROM used", "q_cross_check": _CHECK_SQL, "q_title_similarity": _TITLE_SQL, "q_identifiers": _IDS_SQL, "q_bib_entries": _BIB_SQL, "q_duplicate_keys": "SELECT doc_id, 'k' || doc_id AS key, 2::BIGINT AS n FROM documents WHERE doc_id % 3 = 0", "q_pdf_lines": _PDF_SQL, "q_guard_findings": _GUARD_FINDINGS_SQL, "q_guard_severity": _GUARD_SEVERITY_SQL, "q_guard_fixes": _GUARD_FIXES_SQL, "q_guard_changes": _GUARD_CHANGES_SQL}
