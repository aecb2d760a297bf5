"""Queries over bibliographies, reference lists and catalogues made from documents, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as X
from .operators import citation_fixes as fixes
from .operators import linkage, refs, report, scan, tex
from .sources import archives, fixtures

_SPACES = r"[ \t-\r]+"


def _words(spark, sf_dir):
    """doc_id, text and all words of documents; a null text is empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("w", F.split("text", _SPACES))


def _runs(n: int):
    """The words in runs of ``n``, the last one shorter."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / n).cast("int")), lambda i: F.slice("w", i * n + 1, n))


_LETTERS = ("0123456789", "ghijklmnop")


def _digest(salt: str, n: int):
    """``n`` words of eight letters, at most eight, made from the whole text."""
    letters = F.translate(F.sha2(F.concat(F.lit(salt), F.col("text")), 256), *_LETTERS)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(letters, i * 8 + 1, F.lit(8)))


def _works(spark, sf_dir):
    """doc_id, t, names: the words of a title and of authors' names that every sign of a text has a part in; copies share them."""
    return _words(spark, sf_dir).select("doc_id", "text", _digest("t", 8).alias("t"), _digest("a", 3).alias("names"))


def _part(a: int, n: int):
    return F.array_join(F.slice("t", a, n), " ")


def catalog(spark, sf_dir):
    """A record per document, with a title and authors made from its whole text."""
    k = F.col("doc_id")
    source = F.element_at(F.array(*map(F.lit, linkage.SOURCES)), (k % 4 + 1).cast("int"))
    return _works(spark, sf_dir).select(
        k.alias("record"), source.alias("source"), _part(1, 8).alias("title"), F.col("names").alias("authors"), (1990 + k % 35).cast("int").alias("year"), F.concat(F.lit("10.1000/"), k.cast("string")).alias("doi"),
        F.when(k % 5 == 0, F.format_string("2106.%05d", k % 100000)).alias("arxiv"), F.lit("").alias("venue"),
    )


def entries(spark, sf_dir):
    """An entry per record, by doc_id as it is or with a fault: year, authors, DOI, title, or all made up."""
    k, fault = F.col("doc_id"), F.col("doc_id") % 8
    year = 1990 + k % 35 + F.when(fault == 1, 1).when(fault == 2, 4).otherwise(0)
    title = F.when(fault.isin(5, 7), F.concat(F.lit("Unheard of "), F.md5(k.cast("string")))).when(fault == 6, F.concat(_part(1, 1), F.lit(" "), _part(3, 6))).otherwise(_part(1, 8))
    doi = F.when(fault == 4, F.concat(F.lit("10.1000/"), (k + 1).cast("string"))).when(fault == 5, F.concat(F.lit("10.9999/"), k.cast("string"))).when(k % 3 == 0, F.concat(F.lit("10.1000/"), k.cast("string")))
    return _works(spark, sf_dir).select(
        k.alias("id"), F.when(k % 7 == 0, "book").otherwise("article").alias("type"), title.alias("title"), F.when(fault == 3, "Nobody, Ann").otherwise(F.array_join("names", " and ")).alias("author"), year.cast("string").alias("year"), doi.alias("doi"),
        F.lit(None).cast("string").alias("arxiv"),
    )


def q_entry_verdict(spark, sf_dir):
    """Verdicts on entries, with the fields that should be corrected."""
    v = linkage.verify_entries(entries(spark, sf_dir), catalog(spark, sf_dir))
    dec = lambda c: F.round(c, 4).cast("decimal(10,4)").alias(c)
    return v.select("id", "status", dec("title_similarity"), dec("author_overlap"), F.array_join(F.transform("corrections", lambda c: F.concat(c["field"], F.when(c["soft"], "?").otherwise(""))), ",").alias("fields"), F.col("matched.source").alias("source"))


def q_verdict_summary(spark, sf_dir):
    """Entries per status and the action that follows."""
    v = linkage.default_decisions(linkage.verify_entries(entries(spark, sf_dir), catalog(spark, sf_dir)))
    return v.groupBy("status", "action").agg(F.count("*").alias("n"))


def q_id_links(spark, sf_dir):
    """Entries whose DOI a source has, and the title there."""
    recs = linkage._records(catalog(spark, sf_dir))
    found = linkage.by_id(recs, "doi").select(F.col("id").alias("doi"), F.explode("found").alias("source", "c"))
    return entries(spark, sf_dir).select("id", F.lower("doi").alias("doi")).join(found, "doi").select("id", "doi", "source", F.col("c.title").alias("title"))


_W_SQL = r"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL), v AS (SELECT doc_id, text, string_split_regex(text, '[ \t-\r]+') AS w FROM d) "
_ID_LINKS_SQL = _W_SQL + """, e AS (SELECT doc_id AS id, CASE doc_id % 8 WHEN 4 THEN '10.1000/' || (doc_id + 1) WHEN 5 THEN '10.9999/' || doc_id ELSE CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || doc_id END END AS doi FROM d),
t AS (SELECT doc_id, translate(sha256('t' || text), '0123456789', 'ghijklmnop') AS x FROM d)
SELECT e.id, e.doi, (['Semantic Scholar', 'CrossRef', 'OpenAlex', 'DBLP'])[t.doc_id % 4 + 1] AS source, array_to_string(list_transform(range(8), lambda i: x[i * 8 + 1:i * 8 + 8]), ' ') AS title FROM e JOIN t ON e.doi = '10.1000/' || t.doc_id"""


def _letters(c):
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z ]", ""), " +", " "))


_NAMES = ("Smith", "Jones", "Brown")
#: The list begins with these, so that a short text has enough of them too; numbers have three digits at most.
_FIRST = ["Open questions", "Known answers", "Further work"]


def _listed(docs, titles):
    """A text with a heading, numbered references over two lines each, and an appendix, per document."""
    one = lambda t, i: F.concat(F.lit("["), (i % 999 + 1).cast("string"), F.lit("] A. "), F.element_at(F.array(*map(F.lit, _NAMES)), i % 3 + 1), F.lit(".\n   On "), t, F.lit(". Journal of Things, "), (2001 + F.col("doc_id") % 20).cast("string"), F.lit(".\n"))
    items = F.array_join(F.transform(F.concat(F.array(*map(F.lit, _FIRST)), titles), one), "")
    return docs.select("doc_id", F.concat(F.lit("Text before.\nReferences\n"), items, F.lit("Appendix A\n[4] C. White. Not a reference of this list. 2003.\n")).alias("text"))


def q_references(spark, sf_dir):
    """References split from lists that hold all words of documents, fourteen to a title."""
    docs = _words(spark, sf_dir)
    return refs.references(_listed(docs, F.transform(_runs(14), lambda r: _letters(F.array_join(r, " "))))).select("doc_id", "index", "text")


_PLAIN_SQL = "trim(regexp_replace(regexp_replace({}, '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g'))"
#: Of references that begin with the same letters and digits, the first counts.
_REFS_SQL = _W_SQL + f""", r AS (SELECT doc_id, unnest(range((len(w) - 1) // 14 + 1)) AS i, w FROM v),
t AS (SELECT doc_id, i + {len(_FIRST)} AS k, {_PLAIN_SQL.format("array_to_string(w[i * 14 + 1:i * 14 + 14], ' ')")} AS t FROM r UNION ALL SELECT doc_id, unnest(range({len(_FIRST)})), unnest({_FIRST}) FROM d),
c AS (SELECT doc_id, k, 'A. ' || ({list(_NAMES)})[k % 3 + 1] || '. On ' || t || '. Journal of Things, ' || (2001 + doc_id % 20) || '.' AS text FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))[1:{refs.SAME_CHARS}] ORDER BY k) AS nth FROM c WHERE length(text) BETWEEN {refs.SHORTEST} AND {refs.LONGEST})
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k))::INT AS index, text FROM f WHERE nth = 1"""


def q_reference_verdict(spark, sf_dir):
    """Verdicts on references split from lists: a record's title, the same without a word, and a made-up one."""
    own = _works(spark, sf_dir).withColumn("u", F.array_join(_digest("u", 8), " "))
    lists = _listed(own, F.array(_part(1, 8), F.concat(_part(1, 1), F.lit(" "), _part(3, 6)), F.col("u")))
    r = refs.references(lists).select((F.col("doc_id") * 10 + F.col("index")).alias("id"), "text", "raw")
    v = linkage.verify_references(r, catalog(spark, sf_dir))
    return v.select("id", "status", F.round("score", 4).cast("decimal(10,4)").alias("score"), F.col("matched.source").alias("source"), "note")


def q_guess_title(spark, sf_dir):
    """Titles guessed in references."""
    return q_references(spark, sf_dir).select("doc_id", "index", refs.title_guess(F.col("text")).alias("title"))


def q_bibitems(spark, sf_dir):
    """Items of embedded bibliographies that hold all words of documents, five to a title; one item is commented out."""
    item = lambda t, i: F.concat(F.when(i == 1, "% \\bibitem{gone} out\n").otherwise(""), F.lit("\\bibitem["), (i + 1).cast("string"), F.lit("]{k"), (i + 1).cast("string"), F.lit("} \\newblock {\\em "), _letters(F.array_join(t, " ")), F.lit("}, 2004.\n"))
    src = F.concat(F.lit("\\begin{thebibliography}{9}\n"), F.array_join(F.transform(_runs(5), item), ""), F.lit("\\end{thebibliography}"))
    return refs.embedded(_words(spark, sf_dir).select("doc_id", src.alias("text"))).select("doc_id", "key", "label", "text", "line")


_ITEMS_SQL = _W_SQL + f""", r AS (SELECT doc_id, unnest(range((len(w) - 1) // 5 + 1)) AS i, w FROM v), t AS (SELECT doc_id, i, {_PLAIN_SQL.format("array_to_string(w[i * 5 + 1:i * 5 + 5], ' ')")} AS t FROM r)
SELECT doc_id, 'k' || (i + 1) AS key, (i + 1)::VARCHAR AS label, trim(regexp_replace(' ' || t || ' , 2004.', ' +', ' ', 'g')) AS text, (i + 2 + (i > 0)::INT)::INT AS line FROM t"""


def q_bib_resources(spark, sf_dir):
    """Bibliography files that sources name."""
    lines = F.concat(F.lit("% \\bibliography{old}\n\\bibliography{refs"), (F.col("doc_id") % 5).cast("string"), F.lit(",more.bib}\\addbibresource[x=1]{Own.BIB}"))
    return tex.bib_resources(_words(spark, sf_dir).select("doc_id", lines.alias("text"), F.lit("tex").alias("filetype")))


_RESOURCES_SQL = _W_SQL + "SELECT doc_id, unnest(['refs' || (doc_id % 5), 'more', 'Own']) AS resource FROM v"


def q_fixed_bib(spark, sf_dir):
    """Bibliographies with a year corrected, a DOI put in and an entry removed."""
    d = _words(spark, sf_dir)
    src = F.format_string("@article{a%d,\n    title = {T},\n    year = 1999\n}\n\n@misc{b, title = {Gone}}\n@misc{c, note = {left}}\n", F.col("doc_id"))
    fix = F.expr("array(named_struct('field', 'year', 'current', '1999', 'correct', cast(2000 + doc_id % 9 as string)), named_struct('field', 'doi', 'current', cast(null as string), 'correct', concat('10.1000/', doc_id)))")
    chosen = d.select("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("key"), F.lit("fix").alias("action"), F.lit(None).cast("string").alias("reason"), fix.alias("corrections"))
    gone = d.where("doc_id % 2 = 0").select("doc_id", F.lit("b").alias("key"), F.lit("remove").alias("action"), F.lit("not found").alias("reason"), F.lit(None).cast(chosen.schema["corrections"].dataType).alias("corrections"))
    out = fixes.fixed_bibliographies(d.select("doc_id", src.alias("src")), chosen.unionByName(gone))
    return out.select("doc_id", "fixed", F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c["line"].cast("string"), c["action"])), ",").alias("log"))


_FIXED_BIB_SQL = _W_SQL + """SELECT doc_id, '@article{a' || doc_id || ',' || chr(10) || '    doi = {10.1000/' || doc_id || '},' || chr(10) || '    title = {T},' || chr(10) || '    year = {' || (2000 + doc_id % 9) || '}' || chr(10) || '}' || chr(10) || chr(10)
 || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '@misc{b, title = {Gone}}' || chr(10) END || '@misc{c, note = {left}}' || chr(10) AS fixed,
 '1:corrected field,1:added field' || CASE WHEN doc_id % 2 = 0 THEN ',6:removed entry' ELSE '' END AS log FROM v"""


def q_fixed_cites(spark, sf_dir):
    """Sources without the citations of one key."""
    docs = fixtures.corpus(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("filetype = 'tex'")
    out = fixes.fixed_citations(docs, docs.select("doc_id", F.lit("smith2020").alias("key")))
    return out.select("doc_id", F.md5(F.col("fixed").cast("binary")).alias("fixed_md5"), F.size("changes").cast("long").alias("changes"))


_FIXED_CITES_SQL = f"WITH corpus AS ({fixtures.CORPUS_SQL}) " + r"""SELECT doc_id, md5(replace(replace(text, '\cite{smith2020, jones2021}', '\cite{jones2021}'), '\textcite{smith2020}', '')) AS fixed_md5,
 coalesce(contains(text, 'cite{smith2020')::BIGINT, 0) AS changes FROM corpus WHERE filetype = 'tex'"""

def q_changes(spark, sf_dir):
    """What mending the texts changes."""
    return scan.changes(fixtures.corpus(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def q_full_report(spark, sf_dir):
    """A report per document: its findings, the verdict on its entry, and citations that do not fit its bibliography."""
    docs = fixtures.corpus(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("doc_id is not null")
    files = docs.select("doc_id", F.concat("doc_id", F.lit("."), "filetype").alias("name"), F.col("filetype").alias("kind"), F.octet_length("text").cast("long").alias("size"))
    e = entries(spark, sf_dir)
    v = linkage.default_decisions(linkage.verify_entries(e, catalog(spark, sf_dir)).drop("title_similarity")).join(e.select("id", "title", F.concat(F.lit("k"), "id").alias("key")), "id").withColumn("doc_id", F.col("id"))
    checks = tex.used_keys(tex.citations(docs)).where("key <> 'smith2020'").withColumn("state", F.lit("missing"))
    return report.combined(files, scan.scan(docs), v, checks)


def q_archives(spark, sf_dir):
    """Archives of mended texts and their logs, by size."""
    docs = fixtures.corpus(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("doc_id is not null")
    texts = scan.fixed(docs).select("doc_id", F.lit("fixed.txt").alias("name"), F.col("fixed").alias("content"))
    return archives.archives(texts).select("doc_id", F.octet_length("archive").cast("long").alias("bytes"), F.crc32("archive").alias("crc32"))



def _named_works(spark, sf_dir, source):
    """A record per document whose title and authors are its own: words made of its doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").select("doc_id").distinct()
    letters = lambda salt: F.translate(F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string")).cast("binary")), *_LETTERS)
    x = docs.select("doc_id", letters("t").alias("t"), letters("a").alias("a"), letters("u").alias("u"))
    title = F.format_string("Study %s about %s with %s", F.substring("t", 1, 8), F.substring("t", 9, 8), F.substring("t", 17, 8))
    k = F.col("doc_id")
    return x.select("doc_id", k.alias("record"), source.alias("source"), title.alias("title"), F.array(F.concat(F.lit("Ann "), F.substring("a", 1, 7)), F.concat(F.lit("Bob "), F.substring("a", 8, 7))).alias("authors"), (1990 + k % 30).cast("int").alias("year"), F.concat(F.lit("10.1000/"), k.cast("string")).alias("doi"), F.lit(None).cast("string").alias("arxiv"), F.lit("").alias("venue"), F.format_string("Unheard %s matters %s", F.substring("u", 1, 9), F.substring("u", 10, 9)).alias("other"))


def q_verdict_cases(spark, sf_dir):
    """Verdicts and decisions on entries whose fault is known, by doc_id, against records with titles of their own."""
    k, case = F.col("doc_id"), F.col("doc_id") % 10
    works = _named_works(spark, sf_dir, F.element_at(F.array(*map(F.lit, linkage.SOURCES)), (k % 4 + 1).cast("int")))
    own_doi = F.when((k % 4 != 3) & case.isin(0, 1, 2), F.col("doi"))
    e = works.select(
        k.alias("id"), F.when(case.isin(6, 8), "book").otherwise("article").alias("type"), F.when(case.isin(4, 5, 6, 9), F.col("other")).when(case == 7, "").otherwise(F.col("title")).alias("title"),
        F.when(case.isin(3, 8), "Nobody, Ann and None, Bob").otherwise(F.array_join("authors", " and ")).alias("author"), (F.col("year") + F.when(case == 1, 1).when(case == 2, 4).otherwise(0)).cast("string").alias("year"),
        F.when(case == 9, F.concat(F.lit("10.9999/"), k.cast("string"))).otherwise(own_doi).alias("doi"), F.lit(None).cast("string").alias("arxiv"),
    )
    v = linkage.default_decisions(linkage.verify_entries(e, works))
    raw = F.array_join(F.transform("corrections", lambda c: F.concat_ws(":", c["field"], c["current"], c["correct"])), ",")
    return v.select("id", "status", "action", raw.alias("certain"), F.col("matched").isNull().alias("unmatched"), F.col("matched.source").alias("source"), F.col("matched.title").alias("title"))


_NAMED_SQL = """WITH d AS (SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id IS NOT NULL), w AS (SELECT k, translate(md5('t' || k), '0123456789', 'ghijklmnop') AS t, translate(md5('a' || k), '0123456789', 'ghijklmnop') AS a FROM d),
r AS (SELECT k, 'Study ' || t[1:8] || ' about ' || t[9:16] || ' with ' || t[17:24] AS title, 1990 + k % 30 AS year, (['Semantic Scholar', 'CrossRef', 'OpenAlex', 'DBLP'])[k % 4 + 1] AS source FROM w) """
#: A DOI that neither registry resolves (those of records in the first source) is to be corrected, even to itself.
_VERDICT_CASES_SQL = _NAMED_SQL + """, c AS (SELECT r.*, r.k % 10 AS fault, r.k % 4 = 0 AND r.k % 10 IN (0, 1, 2) AS dead, 'Ann ' || a[1:7] || ' and Bob ' || a[8:14] AS names FROM r JOIN w USING (k)),
s AS (SELECT *, CASE WHEN dead OR fault = 2 THEN 'fixable' WHEN fault IN (0, 1) THEN 'verified' WHEN fault IN (3, 9) THEN 'suspect' WHEN fault IN (6, 7, 8) THEN 'unverifiable' ELSE 'notfound' END AS status FROM c)
SELECT k AS id, status, CASE status WHEN 'notfound' THEN 'remove' WHEN 'fixable' THEN 'fix' ELSE 'keep' END AS action,
 concat_ws(',', CASE WHEN fault = 2 THEN 'year:' || (year + 4) || ':' || year WHEN fault = 3 THEN 'author:Nobody, Ann and None, Bob:' || names END, CASE WHEN dead THEN 'doi:10.1000/' || k || ':10.1000/' || k END) AS certain,
 fault > 3 AS unmatched, CASE WHEN fault <= 3 THEN source END AS source, CASE WHEN fault <= 3 THEN title END AS title FROM s"""


def q_reference_cases(spark, sf_dir):
    """Verdicts on free references whose fault is known, by doc_id: none, another year, a made-up work, hardly any text."""
    k, case = F.col("doc_id"), F.col("doc_id") % 4
    works = _named_works(spark, sf_dir, F.lit(linkage.S2))
    name = lambda i: F.substring(F.col("authors")[i], 5, 7)
    text = F.format_string("A. %s and B. %s. %s. Journal of Things, %d.", name(0), name(1), F.when(case == 2, F.col("other")).otherwise(F.col("title")), F.col("year") + F.when(case == 1, 3).otherwise(0))
    v = linkage.verify_references(works.select(k.alias("id"), F.when(case == 3, "Too short.").otherwise(text).alias("text"), F.lit(None).cast("string").alias("raw")), works)
    return v.select("id", "status", F.col("matched.title").alias("title"), "note")


_REFERENCE_CASES_SQL = _NAMED_SQL + """SELECT k AS id, (['verified', 'suspect', 'notfound', 'unverifiable'])[k % 4 + 1] AS status, CASE WHEN k % 4 < 2 THEN title END AS title, CASE k % 4 WHEN 0 THEN 'Semantic Scholar' WHEN 1 THEN 'the record is of ' || year ELSE '' END AS note FROM r"""


def q_author_names(spark, sf_dir):
    """Last names of author fields with braces, marks and ligatures."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    field = F.concat(F.lit("{Barnes and {No}ble} and Nguy\u1ec5n, A. and Ada "), F.format_string("a%dz", F.col("doc_id")), F.lit(" and Gri\ufb00in, Z and others"))
    return docs.select("doc_id", F.array_join(X.author_last_names(field), ",").alias("names"), X.normalize_title(F.lit("{\\em Na\u00efve} \ufb01elds of \u01ceB\u0107")).alias("title"))


_AUTHOR_NAMES_SQL = "SELECT doc_id, 'noble,nguyen,az,griffin' AS names, 'naive fields of abc' AS title FROM documents WHERE doc_id IS NOT NULL"

QUERIES = {f.__name__: f for f in (q_entry_verdict, q_verdict_summary, q_id_links, q_references, q_reference_verdict, q_guess_title, q_bibitems, q_bib_resources, q_fixed_bib, q_fixed_cites, q_changes, q_full_report, q_archives, q_verdict_cases, q_reference_cases, q_author_names)}
ORACLES = {"q_id_links": _ID_LINKS_SQL, "q_references": _REFS_SQL, "q_bibitems": _ITEMS_SQL, "q_bib_resources": _RESOURCES_SQL, "q_fixed_bib": _FIXED_BIB_SQL, "q_fixed_cites": _FIXED_CITES_SQL, "q_verdict_cases": _VERDICT_CASES_SQL, "q_reference_cases": _REFERENCE_CASES_SQL, "q_author_names": _AUTHOR_NAMES_SQL}
