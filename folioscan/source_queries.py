"""Queries over sources: answers of catalogue services, places of citations, warnings of bibliographies; and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import queries as base
from .functions import text as X
from .operators import bib, tex
from .sources import payloads as P


def _answers(spark, sf_dir) -> dict[str, DataFrame]:
    """Per source the answers (id, body) in its own shape, with the whole text of a document as title."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null and text <> ''")
    n, t, year = F.col("doc_id"), F.col("text"), (2000 + F.col("doc_id") % 20)
    s = lambda **k: F.struct(*[v.alias(x) for x, v in k.items()])
    lit, arr, doi = F.lit, F.array, F.concat(F.lit("10.1000/"), F.col("doc_id").cast("string"))
    dates = F.struct(arr(arr(year)).alias("date-parts"))
    bodies = {
        P.S2: s(data=arr(s(title=t, authors=arr(s(name=lit("Ann Lee")), s(name=lit("Bo Kim"))), year=year, venue=lit(""), publicationVenue=s(name=lit("V one")), externalIds=s(DOI=doi)))),
        P.CROSSREF: s(message=s(items=arr(F.struct(arr(t).alias("title"), arr(s(given=lit("Ann"), family=lit("Lee")), s(given=lit(""), family=lit("Kim"))).alias("author"), dates.alias("issued"), doi.alias("DOI"), arr(lit("V two")).alias("container-title"))))),
        P.OPENALEX: s(results=arr(s(title=t, authorships=arr(s(author=s(display_name=lit("Ann Lee")))), publication_year=year, doi=F.concat(lit("https://doi.org/"), doi), primary_location=s(source=s(display_name=lit("V three")))))),
        P.DBLP: s(result=s(hits=s(hit=arr(s(info=s(title=F.concat(t, lit(".")), authors=s(author=arr(s(text=lit("Ann Lee 0001")), s(text=lit("Bo Kim")))), year=year.cast("string"), doi=doi, venue=lit("V four"))))))),
    }
    return {source: d.where(n % 4 == k).select(n.alias("id"), F.to_json(b).alias("body")) for k, (source, b) in enumerate(bodies.items())}


def q_candidates(spark, sf_dir):
    """Candidates from the answers of the four sources."""
    found = functools.reduce(DataFrame.unionByName, [P.candidates(a, source) for source, a in _answers(spark, sf_dir).items()])
    return found.select(F.col("id").alias("doc_id"), "rank", "source", F.md5(F.col("title").cast("binary")).alias("title_md5"), F.array_join("authors", "|").alias("authors"), "year", "doi", "arxiv", "venue")


_CANDIDATES_SQL = """SELECT doc_id, 0::INT AS rank, (['Semantic Scholar', 'CrossRef', 'OpenAlex', 'DBLP'])[doc_id % 4 + 1] AS source, md5(text) AS title_md5, (['Ann Lee|Bo Kim', 'Ann Lee|Kim', 'Ann Lee', 'Ann Lee|Bo Kim'])[doc_id % 4 + 1] AS authors,
 (2000 + doc_id % 20)::INT AS year, '10.1000/' || doc_id AS doi, NULL::VARCHAR AS arxiv, (['V one', 'V two', 'V three', 'V four'])[doc_id % 4 + 1] AS venue FROM documents WHERE doc_id IS NOT NULL AND text <> ''"""


def q_citation_spans(spark, sf_dir):
    """Places and parts of the citations behind whole texts that have no signs of LaTeX."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\\%]", " ")
    tail = F.format_string("\n\\Citet*{k%d, x} and\n%% \\cite{no} \\cite{none}\n\\parencites[see][p. 3]{z,} \\%% \\cite {w}", F.col("doc_id"))
    found = tex.citation_spans(docs.select("doc_id", F.concat(plain, tail).alias("text"), F.lit("tex").alias("filetype")))
    return found.withColumn("keys", F.array_join("keys", "|"))


_SPANS_SQL = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\%]', ' ', 'g') AS p FROM documents WHERE doc_id IS NOT NULL),
u AS (SELECT doc_id, length(p) + 1 AS n, 2 + length(p) - length(replace(p, chr(10), '')) AS l, length(doc_id::VARCHAR) AS k FROM t)
SELECT doc_id, 'Citet' AS command, true AS star, '' AS options, 'k' || doc_id || '|x' AS keys, n::INT AS start, (n + 13 + k)::INT AS "end", (n + 8)::INT AS keys_start, l::INT AS line FROM u
UNION ALL SELECT doc_id, 'parencites', false, '[see][p. 3]', 'z', (n + k + 42)::INT, (n + k + 68)::INT, (n + k + 65)::INT, (l + 2)::INT FROM u
UNION ALL SELECT doc_id, 'cite', false, '', 'w', (n + k + 72)::INT, (n + k + 81)::INT, (n + k + 79)::INT, (l + 2)::INT FROM u"""


def q_bib_warnings(spark, sf_dir):
    """What is wrong in the BibTeX sources of documents."""
    return bib.warnings(base._bib_sources(spark, sf_dir))


_WARNINGS_SQL = "SELECT doc_id, 6::INT AS line, 'key \"k' || doc_id || '\" was defined on line 1' AS message FROM documents WHERE doc_id % 3 = 0"


def q_search_words(spark, sf_dir):
    """What a search that must match every word asks for: the first words of whole normalised texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    return docs.select("doc_id", X.search_words(F.col("text")).alias("words"))


_WORDS_SQL = "SELECT doc_id, array_to_string(list_filter(string_split(" + base._norm("coalesce(text, '')").replace("{{}}", "{}") + ", ' '), lambda w: length(w) > 1)[1:8], ' ') AS words FROM documents WHERE doc_id IS NOT NULL"

QUERIES = {f.__name__: f for f in (q_candidates, q_citation_spans, q_bib_warnings, q_search_words)}
ORACLES = {"q_candidates": _CANDIDATES_SQL, "q_citation_spans": _SPANS_SQL, "q_bib_warnings": _WARNINGS_SQL, "q_search_words": _WORDS_SQL}
