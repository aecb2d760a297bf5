"""Answers of four catalogue services, as JSON, turned into rows that record linkage can use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the sources, and where their answers keep records.
S2, CROSSREF, OPENALEX, DBLP = "Semantic Scholar", "CrossRef", "OpenAlex", "DBLP"
PLACES = {S2: ("$.data",), CROSSREF: ("$.message.items", "$.message"), OPENALEX: ("$.results", "$"), DBLP: ("$.result.hits.hit",)}
SHAPES = {
    S2: "title string, authors array<struct<name:string>>, year int, venue string, publicationVenue struct<name:string>, externalIds struct<DOI:string,ArXiv:string>",
    CROSSREF: "title string, author array<struct<given:string,family:string>>, issued struct<`date-parts`:array<array<int>>>, published struct<`date-parts`:array<array<int>>>, DOI string, `container-title` array<string>, publisher string",
    OPENALEX: "title string, authorships array<struct<author:struct<display_name:string>>>, publication_year int, doi string, primary_location struct<source:struct<display_name:string>>",
    DBLP: "info struct<title:string,authors:struct<author:string>,year:string,doi:string,venue:string>",
}


def _items(c: Column) -> Column:
    """The members of a JSON array as texts; anything else is one member."""
    many = F.from_json(c, "array<string>")
    return F.when(c.startswith("[") & many.isNotNull(), many).when(c.isNotNull(), F.array(c))


def _filled(*options: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in options])


def _fields(source: str) -> dict[str, Column]:
    r = F.col("r")
    if source == S2:
        return {"title": r["title"], "authors": F.transform(r["authors"], lambda a: a["name"]), "year": r["year"], "doi": r["externalIds"]["DOI"], "arxiv": r["externalIds"]["ArXiv"], "venue": _filled(r["venue"], r["publicationVenue"]["name"])}
    if source == CROSSREF:
        year = lambda f: F.get(F.get(r[f]["date-parts"], F.lit(0)), F.lit(0))
        names = F.transform(r["author"], lambda a: F.concat_ws(" ", _filled(a["given"]), _filled(a["family"])))
        return {"title": F.get(_items(r["title"]), F.lit(0)), "authors": names, "year": F.coalesce(F.nullif(year("issued"), F.lit(0)), year("published")), "doi": r["DOI"], "venue": _filled(F.get(r["container-title"], F.lit(0)), r["publisher"])}
    if source == OPENALEX:
        names = F.filter(F.transform(r["authorships"], lambda a: a["author"]["display_name"]), lambda n: n != "")
        return {"title": r["title"], "authors": names, "year": r["publication_year"], "doi": F.regexp_replace(r["doi"], r"^https?://doi\.org/", ""), "venue": r["primary_location"]["source"]["display_name"]}
    info = r["info"]
    names = F.transform(_items(info["authors"]["author"]), lambda a: F.regexp_replace(F.coalesce(F.get_json_object(a, "$.text"), a), r"\s+[0-9]{4}$", ""))
    return {"title": F.regexp_replace(info["title"], r"\.$", ""), "authors": F.filter(names, lambda n: n != ""), "year": info["year"].try_cast("int"), "doi": info["doi"], "venue": info["venue"], "named": info["title"]}


def candidates(answers: DataFrame, source: str) -> DataFrame:
    """id, rank, source, title, authors, year, doi, arxiv, venue: the records of one source's ``answers`` (id, body).

    ``rank`` counts from 0 in the order of the answer.  Records without a title, and bodies that are null or no JSON,
    give no row; absent lists are empty, an absent venue is empty, a year of 0 and empty identifiers are null.
    """
    body = F.coalesce(*[F.get_json_object("body", p) for p in PLACES[source]])
    rows = answers.select("id", F.posexplode(_items(body)).alias("rank", "item")).select("id", "rank", F.from_json("item", SHAPES[source]).alias("r"))
    f = _fields(source)
    out = rows.where(_filled(f.pop("named", f["title"])).isNotNull())
    none = F.lit(None).cast("string")
    return out.select(
        "id", "rank", F.lit(source).alias("source"), f["title"].alias("title"), F.coalesce(f["authors"], F.array().cast("array<string>")).alias("authors"), F.nullif(f["year"], F.lit(0)).alias("year"),
        _filled(f["doi"]).alias("doi"), _filled(f.get("arxiv", none)).alias("arxiv"), F.coalesce(f["venue"], F.lit("")).alias("venue"),
    )
