"""Typed tables from gzip TSV dumps of a film catalogue.

All columns are read as strings without quoting, backslash-N is null, and
values that don't parse become null.  Only titles that pass the filters are
kept, and people and credits of these titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    # A gzip file is one task: deal its rows out before any work.
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "\\N").csv(path).repartition(spark.sparkContext.defaultParallelism)


def as_type(name: str, kind: str) -> Column:
    return F.expr(f"try_cast(`{name}` AS {kind})").alias(name)


def build(spark: SparkSession, raw: str, min_votes: int = 1000, kinds: tuple[str, ...] = ("movie",)) -> dict[str, DataFrame]:
    b = read_tsv(spark, f"{raw}/title.basics.tsv.gz", "tconst titleType primaryTitle originalTitle isAdult startYear endYear runtimeMinutes genres".split())
    r = read_tsv(spark, f"{raw}/title.ratings.tsv.gz", ["tconst", "averageRating", "numVotes"]).select("tconst", as_type("averageRating", "double"), as_type("numVotes", "bigint"))
    basics = b.select("tconst", "titleType", "primaryTitle", "originalTitle", as_type("isAdult", "boolean"), as_type("startYear", "int"), as_type("runtimeMinutes", "int"), "genres")
    keep = basics.where(F.col("titleType").isin(*kinds)).join(r.where(F.col("numVotes") >= min_votes), "tconst").select("tconst")
    crew = read_tsv(spark, f"{raw}/title.crew.tsv.gz", ["tconst", "directors", "writers"]).join(keep, "tconst", "left_semi")
    cast = read_tsv(spark, f"{raw}/title.principals.tsv.gz", ["tconst", "ordering", "nconst", "category", "job", "characters"]).join(keep, "tconst", "left_semi")
    cast = cast.select("tconst", "nconst", "category", as_type("ordering", "int"), "characters")
    people = crew.select(F.explode(F.split("directors", ",")).alias("nconst")).union(cast.select("nconst")).distinct()
    names = read_tsv(spark, f"{raw}/name.basics.tsv.gz", ["nconst", "primaryName", "birthYear", "deathYear", "primaryProfession", "knownForTitles"]).join(people, "nconst", "left_semi")
    names = names.select("nconst", "primaryName", as_type("birthYear", "int"), as_type("deathYear", "int"), "primaryProfession")
    return {"title_basics": basics.join(keep, "tconst", "left_semi"), "title_ratings": r.join(keep, "tconst", "left_semi"), "title_crew": crew, "title_principals": cast, "name_basics": names}


def write(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def triples(t: dict[str, DataFrame], min_votes: int = 1000, cast_cap: int = 10) -> DataFrame:
    """Genre, year, director, cast and character facts of well-known, non-adult films; one row per fact, least source."""
    from ..functions.text import json_names
    from ..operators.graph import dedupe

    films = t["title_basics"].where((F.col("titleType") == "movie") & ~F.coalesce("isAdult", F.lit(False))).join(t["title_ratings"].where(F.col("numVotes") >= min_votes).select("tconst"), "tconst")
    source = F.concat(F.lit("imdb:"), F.col("tconst")).alias("source")
    film = films.select("tconst", F.col("primaryTitle").alias("film"), "genres", "startYear")
    names = t["name_basics"].select("nconst", F.col("primaryName").alias("person"))
    row = lambda df, s, r, o: df.select(F.col(s).alias("subject"), F.lit(r).alias("relation"), F.col(o).cast("string").alias("object"), source)
    genres = film.select("tconst", "film", F.explode(F.transform(F.split("genres", ","), lambda g: F.trim(g))).alias("genre"))
    directors = t["title_crew"].select("tconst", F.explode(F.split("directors", ",")).alias("nconst")).join(film, "tconst").join(names, "nconst")
    cast = t["title_principals"].where(F.col("category").isin("actor", "actress") & (F.col("ordering") <= cast_cap)).join(film, "tconst").join(names, "nconst")
    roles = cast.select("tconst", "film", "person", F.explode(json_names(F.col("characters"))).alias("character"))
    out = row(genres, "film", "HAS_GENRE", "genre").union(row(film.where("startYear IS NOT NULL"), "film", "RELEASED_IN", "startYear")).union(row(directors, "film", "DIRECTED_BY", "person"))
    out = out.union(row(cast, "person", "ACTED_IN", "film")).union(row(roles, "film", "FEATURES_CHARACTER", "character")).union(row(roles, "character", "PLAYED_BY", "person"))
    return dedupe(out.where("object IS NOT NULL AND object <> '' AND object <> '\\\\N'"))
