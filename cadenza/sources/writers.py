"""Sinks: tables, catalogues, corpus text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def tables(frames: dict[str, DataFrame], root: str) -> None:
    """Rebuilds every table as Parquet below a folder."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def catalogue(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)


def corpus_text(df: DataFrame, artist: str, title: str, lyrics: str, path: str) -> None:
    df.select(F.concat(F.lit("# "), F.concat_ws(" - ", artist, title), F.lit("\n"), F.coalesce(F.col(lyrics), F.lit("")), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def songs(df: DataFrame, artist: str, title: str, lyrics: str, root: str, files: int = 64) -> None:
    """``<root>/json`` and ``<root>/text``: every song's row as JSON, and its text, under its name of artist and title.

    Both are at most ``files`` files in order of the names, however many songs there are; a name is found by its range.
    """
    named = df.withColumn("slug", F.concat_ws("-", T.slug(F.col(artist)), T.slug(F.col(title))))
    dealt = named.repartitionByRange(files, "slug").sortWithinPartitions("slug")
    dealt.write.mode("overwrite").json(f"{root}/json")
    text = F.concat(F.lit("# "), F.concat_ws(" - ", artist, title), F.lit("\n"), F.coalesce(F.col(lyrics), F.lit("")), F.lit("\n"))
    dealt.select("slug", text.alias("text")).write.mode("overwrite").parquet(f"{root}/text")


def liked(df: DataFrame) -> DataFrame:
    """Liked tracks with prompt and tags flat, by handle and title."""
    out = df.where("is_liked").select("id", "title", "handle", F.col("metadata.prompt").alias("prompt"), F.coalesce("metadata.tags", "display_tags").alias("tags"))
    return out.orderBy(F.lower(F.coalesce("handle", F.lit(""))), F.lower(F.coalesce("title", F.lit(""))))
