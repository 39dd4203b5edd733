"""Collaborations, section attribution, loanwords, and selection and recovery of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus as C


def collabs(songs: DataFrame, category: str, featured: str, artist: Column | None = None, primary: str | None = None) -> DataFrame:
    """Songs with ``collab_type`` whose category names duo, trio or featured in any case, or with featured artists.

    With ``artist`` only songs whose primary artist it is or in the name of one of whose featured artists it stands, be
    its ASCII letters large or small.  A null list of featured artists is none; an empty one counts as given.
    """
    low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = F.lit(False)
    for w in ("duo", "trio", "featured"):
        named = named | F.coalesce(F.col(category).ilike(f"%{w}%"), F.lit(False))
    out = songs.where(named | F.col(featured).isNotNull()).withColumn("collab_type", T.collab_type(F.col(category), F.col(featured)))
    if artist is None:
        return out
    return out.where(F.coalesce((F.col(primary) == artist) if primary else F.lit(False), F.lit(False)) | F.coalesce(F.exists(featured, lambda x: F.contains(low(x), low(artist))), F.lit(False)))


def attribution(sections: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Sections with ``line_count`` and ``avg_syllables`` of their lines, 0 where a section has none."""
    mine = lines.groupBy(*key).agg(F.count("*").alias("line_count"), F.round(F.avg("syllable_count"), 2).alias("avg_syllables"))
    return sections.join(mine, key, "left").fillna(0, ["line_count", "avg_syllables"])


def loanwords(token_df: DataFrame, words: DataFrame, cohort: str, a: str, b: str) -> DataFrame:
    """Of each listed word (column ``word``) that occurs: frequency, counts in two cohorts, the larger one's name (tie
    if equal) and ``variants``, the words one edit away with their frequency, most frequent first."""
    counted = token_df.groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("frequency"), F.count_if(F.col(cohort) == a).alias("freq_a"), F.count_if(F.col(cohort) == b).alias("freq_b"))
    near = C.fuzzy_pairs(words.select("word"), counted.select(F.col("token").alias("variant"), F.col("frequency").alias("_n")), "word", "variant")
    variants = near.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("_o"), "variant"))), lambda s: F.struct(s["variant"].alias("variant"), (-s["_o"]).alias("frequency"))).alias("variants"))
    larger = F.when(F.col("freq_a") > F.col("freq_b"), a).when(F.col("freq_b") > F.col("freq_a"), b).otherwise("tie")
    return counted.join(words.select(F.col("word").alias("token")), "token").withColumn("cohort", larger).join(variants.withColumnRenamed("word", "token"), "token", "left")


def chosen_files(files: DataFrame, name: str, wanted: list[tuple[str, str]], fallback: int = 3) -> DataFrame:
    """style, file: for each (style, keyword) the first file by name that holds the keyword in any case; where no keyword
    has a file, the first ``fallback`` files as style ``unknown``."""
    found = files.agg(*(F.min(F.when(F.contains(F.lower(name), F.lit(k.lower())), F.col(name))).alias(f"_{i}") for i, (_, k) in enumerate(wanted)))  # one row
    each = found.select(F.explode(F.array(*(F.struct(F.lit(s).alias("style"), F.col(f"_{i}").alias("file")) for i, (s, _) in enumerate(wanted)))).alias("s")).select("s.style", "s.file").where("file is not null")
    first = files.select(F.lit("unknown").alias("style"), F.col(name).alias("file")).orderBy("file").limit(fallback)
    return each.unionAll(first.join(each.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti"))


def completeness(files: DataFrame, directory: str, path: str) -> DataFrame:
    """Per track directory: ``stems`` and ``is_complete``, which takes an analysis, a voice analysis, a recipe and two
    stems.  ``path`` is relative to the directory."""
    p = F.col(path)
    top = ~F.contains(p, F.lit("/"))
    has = lambda c: F.count_if(c) > 0
    stems = F.count_if(p.rlike(r"^stems/[^/]+\.wav$"))
    done = has(top & F.endswith(p, F.lit("_analysis.json"))) & has(top & F.endswith(p, F.lit("_voice_analysis.json"))) & has(p == "recipe.md") & (stems >= 2)
    return files.groupBy(directory).agg(stems.alias("stems"), done.alias("is_complete"))


def recovered(tracks: DataFrame, sources: DataFrame, status: DataFrame, slug: str, source: str) -> DataFrame:
    """Tracks with the first source of their slug and an ``outcome``: no match, known (already completed), incomplete or
    recovered."""
    first = sources.groupBy(slug).agg(F.min(source).alias(source))
    known = status.where("status = 'completed'").select(source).distinct().withColumn("_known", F.lit(True))
    out = tracks.join(first, slug, "left").join(known, source, "left")
    return out.withColumn("outcome", F.when(F.col(source).isNull(), "no match").when(F.col("_known"), "known").when(~F.col("is_complete"), "incomplete").otherwise("recovered")).drop("_known")
