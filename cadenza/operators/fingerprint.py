"""Fingerprints of artists and cohorts: rhyme craft, structure, lexicon, content, and the sentence they make.

``songs`` has a row a song with its artist and cohort; every measure is taken at both grains by grouping sets, so a
table is read once for both.  A cohort's own rows have no artist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corpus as C

# Word classes that say little, and the kinds of entities.
FUNCTION = ("PRON", "DET", "ADP", "CCONJ", "SCONJ", "AUX", "PART", "PUNCT", "SYM")
ENTITIES = ("PER", "LOC", "ORG")


def _grains(df: DataFrame, cohort: str, artist: str):
    return df.groupingSets([[cohort, artist], [cohort]], cohort, artist)


def _same(a: str, b: str, cohort: str, artist: str) -> Column:
    return F.col(f"{a}.{cohort}").eqNullSafe(F.col(f"{b}.{cohort}")) & F.col(f"{a}.{artist}").eqNullSafe(F.col(f"{b}.{artist}"))


def rhyme_craft(songs: DataFrame, cohort: str, artist: str, digits: int = 4) -> DataFrame:
    """Songs, and median and inclusive quartiles of the rhyme factor and of multisyllabic rhymes, median internal rate."""
    at = lambda c, q: F.round(F.percentile(c, F.lit(q)), digits)
    three = [at(c, q).alias(f"{c}_{n}") for c in ("rhyme_factor", "pct_multis") for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return _grains(songs, cohort, artist).agg(F.count("*").alias("songs"), *three, at("internal_rate", 0.5).alias("internal_rate_median"))


def scheme_counts(songs: DataFrame, cohort: str, artist: str, scheme: str = "scheme") -> DataFrame:
    rows = songs.where(F.col(scheme) != "")
    return rows.groupingSets([[cohort, artist, scheme], [cohort, scheme]], cohort, artist, scheme).agg(F.count("*").alias("n"))


def vowel_pairs(found: DataFrame, song: str, pair: str, songs: DataFrame, cohort: str, artist: str, each: int = 5, k: int = 10) -> DataFrame:
    """The ``k`` most frequent endings of a grain, added up from the ``each`` most frequent of every song."""
    counted = found.groupBy(song, pair).agg(F.count("*").alias("n"))
    top = C.top_k(counted, [song], [F.desc("n"), F.asc(pair)], each, "_r").select(song, pair, "n")
    rows = top.join(songs.select(song, cohort, artist), song)
    summed = rows.groupingSets([[cohort, artist, pair], [cohort, pair]], cohort, artist, pair).agg(F.sum("n").alias("n"))
    return C.top_k(summed, [cohort, artist], [F.desc("n"), F.asc(pair)], k)


def structure(parts: DataFrame, songs: DataFrame, song: str, cohort: str, artist: str, digits: int = 4) -> DataFrame:
    """Sections a song, lines a section, share of refrains, median hook repetition.

    ``parts``: a row a section with its ``kind`` and ``n_lines``.
    """
    per_song = parts.groupBy(song).agg(F.count("*").alias("_parts"), F.sum("n_lines").alias("_lines"), F.count_if(F.col("kind") == "refren").alias("_refrens"))
    rows = songs.join(per_song, song, "left")
    share = lambda a, b, d: F.when(F.sum(b) > 0, F.round(F.sum(a) / F.sum(b), d)).otherwise(0.0)
    return _grains(rows, cohort, artist).agg(
        F.coalesce(F.round(F.avg("_parts"), 2), F.lit(0.0)).alias("sections_per_song"), share("_lines", "_parts", 2).alias("lines_per_section"), share("_refrens", "_parts", 4).alias("refren_share"),
        F.round(F.median("hook_repetition_ratio"), digits).alias("hook_repetition_ratio"))


def section_types(parts: DataFrame, songs: DataFrame, song: str, cohort: str, artist: str) -> DataFrame:
    rows = parts.select(song, "kind").join(songs.select(song, cohort, artist), song)
    return rows.groupingSets([[cohort, artist, "kind"], [cohort, "kind"]], cohort, artist, "kind").agg(F.count("*").alias("n"))


def lexical(songs: DataFrame, cohort: str, artist: str, digits: int = 4) -> DataFrame:
    return _grains(songs, cohort, artist).agg(F.round(F.median("ttr"), digits).alias("ttr_median"), F.round(F.median("avg_syllables_per_line"), digits).alias("syllables_median"))


def top_forms(tokens: DataFrame, songs: DataFrame, song: str, cohort: str, artist: str, k: int = 20, exclude: tuple[str, ...] = FUNCTION) -> DataFrame:
    """The ``k`` most frequent forms of a grain that are of no function class; ``tokens``: song, form, upos."""
    content = tokens.where(F.col("form").isNotNull() & F.col("upos").isNotNull() & ~F.col("upos").isin(*exclude))
    # Counted by song first: what is joined is no longer a row a word.
    rows = content.groupBy(song, "form").agg(F.count("*").alias("_n")).join(songs.select(song, cohort, artist), song)
    counted = rows.groupingSets([[cohort, artist, "form"], [cohort, "form"]], cohort, artist, "form").agg(F.sum("_n").alias("n"))
    return C.top_k(counted, [cohort, artist], [F.desc("n"), F.asc("form")], k)


def top_entities(entities: DataFrame, songs: DataFrame, song: str, cohort: str, artist: str, k: int = 10, types: tuple[str, ...] = ENTITIES) -> DataFrame:
    """The ``k`` most frequent entities of each type; ``entities``: song, type, text."""
    rows = entities.where(F.col("type").isin(*types)).groupBy(song, "type", "text").agg(F.count("*").alias("_n")).join(songs.select(song, cohort, artist), song)
    counted = rows.groupingSets([[cohort, artist, "type", "text"], [cohort, "type", "text"]], cohort, artist, "type", "text").agg(F.sum("_n").alias("n"))
    return C.top_k(counted, [cohort, artist, "type"], [F.desc("n"), F.asc("text")], k)


def top_topics(sections: DataFrame, songs: DataFrame, song: str, cohort: str, artist: str, topic: str = "label", k: int = 5) -> DataFrame:
    """The ``k`` most frequent topics of a grain with their share among these."""
    rows = sections.groupBy(song, topic).agg(F.count("*").alias("_n")).join(songs.select(song, cohort, artist), song)
    counted = rows.groupingSets([[cohort, artist, topic], [cohort, topic]], cohort, artist, topic).agg(F.sum("_n").alias("n"))
    top = C.top_k(counted, [cohort, artist], [F.desc("n"), F.asc(topic)], k)
    totals = top.groupBy(cohort, artist).agg(F.sum("n").alias("_all")).alias("b")  # k rows a grain are summed
    return top.alias("a").join(totals, _same("a", "b", cohort, artist)).select(*(F.col(f"a.{c}") for c in (cohort, artist, topic, "n", "rank")), F.round(F.col("n") / F.col("_all"), 4).alias("share"))


def profile() -> Column:
    """Three sentences from the columns of a fingerprint."""
    text = lambda c, d, times=1: F.round(F.col(c).cast("decimal(14,8)") * times, d).cast("string")
    percent = lambda c, d: F.concat(text(c, d, 100), F.lit("%"))
    rf, multis = text("rhyme_factor_median", 2), percent("pct_multis_median", 1)
    rhyme = F.when(F.col("rhyme_factor_median") > 0.7, F.concat(F.lit("High rhyme density (RF="), rf, F.lit(") with heavy multisyllabic rhymes ("), multis, F.lit(").")))
    rhyme = rhyme.when(F.col("rhyme_factor_median") > 0.55, F.concat(F.lit("Moderate rhyme density (RF="), rf, F.lit(") with "), multis, F.lit(" multisyllabic rhymes.")))
    rhyme = rhyme.otherwise(F.concat(F.lit("Lean rhyme style (RF="), rf, F.lit(") with "), multis, F.lit(" multis.")))
    kind = F.when(F.col("refren_share") > 0.25, "Hook-heavy").otherwise("Verse-driven")
    form = F.concat(kind, F.lit(" structure ("), percent("refren_share", 0), F.lit(" refren, "), text("sections_per_song", 1), F.lit(" sections/song)."))
    words = F.concat(F.when(F.col("ttr_median") > 0.55, "Lexically diverse").otherwise("Repetitive lexicon"), F.lit(" (TTR="), text("ttr_median", 2), F.lit(", "), text("syllables_median", 1), F.lit(" syllables/line)."))
    return F.concat_ws(" ", rhyme, form, words)


def fingerprints(songs: DataFrame, parts: DataFrame, song: str, cohort: str, artist: str, digits: int = 4) -> DataFrame:
    """Rhyme craft, structure and lexicon side by side at both grains, with ``profile``."""
    out = rhyme_craft(songs, cohort, artist, digits)
    for other in (structure(parts, songs, song, cohort, artist, digits), lexical(songs, cohort, artist, digits)):
        named = [F.col(f"b.{c}") for c in other.columns if c not in (cohort, artist)]
        out = out.alias("a").join(other.alias("b"), _same("a", "b", cohort, artist)).select("a.*", *named)
    return out.withColumn("profile", profile())
