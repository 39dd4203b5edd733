"""Searching a library, sorting songs into cohorts and categories, and summaries of datasets, catalogues and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus as C

# ---- search ----


def search(df: DataFrame, text: str | None = None, within: tuple[str, ...] = (), equal: dict[str, object] | None = None, ranges: dict[str, tuple[object, object]] | None = None, tags: list[str] | None = None, tag_column: str = "tags") -> DataFrame:
    """Rows that meet every condition that is given: text in any of the columns (any case), equal values, ranges (ends
    included), any of the tags.  Conditions on columns are pushed to the scan."""
    out = df
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v)
    for c, (low, high) in (ranges or {}).items():
        out = out.where(F.col(c).between(low, high))
    if text:
        wanted = F.lit(text.lower())
        out = out.where(reduce(Column.__or__, (F.coalesce(F.contains(F.lower(c), wanted), F.lit(False)) for c in within), F.lit(False)))
    if tags:
        out = out.where(F.arrays_overlap(tag_column, F.array(*map(F.lit, tags))))
    return out


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value of the distinct values of columns; arrays give their elements."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    value = lambda c: F.explode(c) if c in arrays else F.col(c).cast("string")
    parts = [df.select(F.lit(c).alias("facet"), value(c).alias("value")).where("value is not null") for c in columns]
    return reduce(DataFrame.unionByName, parts).distinct()


def page(df: DataFrame, order: list[Column], offset: int, limit: int, total: str = "total") -> DataFrame:
    """A page of rows in an order, each with the number of all rows: a top-k and a count, no sort of everything."""
    counted = df.agg(F.count("*").alias(total))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(counted))  # one row


# ---- songs ----


def cohorts(songs: DataFrame, primary: str, role: str, target: str, artists: dict[str, str], folders: dict[str, str], out: str = "cohort") -> DataFrame:
    """Songs with their cohort: of their artist; for solo songs else of the first known artist in the artist's name (any
    case), else of their folder's name (lower case); null without.  The dictionaries are literals of the plan.
    """
    named = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    low = F.lower(primary)
    held = F.coalesce(*(F.when(F.contains(low, F.lit(a.lower())), c) for a, c in artists.items()), F.lit(None).cast("string"))
    solo = F.col(role) == "solo"
    return songs.withColumn(out, F.coalesce(F.try_element_at(named(artists), F.col(primary)), F.when(solo, held), F.when(solo, F.try_element_at(named(folders), F.lower(target)))))


def category(names: Column, variants: dict[str, list[str]], labels: dict[tuple[str, ...], str], otherwise: str) -> Column:
    """The label of exactly those people who are among the names: someone is if a variant is in a name (any case, trimmed).

    ``variants``: a person's spellings, lower case; ``labels``: by the people, in the order of ``variants``.
    """
    has = {p: F.coalesce(F.exists(names, lambda n: reduce(Column.__or__, (F.contains(F.trim(F.lower(n)), F.lit(v)) for v in vs))), F.lit(False)) for p, vs in variants.items()}
    out = F.when(F.lit(False), "")
    for people, label in labels.items():
        out = out.when(reduce(Column.__and__, (h if p in people else ~h for p, h in has.items())), label)
    return out.otherwise(otherwise)


def description(plays: Column, text: Column, least: int = 20) -> Column:
    """The first of two fields that holds one, which is longer than ``least`` in the first; else empty."""
    return F.coalesce(F.when(F.length(plays) > least, plays), text, F.lit(""))


def overlap(words: DataFrame, word: str, n: str, lexicon: DataFrame, form: str, distinctiveness: str, least: float = 0.5, k: int = 20) -> DataFrame:
    """side (a, b), forms, percent (of all words, by frequency), top: distinctive words of each side that a vocabulary has.

    ``top`` is the k most frequent of them, on ties by name.  A side without any has 0, 0 and an empty array.
    """
    d = F.col(distinctiveness)
    side = lexicon.select(F.lower(form).alias("_f"), F.when(d > least, "a").when(d < -least, "b").alias("side")).where("side is not null").distinct()
    both = words.select(F.col(word).alias("_f"), F.col(n).alias("_n")).join(side, "_f")
    top = C.top_k(both, ["side"], [F.desc("_n"), F.asc("_f")], k, "_r")
    best = top.groupBy("side").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_f"))), lambda s: s["_f"]).alias("top"))
    counted = both.groupBy("side").agg(F.count("*").alias("forms"), F.sum("_n").alias("_n"))
    total = words.agg(F.sum(n).alias("_all"))
    sides = lexicon.sparkSession.createDataFrame([("a",), ("b",)], "side string")
    out = sides.join(counted, "side", "left").join(best, "side", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("side", F.coalesce("forms", F.lit(0)).alias("forms"), F.coalesce(F.when(F.col("_all") > 0, F.round(100 * F.col("_n") / F.col("_all"), 2)), F.lit(0.0)).alias("percent"), F.coalesce("top", F.array().cast("array<string>")).alias("top"))


# ---- datasets ----


def _most(df: DataFrame, key: str, item: str, k: int, name: str, more: Column | None = None) -> DataFrame:
    """key, name array<struct<item, n>>: the k most frequent items of each key, on ties the first; df: key, place, item."""
    counted = df.groupBy(key, item).agg(F.count("*").alias("n"), F.min("place").alias("_p"))
    top = C.top_k(counted, [key], [F.desc("n"), F.asc("_p")], k, "_r")
    return (top if more is None else top.where(more)).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", item, "n"))), lambda s: F.struct(s[item].alias(item), s["n"].alias("n"))).alias(name))


def texts(df: DataFrame, key: str, text: str, english: list[str] | None = None, top: int = 10, repeated: int = 5) -> DataFrame:
    """A row a text: lines with something in them, words, distinct words, ttr, means and most of the lines' lengths, share
    of English words, its ``top`` most frequent words, and which of its ``repeated`` most frequent lines repeat.

    The longest row is bounded by these two and one text.  Equal counts are in the order of the text; null is empty.
    Texts are shuffled by their key before they are cut; all that follows stays in place.
    """
    whole = C.dealt(df.select(key, F.coalesce(text, F.lit("")).alias("_t")), key, "_t")
    words = whole.select(key, F.posexplode(T.words(F.col("_t"))).alias("place", "word"))
    lines = whole.select(key, F.posexplode(F.split("_t", "\n")).alias("place", "line")).where(F.col("line").rlike(r"\S"))
    listed = F.col("word").isin(*(english or [""]))
    by_word = words.groupBy(key, "word").agg(F.count("*").alias("n"))
    counted = by_word.groupBy(key).agg(F.sum("n").alias("words"), F.count("*").alias("unique_words"), F.sum(F.when(listed, F.col("n")).otherwise(0)).alias("_en"))
    sized = lines.groupBy(key).agg(F.count("*").alias("lines"), F.avg(F.length("line")).alias("_c"), F.max(F.length("line")).alias("_m"), F.avg(F.size(T.words(F.col("line")))).alias("_w"))
    out = whole.select(key).join(counted, key, "left").join(sized, key, "left").join(_most(words, key, "word", top, "top_words"), key, "left").join(_most(lines, key, "line", repeated, "hook_lines", F.col("n") > 1), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = lambda c: zero(F.when(F.col("words") > 0, F.round(c / F.col("words"), 3)))
    none = lambda item: F.array().cast(f"array<struct<{item}:string,n:bigint>>")
    return out.select(key, zero("lines").alias("lines"), zero("words").alias("words"), zero("unique_words").alias("unique_words"), share(F.col("unique_words")).alias("ttr"), zero(F.round("_c", 2)).alias("avg_line_chars"), zero("_m").alias("max_line_chars"), zero(F.round("_w", 2)).alias("avg_line_words"), share(F.col("_en")).alias("english"), F.coalesce("top_words", none("word")).alias("top_words"), F.coalesce("hook_lines", none("line")).alias("hook_lines"))


def whole(reports: DataFrame) -> DataFrame:
    """One row over all texts of ``texts``: songs, total_lines, total_words, avg_ttr, avg_english."""
    return reports.agg(F.count("*").alias("songs"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"), F.round(F.avg("ttr"), 3).alias("avg_ttr"), F.round(F.avg("english"), 3).alias("avg_english"))


# ---- catalogues and batches ----


def spans(df: DataFrame, columns: list[str]) -> DataFrame:
    """measure, least, most, n of numbers; null and 0 are no measurement.  A measure without any has no row."""
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*")
    return each.where("x <> 0").groupBy("measure").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.count("*").alias("n"))


def frequent(df: DataFrame, column: str | Column, k: int | None = None, name: str = "name", unknown: str = "Unknown") -> DataFrame:
    """name, n of a column's values, null and empty as ``unknown``; the k most frequent, on ties by name."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    counted = df.groupBy(F.coalesce(F.nullif(value, F.lit("")), F.lit(unknown)).alias(name)).agg(F.count("*").alias("n"))
    return counted if k is None else counted.orderBy(F.desc("n"), name).limit(k)


def failures(df: DataFrame, status: str, failed: str, slug: str, error: str, order: list[Column], k: int = 10, width: int = 120) -> DataFrame:
    """slug, error (its first ``width`` characters, empty without one) of the first k rows that failed."""
    return df.where(F.col(status) == failed).orderBy(*order).limit(k).select(slug, F.substring(F.coalesce(error, F.lit("")), 1, width).alias("error"))


def contents(groups: DataFrame, items: DataFrame, key: str, duration: str) -> DataFrame:
    """groups with their items' number and whole duration, 0 for those without; one join in place of a query a group."""
    counted = items.groupBy(key).agg(F.count("*").alias("items"), F.sum(duration).alias("total"))
    return groups.join(counted, key, "left").withColumns({"items": F.coalesce("items", F.lit(0)), "total": F.coalesce("total", F.lit(0))})


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, n (rows), nulls of every column: one pass over each table."""
    parts = []
    for name, df in tables.items():
        counted = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{k}") for k, c in enumerate(df.columns)))
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("_n").alias("n"), F.col(f"_{k}").alias("nulls")) for k, c in enumerate(df.columns))))
        parts.append(counted.select(F.lit(name).alias("table"), rows.alias("s")).select("table", "s.*"))
    return reduce(DataFrame.unionByName, parts)
