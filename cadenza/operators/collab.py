"""Collaborations: craft alone and together, artists' summaries, and the network by the rules of its edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corpus as C

TOGETHER = ("duo", "trio", "featured")
CRAFT = {"avg_syllables_per_line": 2, "ttr": 4, "avg_words_per_line": 2}


def _like(category: str, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.col(category).ilike(f"%{n}%"), F.lit(False))
    return out


def comparison(songs: DataFrame, artist: str, category: str, columns: dict[str, int] | None = None, digits: int = 4) -> DataFrame:
    """A row an artist: songs and mean craft alone and together, and the differences (null where a side is missing or 0)."""
    columns = columns or CRAFT
    sides = {"solo": _like(category, "solo"), "collab": _like(category, *TOGETHER)}
    each = [F.count_if(on).alias(f"{s}_songs") for s, on in sides.items()]
    each += [F.coalesce(F.round(F.avg(F.when(on, F.col(c))), d), F.lit(0.0)).alias(f"{s}_{c}") for s, on in sides.items() for c, d in columns.items()]
    out = songs.groupBy(artist).agg(*each)
    for c in columns:
        a, b = F.col(f"solo_{c}"), F.col(f"collab_{c}")
        out = out.withColumn(f"delta_{c}", F.when((a != 0) & (b != 0), F.round(b - a, digits)))
    return out


def summary(songs: DataFrame, artist: str, category: str, columns: dict[str, int] | None = None) -> DataFrame:
    """Artists with songs together: numbers alone and together, and mean craft of all their songs."""
    columns = columns or {"avg_syllables_per_line": 2, "ttr": 4}
    means = [F.round(F.avg(c), d).alias(f"avg_{c.removeprefix('avg_')}") for c, d in columns.items()]
    return songs.groupBy(artist).agg(F.count_if(_like(category, "solo")).alias("solo_songs"), F.count_if(_like(category, *TOGETHER)).alias("collab_songs"), *means).where("collab_songs > 0")


def edges(songs: DataFrame, title: str, primary: str, featured: str, category: str, role: str, target: str) -> DataFrame:
    """a, b, title: an edge for each pair that a song joins, in lower case and in order.

    A featured song joins the artist it is filed under with its own and its own with each other featured one; a category
    named ``x-y-duo`` or ``-trio`` joins its parts; a solo song joins its artist with each featured one.
    """
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    kind = "array<struct<a:string,b:string>>"
    none = F.array().cast(kind)
    artist = F.coalesce(F.col(primary), F.lit(""))
    others = F.filter(F.coalesce(featured, F.array().cast("array<string>")), lambda f: f.isNotNull() & (f != "") & (f != artist))
    with_others = F.transform(others, lambda f: pair(artist, f))
    filed = (F.col(role) == "featured") & (F.coalesce(target, F.lit("")) != "") & (artist != "")
    own = F.when(filed, F.concat(F.array(pair(F.col(target), artist)), with_others)).otherwise(none)
    names = F.split(F.replace(F.replace(F.col(category), F.lit("-duo"), F.lit("")), F.lit("-trio"), F.lit("")), "-")
    joint = F.contains(F.col(category), F.lit("-duo")) | F.contains(F.col(category), F.lit("-trio"))
    pairs = F.flatten(F.transform(names, lambda p, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda q: pair(p, q))))
    solo = F.when(F.col(role) == "solo", with_others).otherwise(none)
    every = F.concat(own.cast(kind), F.when(joint, pairs).otherwise(none).cast(kind), solo.cast(kind))
    rows = songs.select(F.col(title).alias("title"), F.explode(every).alias("e")).select("title", F.lower("e.a").alias("x"), F.lower("e.b").alias("y"))
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "title")


def pairs(edge_rows: DataFrame) -> DataFrame:
    """a, b, weight (songs, counted as often as they join the two)."""
    return edge_rows.groupBy("a", "b").agg(F.count("*").alias("weight"))


def centrality(weighted: DataFrame) -> DataFrame:
    """node, degree (artists it is joined with), centrality: the degree over the largest."""
    both = weighted.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(weighted.select("b", "a"))
    each = both.distinct().groupBy("node").agg(F.count("*").alias("degree"))
    most = each.agg(F.max("degree").alias("_most"))  # one row
    return each.crossJoin(F.broadcast(most)).select("node", "degree", F.round(F.col("degree") / F.col("_most"), 4).alias("centrality"))


def overview(edge_rows: DataFrame) -> DataFrame:
    """One row: artists, edges, distinct songs, density in percent (edges over all pairs of artists)."""
    weighted = pairs(edge_rows)
    nodes = weighted.select(F.explode(F.array("a", "b")).alias("n")).agg(F.countDistinct("n").alias("artists"))
    n = F.col("artists")
    whole = weighted.agg(F.count("*").alias("edges")).crossJoin(nodes).crossJoin(edge_rows.agg(F.countDistinct("title").alias("songs")))  # one row each
    return whole.select("artists", "edges", "songs", F.when(n > 1, F.round(100 * 2 * F.col("edges") / (n * (n - 1)), 4)).otherwise(0.0).alias("density"))


def top_pairs(weighted: DataFrame, k: int = 20) -> DataFrame:
    return weighted.orderBy(F.desc("weight"), "a", "b").limit(k)


def partners(weighted: DataFrame, k: int = 5) -> DataFrame:
    """node, other, weight, rank: each artist's ``k`` most frequent partners."""
    both = weighted.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionAll(weighted.where("a <> b").select("b", "a", "weight"))
    return C.top_k(both, ["node"], [F.desc("weight"), F.asc("other")], k)
