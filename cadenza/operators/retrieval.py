"""TF-IDF retrieval and topics over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus as C


def ngrams(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """key, term, tf: the 1- and 2-grams of words of two characters or more.

    Texts are shuffled by key before they are cut, which is less than their terms would be; counting then stays in place.
    """
    words = F.filter(T.words(F.col(text_col)), lambda w: F.length(w) >= 2)
    pairs = F.when(F.size("w") >= 2, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return C.dealt(df.select(key, text_col), key, text_col).select(key, words.alias("w")).select(key, F.explode(F.concat(F.col("w"), pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def tfidf(terms: DataFrame, key: str, features: int) -> DataFrame:
    """key, term, weight: tf * (ln((1 + n) / (1 + df)) + 1) of the most frequent terms, L2-normalised by key."""
    n = terms.agg(F.countDistinct(key).alias("_n"))
    df = terms.groupBy("term").agg(F.count("*").alias("_df"), F.sum("tf").alias("_tf")).orderBy(F.desc("_tf"), "term").limit(features)
    w = terms.join(F.broadcast(df), "term").crossJoin(F.broadcast(n))  # at most ``features`` rows; one row
    w = w.withColumn("weight", F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("weight") / norm).alias("weight"))


#: Rows of drafts' weights (some 40 bytes each) that may be sent to every task.
SENT = 1_000_000


def similar(drafts: DataFrame, corpus: DataFrame, draft: str, key: str, k: int = 5, draft_terms: int | None = None) -> DataFrame:
    """The k documents of largest cosine with each draft: a join on shared terms, not all pairs.

    ``draft_terms``: how many rows ``drafts`` has at most.  Up to ``SENT`` of them go to every task, so that the corpus'
    weights stay where they are, a document's products are added in place and a task sends its k best; else both sides
    are shuffled by term.
    """
    mine = drafts.select(draft, "term", F.col("weight").alias("_a"))
    if draft_terms is not None and draft_terms <= SENT:
        mine = F.broadcast(mine)
    dot = corpus.select(key, "term", F.col("weight").alias("_b")).join(mine, "term")
    scored = dot.groupBy(draft, key).agg(F.round(F.sum(F.col("_a") * F.col("_b")), 6).alias("cosine"))
    w = Window.partitionBy(draft).orderBy(F.desc("cosine"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topics(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, least: int = 10) -> DataFrame:
    """key, topic: k-means over embeddings; members of topics smaller than ``least`` are outliers (-1)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed).fit(rows)
    found = model.transform(rows).select(key, F.col("prediction").alias("topic"))
    size = F.count("*").over(Window.partitionBy("topic"))
    return found.select(key, F.when(size < least, -1).otherwise(F.col("topic")).alias("topic"))


# Which sections' lines show a song best.
SHOWN = {"refren": 0, "strofa": 1, "hook": 2}


def excerpts(lines: DataFrame, song: str, n: int = 4) -> DataFrame:
    """song, excerpt: the first ``n`` lines of a song's refrain, else verse, else hook, else another section; of several the
    one of most lines, then the first.  ``lines``: song, section, kind, ordinal, line."""
    place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SHOWN.items() for x in kv)), F.col("kind")), F.lit(3))
    sections = lines.groupBy(song, "section", "kind").agg(F.count("*").alias("_n"), F.min("ordinal").alias("_first"))
    best = sections.groupBy(song).agg(F.min(F.struct(place.alias("p"), (-F.col("_n")).alias("n"), "section", "_first")).alias("_b")).select(song, "_b.section", "_b._first")
    shown = lines.join(best, [song, "section"]).where(F.col("ordinal") < F.col("_first") + n)  # n lines a song at most
    return shown.groupBy(song).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line"))), lambda s: s["line"]), "\n").alias("excerpt"))


def few_shot(found: DataFrame, artist: str, title: str, excerpt: str = "excerpt", rank: str = "rank") -> DataFrame:
    """``found`` with ``few_shot_block``, an example for a prompt."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = (F.lit("--- Example "), text(rank), F.lit(" ---\nArtist: "), text(artist), F.lit("\nTitle: "), text(title), F.lit("\nExcerpt:\n"), text(excerpt), F.lit("\n--- End Example "), text(rank), F.lit(" ---"))
    return found.withColumn("few_shot_block", F.concat(*parts))
