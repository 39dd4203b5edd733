"""Topics of sections: fit, assignment to fitted centres, a table of topics, and drafts against a cohort's themes.

Sections are rows with a vector.  ``Centres`` are few and short (one vector a topic), so they are broadcast and every
section is assigned in one pass; nothing else of the corpus leaves its tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import corpus as C

OUTLIER = -1


@dataclass(frozen=True)
class Centres:
    """Topics by number: their centres and how far a member may lie from its own; other topics are outliers."""

    vectors: list[list[float]]
    reach: list[float]


def assigned(df: DataFrame, key: str | list[str], vector: str, centres: Centres) -> DataFrame:
    """key, topic, distance, probability: the nearest centre, the first on ties; beyond its reach an outlier.

    ``probability``: of the topic among all, from the squared distances as of normal clusters of one width.
    """
    keys = [key] if isinstance(key, str) else key
    v = F.col(vector).cast("array<double>")
    each = [F.aggregate(F.zip_with(v, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres.vectors]
    rows = df.where(F.col(vector).isNotNull()).select(*keys, F.array(*(F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(each))).alias("_all"))
    best = rows.withColumn("_b", F.array_min("_all"))
    near = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.exp(-(x["d"] - F.col("_b.d")) / 2))
    reach = F.element_at(F.array(*map(F.lit, centres.reach)), F.col("_b.k") + 1)
    distance = F.sqrt("_b.d")
    return best.select(*keys, F.when(distance <= reach, F.col("_b.k")).otherwise(OUTLIER).alias("topic"), F.round(distance, 6).alias("distance"), F.round(1 / near, 6).alias("probability"))


def fit(df: DataFrame, key: str, vector: str, k: int, seed: int = 42, least: int = 10, widths: float = 3.0) -> Centres:
    """Topics by k-means, in falling size; those of fewer than ``least`` members are none.

    A topic reaches ``widths`` times as far as its members lie on average (root mean square).
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    model = KMeans(k=k, seed=seed).fit(rows.select(array_to_vector("v").alias("features")))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    open_ = Centres(centres, [float("inf")] * len(centres))
    sizes = assigned(rows, key, "v", open_).groupBy("topic").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rms")).where(F.col("n") >= least)
    kept = sizes.orderBy(F.desc("n"), "topic").collect()  # at most k rows
    return Centres([centres[r.topic] for r in kept], [widths * r.rms for r in kept])


def class_terms(terms: DataFrame, members: DataFrame, key: str, k: int = 10) -> DataFrame:
    """topic, term, weight, rank: the ``k`` words that mark a topic, by class TF-IDF: frequency in the topic times
    ln(1 + mean words a topic / frequency in all).  ``terms``: key, term, tf; a null term is none.

    Terms are counted once: with columns that cannot be null no join below adds a filter of its own, and all share the
    shuffle of the counts.
    """
    inside = terms.where(F.col("term").isNotNull()).join(members.where(F.col("topic") != OUTLIER).select(key, "topic"), key)
    whole = inside.select(F.coalesce("topic", F.lit(OUTLIER)).alias("topic"), F.coalesce("term", F.lit("")).alias("term"), "tf")
    counted = whole.groupBy("topic", "term").agg(F.sum("tf").alias("tf"))
    every = counted.groupBy("term").agg(F.sum("tf").alias("_f"))
    sizes = counted.groupBy("topic").agg(F.sum("tf").alias("_n"))  # a row a topic
    mean = sizes.agg(F.avg("_n").alias("_mean"))  # one row
    weighed = counted.join(every, "term").join(F.broadcast(sizes), "topic").crossJoin(F.broadcast(mean))
    weight = F.round(F.col("tf") / F.col("_n") * F.log(1 + F.col("_mean") / F.col("_f")), 9)
    return C.top_k(weighed.select("topic", "term", weight.alias("weight")), ["topic"], [F.desc("weight"), F.asc("term")], k)


def table(members: DataFrame, terms: DataFrame, key: str, named: int = 4) -> DataFrame:
    """topic, label (number and its first words), top_terms, size, exemplar (its first section in order).

    ``terms``: of ``class_terms``.
    """
    words = terms.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("top_terms"))
    sizes = members.where(F.col("topic") != OUTLIER).groupBy("topic").agg(F.count("*").alias("size"), F.min(key).alias("exemplar"))
    none = F.array().cast("array<string>")
    out = sizes.join(words, "topic", "left").withColumn("top_terms", F.coalesce("top_terms", none))
    label = F.concat_ws("_", F.col("topic").cast("string"), F.slice("top_terms", 1, named))
    return out.select("topic", label.alias("label"), "top_terms", "size", "exemplar")


def shares(members: DataFrame, by: list[str]) -> DataFrame:
    """by, topic, n, share of the sections that are no outliers."""
    return C.shares(members.where(F.col("topic") != OUTLIER), by, "topic")


def compared(drafts: DataFrame, cohort: DataFrame, draft: str, margin: float = 0.02) -> DataFrame:
    """Each draft's topics beside a cohort's: draft, topic, input_pct, cohort_pct, verdict (over, under, even), place
    among its over- or under-represented ones by the gap.

    ``drafts``: draft, topic; ``cohort``: topic; outliers count on neither side.  A cohort has a row a topic.
    """
    mine = shares(drafts, [draft]).select(draft, "topic", F.col("share").alias("input_pct"))
    whole = shares(cohort, []).select("topic", F.col("share").alias("cohort_pct"))
    every = drafts.select(draft).distinct().crossJoin(F.broadcast(whole))  # a row a topic
    both = every.join(mine, [draft, "topic"], "full_outer").fillna(0.0, ["input_pct", "cohort_pct"])
    gap = F.round(F.col("input_pct") - F.col("cohort_pct"), 9)
    verdict = F.when(gap > margin, "over").when(gap < -margin, "under").otherwise("even")
    w = Window.partitionBy(draft, "verdict").orderBy(F.desc(F.abs("_gap")), "topic")
    rows = both.withColumn("_gap", gap).withColumn("verdict", verdict)
    return rows.select(draft, "topic", F.round("input_pct", 4).alias("input_pct"), F.round("cohort_pct", 4).alias("cohort_pct"), "verdict", F.row_number().over(w).alias("place"))


def divergences(drafts: DataFrame, cohort: DataFrame, draft: str) -> DataFrame:
    """draft, jsd: the root of the Jensen-Shannon divergence (natural) of each draft's topic shares from the cohort's;
    0 for a draft without topics."""
    mine = shares(drafts, [draft]).select(draft, "topic", F.col("share").alias("p"))
    whole = shares(cohort, []).select("topic", F.col("share").alias("q"))
    every = drafts.select(draft).distinct().crossJoin(F.broadcast(whole))  # a row a topic
    both = every.join(mine, [draft, "topic"], "full_outer").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0)
    total = F.sum(part("p") + part("q")) / 2
    empty = F.sum("p") == 0
    return both.groupBy(draft).agg(F.round(F.when(empty, 0.0).otherwise(F.sqrt(F.greatest(total, F.lit(0.0)))), 6).alias("jsd"))
