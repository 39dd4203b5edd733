"""Structure templates: which sections the songs of a cohort have, in what order, and a template of n sections.

``parts``: a song's sections, one a row.  What is gathered in one row is one song's sections, a cohort's section types
(a fixed set) or its ``k`` most common orderings; none of it grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import corpus as C

# The rhyme scheme of each section type, the one of other types, and the lines of a type without any.
SCHEMES = {
    "strofa": "AABB",
    "refren": "AABB",
    "bridge": "ABAB",
    "prerefren": "AABB",
    "postrefren": "AABB",
    "intro": "free",
    "outro": "free",
    "hook": "AABB",
    "instrumental": "",
    "interlude": "free",
    "spoken": "free",
    "call_response": "ABAB",
    "tekst": "AABB",
    "other": "AABB",
}
SCHEME, LINES = "AABB", 8
#: Types that fill a progression, and types that are hooks.
FILLERS, HOOKS = ("strofa", "refren"), ("refren", "hook")


def types(parts: DataFrame, cohort: str, kind: str, lines: str) -> DataFrame:
    """cohort, kind, n (sections), lines (their mean number of lines, whole; of those that have any, null without)."""
    mean = F.round(F.avg(F.when(F.col(lines) > 0, F.col(lines)))).cast("long")
    return parts.groupBy(cohort, kind).agg(F.count("*").alias("n"), mean.alias("lines"))


def orderings(parts: DataFrame, song: str, cohort: str, order: str, kind: str, k: int = 20) -> DataFrame:
    """cohort, ordering array<string>, n, rank: the k most common sequences of types, on ties that of the first song."""
    sequence = F.transform(F.sort_array(F.collect_list(F.struct(order, kind))), lambda s: s[kind])
    each = parts.groupBy(cohort, song).agg(sequence.alias("ordering"))
    counted = each.groupBy(cohort, "ordering").agg(F.count("*").alias("n"), F.min(song).alias("_first"))
    return C.top_k(counted, [cohort], [F.desc("n"), F.asc("_first")], k).drop("_first")


def progression(kinds: str, ranked: str, n: int) -> Column:
    """n types: the first of the ranked orderings that is long enough, cut; else the most common one, filled up.

    ``kinds``: a cohort's types by falling frequency.  Places are filled by the verses and choruses among them in turn
    (without these by its two most frequent types).
    """
    long_ = F.get(F.filter(ranked, lambda o: F.size(o) >= n), F.lit(0))
    base = F.get(ranked, F.lit(0))
    fillers = F.filter(kinds, lambda x: x.isin(*FILLERS))
    fillers = F.when(F.size(fillers) > 0, fillers).otherwise(F.slice(kinds, 1, 2))
    places = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i >= F.size(base))
    filled = F.concat(base, F.transform(places, lambda i: F.get(fillers, i % F.size(fillers))))
    return F.coalesce(F.slice(long_, 1, n), filled)


def hook_forward(types_: Column) -> Column:
    """A chorus second, where neither of the first two is a hook; sequences of one section stay."""
    early = F.exists(F.slice(types_, 1, 2), lambda x: x.isin(*HOOKS))
    return F.when((F.size(types_) < 2) | early, types_).otherwise(F.concat(F.slice(types_, 1, 1), F.array(F.lit("refren")), F.slice(types_, F.lit(2), F.size(types_))))


def template(parts: DataFrame, song: str, cohort: str, order: str, kind: str, lines: str, n: int = 6, hooks_first: tuple[str, ...] = (), k: int = 20) -> DataFrame:
    """cohort, place (from 1), kind, lines, rhyme_scheme, total_lines: a template of n >= 1 sections for every cohort.

    Cohorts in ``hooks_first`` have a hook among their first two sections.  A cohort without sections has no rows.
    """
    if n < 1:
        raise ValueError("a template has a section or more")
    counted = types(parts, cohort, kind, lines)
    dims = counted.groupBy(cohort).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(kind).alias("kind")))), lambda s: s["kind"]).alias("_kinds"),
        F.map_from_entries(F.collect_list(F.struct(F.col(kind), F.coalesce("lines", F.lit(LINES).cast("long"))))).alias("_lines"),
    )
    top = orderings(parts, song, cohort, order, kind, k)
    ranked = top.groupBy(cohort).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ordering"))), lambda s: s["ordering"]).alias("_ranked"))
    chosen = dims.join(ranked, cohort).withColumn("_types", progression("_kinds", "_ranked", n))
    if hooks_first:
        chosen = chosen.withColumn("_types", F.when(F.col(cohort).isin(*hooks_first), F.slice(hook_forward(F.col("_types")), 1, n)).otherwise(F.col("_types")))
    schemes = F.create_map(*(F.lit(v) for kv in SCHEMES.items() for v in kv))
    sized = F.transform("_types", lambda x: F.struct(x.alias("kind"), F.coalesce(F.try_element_at("_lines", x), F.lit(LINES).cast("long")).alias("lines"), F.coalesce(F.try_element_at(schemes, x), F.lit(SCHEME)).alias("scheme")))
    chosen = chosen.withColumn("_parts", sized).withColumn("total_lines", F.aggregate("_parts", F.lit(0).cast("long"), lambda a, s: a + s["lines"]))
    rows = chosen.select(cohort, "total_lines", F.posexplode("_parts").alias("_at", "_s"))
    return rows.select(cohort, (F.col("_at") + 1).alias("place"), F.col("_s.kind").alias(kind), F.col("_s.lines").alias("lines"), F.col("_s.scheme").alias("rhyme_scheme"), "total_lines")
