"""Reports: how a corpus is annotated, whether its lexicon and topics tell two cohorts apart, and drafts' scores by component.

Every figure is a row or a column; what is crossed or joined is one row, or one row a cohort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import corpus as C
from . import rhyme as R
from . import suggest as S

#: Least distinctiveness of a cohort's word, of a strong one, and the least divergence of topics.
DISTINCT, STRONG, APART = 0.5, 1.0, 0.05
#: Lower edges of the distinctiveness buckets, exclusive, and their names.
BUCKETS = ((2.0, ">2"), (1.0, "1-2"), (0.5, "0.5-1"), (-0.5, "-0.5 to 0.5"), (-1.0, "-1 to -0.5"), (-2.0, "-2 to -1"))
LOWEST = "<-2"


def coverage(lines: DataFrame, text: str, tokens: DataFrame, line_key: list[str], script: str, entities: DataFrame) -> DataFrame:
    """One row: total_lines (with text), annotated_lines (with a token), percent, tokens, cyrillic and latin of them, entities."""
    whole = lines.agg(F.count_if(F.col(text).isNotNull() & (F.col(text) != "")).alias("total_lines"))
    marked = tokens.groupBy(*line_key).agg(F.count("*").alias("n"), F.count_if(F.col(script) == "cyrillic").alias("c"), F.count_if(F.col(script) == "latin").alias("l"))
    seen = marked.agg(F.count("*").alias("annotated_lines"), *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "tokens"), ("c", "cyrillic"), ("l", "latin"))))
    named = entities.agg(F.count("*").alias("entities"))
    out = whole.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(named))  # each: one row
    share = F.when(F.col("total_lines") > 0, F.round(100 * F.col("annotated_lines") / F.col("total_lines"), 1)).otherwise(0.0)
    return out.select("total_lines", "annotated_lines", share.alias("percent"), "tokens", "cyrillic", "latin", "entities")


def lexicon_summary(lexicon: DataFrame, distinctiveness: str = "distinctiveness") -> DataFrame:
    """One row: terms, those of the one cohort and of the other, and strong ones of either."""
    d = F.col(distinctiveness)
    return lexicon.agg(F.count("*").alias("terms"), F.count_if(d > DISTINCT).alias("distinct_a"), F.count_if(d < -DISTINCT).alias("distinct_b"), F.count_if(F.abs(d) > STRONG).alias("strong"))


def histogram(lexicon: DataFrame, distinctiveness: str = "distinctiveness") -> DataFrame:
    """bucket, n of the seven buckets of distinctiveness that have a term; a null is in the lowest."""
    d = F.col(distinctiveness)
    name = F.when(F.lit(False), "")
    for low, label in BUCKETS:
        name = name.when(d > low, label)
    return lexicon.groupBy(name.otherwise(LOWEST).alias("bucket")).agg(F.count("*").alias("n"))


def over_represented(both: DataFrame, item: str) -> DataFrame:
    """item, p, q, ratio: how much more of the first side an item is; infinite where the second lacks it.

    ``both``: item, p, q as of ``corpus.aligned``.
    """
    return both.select(item, "p", "q", F.when(F.col("q") > 0, F.col("p") / F.col("q")).otherwise(F.lit(float("inf"))).alias("ratio"))


def gate(summary: DataFrame, divergence: DataFrame) -> DataFrame:
    """One row of the three tests and ``passed``: words of both cohorts, strong words, topics that differ.

    ``summary``: of ``lexicon_summary``; ``divergence``: jsd.
    """
    both = summary.crossJoin(F.broadcast(divergence))  # one row each
    words, strong, topics = (F.col("distinct_a") > 0) & (F.col("distinct_b") > 0), F.col("strong") > 0, F.col("jsd") > APART
    return both.select("jsd", words.alias("words_differ"), strong.alias("words_strong"), topics.alias("topics_differ"), (words & strong & topics).alias("passed"))


#: The components of a draft's score and the measures of each, of equal weight.
COMPONENTS = {
    "structural": ("line_count", "section_count"),
    "rhyme": ("rhyme_factor", "pct_multis", "internal_rate"),
    "lexical": ("ttr", "avg_syllables_per_line"),
    "repetition": ("hook_repetition_ratio",),
}
#: The measure whose deviation in the cohort counts as none, so that it says how the draft differs but not how well.
LEVEL = "section_count"


def measured(drafts: DataFrame, doc: str, text: str, types: dict[str, str] | None = None, expected: str = "AABB") -> DataFrame:
    """doc, line_count, section_count, rhyme_factor, pct_multis (of the lines that the longest-first assignment groups),
    line_multis (of all lines, those whose last three skeleton letters come again), internal_rate, ttr,
    avg_syllables_per_line, hook_repetition_ratio, parts array<section, kind, n_lines, broken (number of the lines off
    the expected scheme)>: a row a draft, with 0 where it has no lines.

    ``types``: as for ``suggest.marked``.  A draft's lines are cut once for all measures but the assignment, and stay where
    they are: what follows is sorted and grouped within drafts.
    """
    lyric = ~F.col("is_label")
    by = lambda *c: Window.partitionBy(doc, *c)
    ending = lambda n: F.when(F.length("_skel") >= n, F.right("_skel", F.lit(n)))
    known = drafts.where(F.col(doc).isNotNull())
    rows = S.marked(known, doc, text, types).select(doc, "section", "kind", "line_no", "ordinal", "is_label", F.when(lyric, T.normalize(F.col("line"))).alias("_norm"))
    rows = rows.withColumn("_skel", T.skeleton(F.col("_norm"))).withColumns({"_two": ending(2), "_three": ending(3)})
    rows = rows.withColumn("_nth", F.row_number().over(by("_norm").orderBy("line_no"))).withColumn("_multi", F.count("_three").over(by("_three")) >= 2)
    # As ``rhyme.scheme`` does it: groups by their first line, then the lines alone.
    same = by("section", "_two")
    rows = rows.withColumn("_first", F.when(F.count("_two").over(same) >= 2, F.min("line_no").over(same)))
    first = F.col("_first").asc_nulls_last()
    rows = rows.withColumn("_place", F.row_number().over(by("section").orderBy(first, "is_label", "line_no"))).withColumn("_group", F.when(F.col("_first").isNotNull(), F.dense_rank().over(by("section").orderBy(first))))
    whole = by("section")
    rows = rows.withColumns({"_groups": F.max("_group").over(whole), "_rhymed": F.count("_group").over(whole), "_from": F.min(F.when(lyric, F.col("ordinal"))).over(whole)})
    code = F.coalesce("_group", F.col("_groups") + F.col("_place") - F.col("_rhymed"))
    wanted = F.array(*(F.lit(ord(c) - ord("A") + 1) for c in expected.upper())).cast("array<int>")
    right = F.coalesce(F.get(wanted, (F.col("ordinal") - F.col("_from")).cast("int")) == code, F.lit(False))
    inner = (F.length("_skel") >= 4) & F.col("_skel").rlike(R.PAIR_TWICE)
    rows = rows.select(doc, "section", "kind", "is_label", "_skel", "_nth", "_multi", (lyric & ~right).alias("_broken"), inner.alias("_inner"), T.words(F.col("_norm")).alias("_words"))
    of = lambda c: F.count_if(lyric & c)
    # A skeleton has a letter for each syllable.
    sums = {"_words": F.sum(F.when(lyric, F.size("_words"))), "_letters": F.sum(F.length("_skel")), "_inner": of(F.col("_inner")), "_multis": of(F.col("_multi")), "_again": of(F.col("_nth") == 2)}
    parts = rows.groupBy(doc, "section", "kind").agg(F.count_if(lyric).alias("n_lines"), F.count_if("_broken").alias("broken"), *(c.alias(n) for n, c in sums.items()), F.flatten(F.collect_list(F.when(F.col("_nth") == 1, F.array_distinct("_words")))).alias("_tokens"))
    each = parts.groupBy(doc).agg(
        F.sum("n_lines").alias("line_count"), F.count("*").alias("section_count"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums), F.size(F.array_distinct(F.flatten(F.collect_list("_tokens")))).alias("_unique"),
        F.sort_array(F.collect_list(F.struct("section", "kind", "n_lines", "broken"))).alias("parts"))
    hits = R.assigned(C.skeletons(known, text, [doc], S.LABEL), doc).groupBy(doc).agg(F.sum("match_length").alias("_hit"), F.round(F.avg((F.col("match_length") >= 3).cast("int")), 4).alias("pct_multis"))
    share = lambda a, b, d=4: F.when(F.col(b) > 0, F.round(F.coalesce(a, F.lit(0)) / F.col(b), d)).otherwise(0.0)
    return each.join(hits, doc, "left").select(
        doc, "line_count", "section_count", share("_hit", "_letters").alias("rhyme_factor"), F.coalesce("pct_multis", F.lit(0.0)).alias("pct_multis"), share("_multis", "line_count").alias("line_multis"), share("_inner", "line_count").alias("internal_rate"),
        share("_unique", "_words").alias("ttr"), share("_letters", "line_count", 2).alias("avg_syllables_per_line"), share("_again", "line_count").alias("hook_repetition_ratio"), "parts")


def baselines(songs: DataFrame, cohort: str) -> DataFrame:
    """A row a cohort: songs, and mean and population deviation of every measure; nulls count as 0 in a deviation."""
    columns = [c for names in COMPONENTS.values() for c in names]
    parts = [e for c in columns for e in (F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"), F.stddev_pop(F.coalesce(F.col(c), F.lit(0))).alias(f"{c}_std"))]
    return songs.groupBy(cohort).agg(F.count("*").alias("songs"), *parts)


def component_scores(drafts: DataFrame, base: DataFrame, key: str, cohort: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, cohort, the columns ``keep``, overall, a 0-100 score of each component (50: the cohort's mean), and the weakest of them.

    ``drafts``: key, cohort and the measures of ``COMPONENTS``; ``base``: of ``baselines``.  Drafts of a cohort that
    has no songs go; on equal scores the component named first in ``COMPONENTS`` is the weakest.
    """

    def z(c: str) -> Column:
        return F.lit(0.0) if c == LEVEL else T.zscore(F.coalesce(F.col(c), F.lit(0)), F.col(f"{c}_mean"), F.col(f"{c}_std"))

    scores = {n: T.score100(sum((z(c) for c in cs), F.lit(0.0)) / len(cs)) for n, cs in COMPONENTS.items()}
    out = drafts.join(base, cohort)
    overall = F.round(sum(scores.values(), F.lit(0.0)) / len(scores), 2)
    rounded = [F.round(s, 2).alias(n) for n, s in scores.items()]
    weakest = F.array_min(F.array(*(F.struct(F.col(n).alias("s"), F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(COMPONENTS))))["n"]
    return out.select(key, cohort, *keep, overall.alias("overall"), *rounded).withColumn("weakest", weakest)


#: A share of distinct words above the first is varied enough, below the second too little.
VARIED, PLAIN = 0.55, 0.35


def advice(scored: DataFrame, templates: DataFrame, checked: DataFrame, key: str, cohort: str) -> DataFrame:
    """key, weakest, place (from 1), advice, subject, amount: what a draft's weakest component asks for.

    ``scored``: of ``component_scores`` with ``ttr`` and ``hook_repetition_ratio`` kept.  structural: the sections of its
    cohort's template (``templates.template``) with their lines.  rhyme: its sections in order with their broken lines
    (``checked``: key, section, kind, broken: their places or their number), ``mend`` where there are any and ``keep`` elsewhere.  lexical: more or
    fewer distinct words.  repetition: its share of repeated lines.  Each table is read once; what is gathered in a row
    is one template or one draft's sections.
    """
    item = lambda said, subject, amount: F.struct(F.lit(said).alias("advice") if isinstance(said, str) else said.alias("advice"), subject.alias("subject"), amount.cast("double").alias("amount"))
    ordered = lambda order, s: F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_at"), s.alias("_s")))), lambda x: x["_s"])
    kind = templates.columns[2]
    shape = templates.groupBy(cohort).agg(ordered("place", item("section", F.concat_ws(" ", kind, F.nullif("rhyme_scheme", F.lit(""))), F.col("lines"))).alias("_shape"))
    broken = F.size("broken") if checked.schema["broken"].dataType.typeName() == "array" else F.col("broken")
    parts = checked.groupBy(key).agg(ordered("section", item(F.when(broken > 0, "mend").otherwise("keep"), F.col("kind"), broken)).alias("_parts"))
    ttr = F.coalesce("ttr", F.lit(0.0))
    words = F.when(ttr > VARIED, "fewer").when(ttr < PLAIN, "more").otherwise("keep")
    by = F.when(F.col("weakest") == "structural", F.col("_shape")).when(F.col("weakest") == "rhyme", F.col("_parts"))
    by = by.when(F.col("weakest") == "lexical", F.array(item(words, F.lit("distinct words"), ttr))).otherwise(F.array(item("repeat", F.lit("hook"), F.col("hook_repetition_ratio"))))
    rows = scored.join(shape, cohort, "left").join(parts, key, "left").select(key, "weakest", F.posexplode(by).alias("_at", "_s"))
    return rows.select(key, "weakest", (F.col("_at") + 1).alias("place"), "_s.advice", "_s.subject", "_s.amount")
