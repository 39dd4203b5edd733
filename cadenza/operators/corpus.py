"""The line model of a corpus and its lexical, structural and comparative measures.

Every operator takes DataFrames and column names and returns a DataFrame; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(df: DataFrame, text_col: str, keep: list[str], norm: bool = True) -> DataFrame:
    """One row per non-blank line: ``keep`` columns, ordinal from 1, line, line_norm, word_count, syllable_count."""
    each = F.filter(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = df.select(*keep, F.posexplode(each).alias("_at", "line")).select(*keep, (F.col("_at") + 1).alias("ordinal"), "line")
    out = out.withColumn("line_norm", T.normalize(F.col("line")) if norm else F.lower("line"))
    return out.withColumn("word_count", F.size(T.words(F.col("line_norm")))).withColumn("syllable_count", T.syllables(F.col("line_norm")))


def skeletons(df: DataFrame, text_col: str, keep: list[str], skip: str | None = None) -> DataFrame:
    """``keep``, ordinal (of ``lines``), skel of every non-blank line that does not match ``skip``.

    Skeletons are made before the text is dealt into rows, so that a filter on them does not make them again.
    """
    return df.select(*keep, F.posexplode(T.line_skeletons(F.col(text_col), skip)).alias("_at", "skel")).select(*keep, (F.col("_at") + 1).alias("ordinal"), "skel")


def words(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep``, token of every word of the normalised text: the tokens of its ``lines`` without their places."""
    return df.select(*keep, F.explode(T.words(T.normalize(F.col(text_col)))).alias("token"))


def tokens(lines_df: DataFrame, keep: list[str], line_col: str = "line_norm") -> DataFrame:
    """One row per word of a line: ``keep``, position from 1, token."""
    return lines_df.select(*keep, F.posexplode(T.words(F.col(line_col))).alias("_at", "token")).select(*keep, (F.col("_at") + 1).alias("position"), "token")


def composed(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the text's marks composed (NFC): only rows that have marks apart from their letters leave the JVM."""
    apart = F.coalesce(F.col(text_col).rlike(r"\p{M}"), F.lit(False))
    marked = T.small_batches(df).where(apart).withColumn(text_col, T.nfc()(F.col(text_col)))
    return df.where(~apart).unionByName(marked)


#: Characters of text in a part of ``dealt``: words and pairs of words of so much take some hundred MB in a task.
DEALT = 4_000_000


def dealt(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key``, text, shuffled by key in parts of about ``DEALT`` characters, counted first: what is cut and counted in a
    part stays as large as that at any size of the input, as parts of a given number are not put together again."""
    return in_parts(df, key, df.agg(F.sum(F.length(text_col))).first()[0] or 0, DEALT)


def in_parts(df: DataFrame, key: str, size: int, most: int) -> DataFrame:
    """``df`` of the given size shuffled by key in parts of about ``most``; where it is more than one, all cores have a part."""
    least = df.sparkSession.sparkContext.defaultParallelism if size > most else 1
    return df.repartition(max(least, -(-size // most)), key)


def shared(df: DataFrame) -> DataFrame:
    """``df`` behind a shuffle of its whole rows: as no reader's plan can leave a column out of it, those of a plan that
    read it more than once have one shuffle, which Spark runs once."""
    return df.select(F.array(F.struct("*")).alias("_row")).repartition("_row").select(F.inline("_row"))


def dedup(df: DataFrame, keys: list[Column], order: list[Column], path_col: str) -> DataFrame:
    """Every row with ``is_kept`` (first of its key) and ``duplicate_of`` (the first's path, null on the first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first(path_col).over(w))
    return out.select(*df.columns, (F.col("_n") == 1).alias("is_kept"), F.when(F.col("_n") > 1, F.col("_first")).alias("duplicate_of"))


def sections(lines_df: DataFrame, keys: list[str], order: str, line_col: str, default: str = "intro") -> DataFrame:
    """Lines with the [label] above them; label lines go, and so do sections without lines."""
    w = Window.partitionBy(*keys).orderBy(order)
    is_label = F.col(line_col).rlike(r"^\[[^\]]+\]$")
    out = lines_df.withColumn("_is", is_label).withColumn("section", F.sum(F.col("_is").cast("long")).over(w))
    out = out.withColumn("label", F.coalesce(F.last(F.when(F.col("_is"), F.regexp_extract(line_col, r"^\[(.*)\]$", 1)), True).over(w), F.lit(default)))
    return out.where(~F.col("_is")).drop("_is")


def song_metrics(lines_df: DataFrame, key: list[str], loanwords: list[str]) -> DataFrame:
    """Per song: words, distinct words, ttr, lines, means per line, hook repetition and loanword rate.

    Lines of texts that were repartitioned by a part of the key before they were cut need no further shuffle here.
    """
    words = F.coalesce(T.words(F.col("line_norm")), F.array().cast("array<string>"))
    each = lines_df.groupBy(*key, "line_norm").agg(F.count("*").alias("n"), F.sum("word_count").alias("_words"), F.sum("syllable_count").alias("_syllables")).withColumn("_tokens", words)
    loans = F.size(F.filter("_tokens", lambda w: w.isin(loanwords)))
    out = each.groupBy(*key).agg(
        F.sum(F.size("_tokens") * F.col("n")).alias("total_words"), F.size(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("_tokens"))))).cast("long").alias("unique_words"), F.sum(loans * F.col("n")).alias("_loans"),
        F.sum("n").alias("line_count"), F.round(F.sum("_words") / F.sum("n"), 2).alias("avg_words_per_line"), F.round(F.sum("_syllables") / F.sum("n"), 2).alias("avg_syllables_per_line"),
        F.max("n").alias("hook_repetition_max"), F.count_if(F.col("n") > 1).alias("_repeated"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return out.select(*key, "total_words", "unique_words", share("unique_words", "total_words").alias("ttr"), "line_count", "avg_words_per_line", "avg_syllables_per_line", "hook_repetition_max", share("_repeated", "line_count").alias("hook_repetition_ratio"), share("_loans", "total_words").alias("english_loanword_rate"))


def means(df: DataFrame, by: list[str], columns: dict[str, int]) -> DataFrame:
    """Count and rounded means of columns (name: digits) per group."""
    return df.groupBy(*by).agg(F.count("*").alias("songs"), *(F.round(F.avg(c), d).alias(f"avg_{c}") for c, d in columns.items()))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_words(token_df: DataFrame, by: list[str], k: int = 20) -> DataFrame:
    counted = token_df.groupBy(*by, "token").agg(F.count("*").alias("n"))
    return top_k(counted, by, [F.desc("n"), F.asc("token")], k)


def bucketed(x: Column, edges: list[int]) -> Column:
    """Labels such as 0-4, 5-8, 9+ for ascending upper edges."""
    out, low = F.when(F.lit(False), ""), 0
    for e in edges:
        out = out.when(x <= e, f"{low}-{e}")
        low = e + 1
    return out.otherwise(f"{low}+")


def mined_lexicon(token_df: DataFrame, cohort: str, a: str, b: str, least: int = 3, rate: float = 10_000.0, n: str | None = None) -> DataFrame:
    """Words with their counts in two cohorts, rates per ``rate`` words and log-ratio distinctiveness.

    ``n``: how often a row's token occurs, if they are counted; such a table is not filtered first, so that a plan can
    share it.
    """
    if n is None:
        token_df, one = token_df.where(F.col(cohort).isin(a, b)), F.lit(1)
    else:
        one = F.col(n)
    of = lambda c: F.sum(F.when(F.col(cohort) == c, one).otherwise(0))
    counted = token_df.groupBy("token").agg(of(a).alias("freq_a"), of(b).alias("freq_b")).where("freq_a + freq_b > 0")
    totals = counted.agg(F.sum("freq_a").alias("_a"), F.sum("freq_b").alias("_b"))
    both = counted.crossJoin(F.broadcast(totals)).where(F.col("freq_a") + F.col("freq_b") >= least)  # totals: one row
    return both.select("token", "freq_a", "freq_b", F.round(T.log_ratio(F.col("freq_a") * rate / F.col("_a"), F.col("freq_b") * rate / F.col("_b")), 6).alias("distinctiveness"))


def lexicon_top(lexicon: DataFrame, direction: str | None, k: int) -> DataFrame:
    """The k most distinctive words of one cohort (over 0.5, under -0.5) or of either."""
    d = F.col("distinctiveness")
    rows, order = {"a": (lexicon.where(d > 0.5), d.desc()), "b": (lexicon.where(d < -0.5), d.asc()), None: (lexicon, F.abs(d).desc())}[direction]
    return rows.orderBy(order, "token").limit(k)


def shares(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """Share of each item among its group's rows; groups are summed apart and joined, so that none has to fit in a task."""
    counted = df.groupBy(*by, item).agg(F.count("*").alias("n"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_all"))
    both = counted.join(totals, by) if by else counted.crossJoin(F.broadcast(totals))  # totals: one row
    return both.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def aligned(p: DataFrame, q: DataFrame, item: str) -> DataFrame:
    """item, p, q: two share tables side by side, 0 where one lacks the item."""
    left, right = p.select(item, F.col("share").alias("p")), q.select(item, F.col("share").alias("q"))
    return left.join(right, item, "full_outer").fillna(0.0, ["p", "q"])


def divergence(both: DataFrame, base: float = 2.0, rooted: bool = False) -> DataFrame:
    """One row: the Jensen-Shannon divergence of the columns p and q, each scaled to sum to 1; 0 if a side is empty."""
    total = both.agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    x = both.crossJoin(F.broadcast(total)).where("_p > 0 and _q > 0").select((F.col("p") / F.col("_p")).alias("p"), (F.col("q") / F.col("_q")).alias("q"))  # total: one row
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / m)).otherwise(0.0)
    import math

    out = F.greatest(F.lit(0.0), F.coalesce(F.sum(part("p") + part("q")) / 2 / math.log(base), F.lit(0.0)))
    return x.agg(F.round(F.sqrt(out) if rooted else out, 6).alias("jsd"))


def effect_sizes(df: DataFrame, cohort: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """metric, mean_a, mean_b, cohens_d (pooled variance; 0 for fewer than two or no spread), effect."""
    long = df.where(F.col(cohort).isin(a, b)).select(cohort, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("s")).select(cohort, "s.metric", "s.x")
    one = lambda c, f: f(F.when(F.col(cohort) == c, F.col("x")))
    g = long.groupBy("metric").agg(*(one(c, f).alias(f"{n}_{s}") for s, c in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    d = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2) | (pooled == 0), 0.0).otherwise((F.col("mean_b") - F.col("mean_a")) / pooled)
    size = F.abs(d)
    effect = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return g.select("metric", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.round(d, 6).alias("cohens_d"), effect.alias("effect"))


def quartiles(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Exact inclusive quartiles: ``<column>_q1``, ``_median``, ``_q3``."""
    names = ("q1", "median", "q3")
    return df.groupBy(*by).agg(*(F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{n}") for c in columns for n, q in zip(names, (0.25, 0.5, 0.75))))


def fuzzy_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of words at edit distance 1 by deletion neighbourhoods: an equi-join, never a cross join.

    Each word is keyed by itself and by itself without each of its characters; words at distance 1 share a key.
    """

    def keyed(df: DataFrame, c: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return df.select("*", F.explode(F.array_distinct(F.array_append(cut, F.col(c)))).alias("_key"))

    return keyed(left, a).join(keyed(right, b), "_key").where(F.col(a) != F.col(b)).drop("_key").dropDuplicates([a, b]).where(F.levenshtein(F.col(a), F.col(b), 1) == 1)


def network(df: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected weighted edges: a < b (lower case), weight."""
    x, y = F.lower(a), F.lower(b)
    return df.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).groupBy("a", "b").agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, weight, centrality (degree over the largest possible)."""
    both = edges.select(F.col("a").alias("node"), "weight").unionAll(edges.select(F.col("b").alias("node"), "weight"))
    each = both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))
    n = each.agg(F.count("*").alias("_n"))
    return each.crossJoin(F.broadcast(n)).select("node", "degree", "weight", F.round(F.col("degree") / (F.col("_n") - 1), 6).alias("centrality"))  # n: one row
