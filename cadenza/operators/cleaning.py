"""Worn phrases, tokens of audio tools, and marked letters in drafts.

``lines``: a draft's key, ``line_no``, ``line``.  Lists of terms are short and become part of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import drafts as D

_EDGE = r"[\p{L}\p{N}_]"


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>") if values else F.array().cast("array<string>")


def _folded(terms: list[str]) -> list[str]:
    two, one = T.FOLD_TWO, str.maketrans(*T.FOLD)
    out = []
    for t in terms:
        t = t.lower()
        for a, b in two.items():
            t = t.replace(a, b)
        out.append(t.translate(one))
    return list(dict.fromkeys(out))


def cliche_hits(lines: DataFrame, doc: str, terms: list[str], audio: list[str]) -> DataFrame:
    """Every line with ``tokens``, ``terms`` (worn words in their order, then phrases), ``worn`` (words that these are) and
    ``audio`` (tokens of audio tools).  Terms of several words are phrases and are looked for as they stand in the line."""
    known = _folded(terms)
    singles, phrases = [t for t in known if " " not in t], [t for t in known if " " in t]
    words = T.words(T.ascii_fold(F.col("line")))
    low = F.lower("line")
    rows = lines.select(doc, "line_no", words.alias("_w"), F.filter(_array(phrases), lambda p: F.contains(low, p)).alias("_p"))
    mine = F.filter("_w", lambda w: F.array_contains(_array(singles), w))
    in_phrases = F.aggregate("_p", F.lit(0), lambda n, p: n + F.size(F.split(p, " +")))
    heard = F.size(F.filter("_w", lambda w: F.array_contains(_array([a.lower() for a in audio]), w)))
    return rows.select(doc, "line_no", F.size("_w").alias("tokens"), F.concat(mine, "_p").alias("terms"), (F.size(mine) + in_phrases).alias("worn"), heard.alias("audio"))


def cliche_report(hits: DataFrame, doc: str) -> DataFrame:
    """total_cliches, density_pct (of all words), lines with hits, audio tokens and the lines that have them."""
    total, tokens = F.sum("worn"), F.sum("tokens")
    return hits.groupBy(doc).agg(
        total.alias("total_cliches"), F.when(tokens > 0, F.round(100 * total / tokens, 2)).otherwise(0.0).alias("density_pct"), F.count_if(F.size("terms") > 0).alias("lines_hit"),
        F.sum("audio").alias("audio_token_count"), F.count_if(F.col("audio") > 0).alias("audio_lines"))


def _removals(tokens: list[str]) -> tuple[str, str]:
    longest = sorted({t.lower() for t in tokens}, key=lambda t: (-len(t), t))
    any_ = "|".join(map(re.escape, longest))
    return rf"(?i)\[({any_})\]", rf"(?i)(?<!{_EDGE})({any_})(?!{_EDGE})"


def cleaned_lines(lines: DataFrame, doc: str, tokens: list[str]) -> DataFrame:
    """doc, line_no, line without ``[token]`` and bare tokens and what they leave at its end, removed (the tokens, lower
    case), emptied (whether only that was there)."""
    bracketed, bare = _removals(tokens)
    rows = lines.select(doc, "line_no", "line", F.regexp_replace("line", bracketed, "").alias("_a"))
    gone = F.concat(F.regexp_extract_all("line", F.lit(bracketed), 1), F.regexp_extract_all("_a", F.lit(bare), 1))
    left = F.rtrim(F.regexp_replace("_a", bare, ""))
    return rows.select(doc, "line_no", left.alias("line"), F.transform(gone, F.lower).alias("removed"), ((F.trim(left) == "") & (F.trim("line") != "")).alias("emptied"))


def cleaned(cleaned_: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc and its text without the lines that removals emptied; removed_count and lines_affected."""
    kept = F.collect_list(F.when(~F.col("emptied"), F.struct("line_no", "line")))
    whole = F.array_join(F.transform(F.sort_array(kept), lambda s: s["line"]), "\n")
    return cleaned_.groupBy(doc).agg(whole.alias(text), F.sum(F.size("removed")).alias("removed_count"), F.count_if(F.size("removed") > 0).alias("lines_affected"))


def removed_tokens(cleaned_: DataFrame, doc: str) -> DataFrame:
    """doc, token, n."""
    return cleaned_.select(doc, F.explode("removed").alias("token")).groupBy(doc, "token").agg(F.count("*").alias("n"))


def canonical_forms(counted: DataFrame, form: str, n: str, fold: Callable[[Column], Column]) -> DataFrame:
    """folded, canonical of words that a corpus has with and without marks: the more frequent, the plain one on ties."""
    rows = counted.withColumn("folded", fold(F.col(form)))
    plain = F.col(form) == F.col("folded")
    best = F.min(F.struct((-F.col(n)).alias("o"), (~plain).alias("marked"), F.col(form).alias("f")))
    g = rows.groupBy("folded").agg(best.alias("_b"), F.count_if(plain).alias("_p"), F.count_if(~plain).alias("_m"))
    return g.where("_p > 0 and _m > 0").select("folded", F.col("_b.f").alias("canonical"))


def diacritic_issues(lines: DataFrame, doc: str, canonical: DataFrame | None, fold: Callable[[Column], Column], least: int = 3) -> DataFrame:
    """Lines with a form of a word that its draft mostly writes otherwise, with the corpus' form, else the draft's own most
    frequent one (the first by name on ties)."""
    words = lines.select(doc, "line_no", F.explode(T.words(F.col("line"))).alias("form")).withColumn("folded", fold(F.col("form"))).where(F.length("folded") >= least)
    counted = words.groupBy(doc, "folded", "form").agg(F.count("*").alias("n"))
    dominant = counted.groupBy(doc, "folded").agg(F.min(F.struct((-F.col("n")).alias("o"), "form")).alias("_d"), F.count("*").alias("_forms")).where("_forms > 1").select(doc, "folded", F.col("_d.form").alias("_most"))
    if canonical is not None:
        dominant = dominant.join(canonical, "folded", "left")
    else:
        dominant = dominant.withColumn("canonical", F.lit(None).cast("string"))
    minor = words.distinct().join(dominant, [doc, "folded"]).where(F.col("form") != F.col("_most"))
    return minor.select(*D.issue(doc, F.col("line_no"), "diacritic_inconsistency", "suggest", F.col("form"), F.coalesce("canonical", "_most"), False))
