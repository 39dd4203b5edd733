"""Summaries of tracks from their frames: spectral means, and detectors run by name."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of the spectral means.
SPECTRUM = {"centroid": 1, "bandwidth": 1, "rolloff": 1, "flatness": 4}
EFFECT = "place int, effect string, confidence double, params map<string,double>, evidence array<string>"


def spectral_profile(frames: DataFrame, key: list[str], columns: dict[str, int] | None = None) -> DataFrame:
    """Means over a track's frames, rounded as ``columns`` says (half up).

    Values are added as decimals of ten digits, so that neither the order of the frames nor the sum's error decides a
    mean that lies on a half; a track with a value that is none (not finite, over 1e18) has the mean of its doubles.
    """

    def mean(c: str, digits: int) -> Column:
        exact = F.col(c).try_cast("decimal(28,10)")
        return F.when(F.count(exact) == F.count(c), F.round(F.avg(exact), digits).cast("double")).otherwise(F.round(F.avg(F.col(c).cast("double")), digits))

    return frames.groupBy(*key).agg(*(mean(c, d).alias(c) for c, d in (columns or SPECTRUM).items()))


def effect_lists(effects: DataFrame, key: list[str], least: float = 0.3) -> DataFrame:
    """A row a track: its effects by falling confidence (equal ones in the order of their detectors), and the names of
    those over ``least``.  A track has as many effects as there are detectors."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("_o"), "place", "effect", "confidence")))
    each = effects.groupBy(*key).agg(F.transform(ordered, lambda s: F.struct(s["effect"].alias("effect"), s["confidence"].alias("confidence"))).alias("effects"))
    names = F.transform(F.filter("effects", lambda e: e["confidence"] > least), lambda e: e["effect"])
    return each.withColumn("top_effects", F.array_join(names, "; "))


def summary(frames: DataFrame, effects: DataFrame, key: list[str], columns: dict[str, int] | None = None, least: float = 0.3) -> DataFrame:
    """Spectral means and effects of every track that has frames; a track without effects has an empty list."""
    kind = "array<struct<effect:string,confidence:double>>"
    out = spectral_profile(frames, key, columns).join(effect_lists(effects, key, least), key, "left")
    return out.withColumn("effects", F.coalesce(F.col("effects").cast(kind), F.array().cast(kind))).fillna("", ["top_effects"])


def detected(frames: DataFrame, key: list[str], order: str, detectors: list[tuple[str, Callable[[pd.DataFrame], dict]]]) -> DataFrame:
    """key, place, effect, confidence, params, evidence: every detector in its order over each track's frames.

    A detector takes a track's frames in order and gives ``effect``, ``confidence``, ``params``, ``evidence`` (all but the
    confidence may lack).  One that fails is a row of confidence 0 that says why; the others run on.  A track's frames
    come to one task.
    """
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows = pdf.sort_values(order, kind="stable").reset_index(drop=True), []
        owner = [pdf[k].iloc[0] for k in key]
        for place, (name, detector) in enumerate(detectors):
            plain = name.lower().replace("/", "_").replace(" ", "_")
            try:
                found = detector(pdf)
                rows.append((*owner, place, found.get("effect", plain), float(found["confidence"]), found.get("params", {}), found.get("evidence", [])))
            except Exception as e:  # a detector may raise anything
                rows.append((*owner, place, plain, 0.0, {}, [f"Error during analysis: {e}"]))
        return pd.DataFrame(rows, columns=[*key, "place", "effect", "confidence", "params", "evidence"])

    return frames.groupBy(*key).applyInPandas(run, f"{kinds}, {EFFECT}")


def ranked(effects: DataFrame, key: list[str]) -> DataFrame:
    """``detected`` with ``rank`` by falling confidence, equal ones in their order."""
    from .corpus import top_k

    return top_k(effects, key, [F.desc("confidence"), F.asc("place")], 1 << 30)
