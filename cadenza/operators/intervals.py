"""Sequences, frames and intervals as window expressions: merges, gaps, nearest and range joins, timelines.

``key`` columns name a track; ``start`` and ``end`` are numbers (seconds).  Each operator sorts once by track.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: list[str], *order: str | Column):
    return Window.partitionBy(*key).orderBy(*order)


def runs(df: DataFrame, key: list[str], order: list[str], state: str, start: str, end: str, value: str, least: float = 0.0) -> DataFrame:
    """Equal neighbours as one row: state, start, end, duration, peak (largest value), rows; shorter than ``least`` go."""
    w = _by(key, *order)
    marked = df.withColumn("_new", F.coalesce((F.lag(state).over(w) != F.col(state)).cast("int"), F.lit(1)))
    marked = marked.withColumn("run", F.sum("_new").over(w))
    out = marked.groupBy(*key, "run", state).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.sum(F.col(end) - F.col(start)).alias("duration"), F.max(value).alias("peak"), F.count("*").alias("rows"))
    return out.where(F.col("duration") >= least)


def merged(df: DataFrame, key: list[str], start: str, end: str, value: str, tolerance: float = 0.05, least: float | None = None) -> DataFrame:
    """Overlapping or nearly touching intervals as one, with their largest value; then those over ``least``."""
    before = _by(key, start, end).rowsBetween(Window.unboundedPreceding, -1)
    gap = F.coalesce(F.col(start) > F.max(end).over(before) + tolerance, F.lit(True))
    marked = df.withColumn("_new", gap.cast("int")).withColumn("island", F.sum("_new").over(_by(key, start, end).rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*key, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.max(value).alias("peak"), F.count("*").alias("parts"))
    return out if least is None else out.where(F.col("peak") > least)


def survivors(df: DataFrame, key: list[str], start: str, end: str, rank: str, tolerance: float = 0.01) -> DataFrame:
    """Of overlapping events the one of higher rank survives, and its own end is what the next is compared with.

    The order matters, so each track is folded over its sorted events (a track's events fit in a task).
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for row in pdf.sort_values([start, end, rank]).itertuples(index=False):
            a, b, r = getattr(row, start), getattr(row, end), getattr(row, rank)
            if out and a <= out[-1][1] + tolerance:
                if r > out[-1][2]:
                    out[-1] = (a, b, r)
            else:
                out.append((a, b, r))
        got = pd.DataFrame(out, columns=["start", "end", "priority"])
        for k in reversed(key):
            got.insert(0, k, pdf[k].iloc[0])
        return got

    return df.select(*key, start, end, rank).groupBy(*key).applyInPandas(fold, f"{kinds}, start double, end double, priority double")


def gaps(df: DataFrame, key: list[str], start: str, end: str, least: float, most: float) -> DataFrame:
    """The pauses between intervals of at least ``least``: start, end, length, kept (at most ``most`` of it)."""
    following = F.lead(start).over(_by(key, start, end))
    out = df.select(*key, F.col(end).alias("start"), following.alias("end")).withColumn("length", F.col("end") - F.col("start"))
    return out.where(F.col("length") >= least).withColumn("kept", F.least(F.col("length"), F.lit(most)))


def hysteresis(df: DataFrame, key: list[str], order: list[str], time: str, value: str, high: Column, low: Column) -> DataFrame:
    """Regions that open above ``high`` and close at or below ``low``: start, end, duration, peak, rows."""
    w = _by(key, *order)
    state = F.last(F.when(F.col(value) > high, 1).when(F.col(value) <= low, 0), True).over(w)
    marked = df.withColumn("_open", F.coalesce(state, F.lit(0)))
    marked = marked.withColumn("_start", ((F.col("_open") == 1) & (F.coalesce(F.lag("_open").over(w), F.lit(0)) == 0)).cast("int")).withColumn("region", F.sum("_start").over(w)).withColumn("_next", F.lead(time).over(w))
    inside = marked.where("_open = 1").groupBy(*key, "region").agg(F.min(time).alias("start"), F.max(F.coalesce("_next", F.col(time))).alias("end"), F.max(value).alias("peak"), F.count("*").alias("rows"))
    return inside.withColumn("duration", F.col("end") - F.col("start"))


def spikes(df: DataFrame, key: list[str], order: list[str], time: str, value: str, sigmas: float = 2.0) -> DataFrame:
    """Regions that open above mean + sigmas * std of their track and close at its mean."""
    w = Window.partitionBy(*key)
    stats = df.withColumn("_m", F.avg(value).over(w)).withColumn("_h", F.col("_m") + sigmas * F.stddev_pop(value).over(w))
    return hysteresis(stats, key, order, time, value, F.col("_h"), F.col("_m"))


def events(df: DataFrame, key: list[str], order: list[str], time: str, value: str, shortest: float = 0.1, longest: float = 0.5, sigmas: float = 2.0, least: float = 0.5, sure: float = 0.8) -> DataFrame:
    """Short spikes: start, end, confidence, severity of what opens above mean + sigmas * std of its track, closes below
    the mean and lasts ``shortest`` to ``longest``.

    The end is the closing frame's time; what is open at the end of a track is no event.  Confidence is the value of the
    frame before it over three means, 1 at most and more than ``least``; severity is high above ``sure``, else medium.
    """
    whole, w = Window.partitionBy(*key), _by(key, *order)
    x = F.col(value)
    stats = df.withColumn("_m", F.avg(value).over(whole)).withColumn("_h", F.col("_m") + sigmas * F.stddev_pop(value).over(whole))
    state = F.coalesce(F.last(F.when(x > F.col("_h"), 1).when(x < F.col("_m"), 0), True).over(w), F.lit(0))
    marked = stats.withColumn("_open", state).withColumn("_was", F.coalesce(F.lag("_open").over(w), F.lit(0)))
    edges = marked.withColumn("_last", F.lag(x).over(w)).where(F.col("_open") != F.col("_was"))
    both = edges.withColumn("_start", F.lag(time).over(w)).where("_open = 0")
    confidence = F.least(F.lit(1.0), F.col("_last") / (3 * F.col("_m")))
    out = both.select(*key, F.col("_start").alias("start"), F.col(time).alias("end"), confidence.alias("confidence"))
    kept = out.where((F.col("end") - F.col("start")).between(shortest, longest) & (F.col("confidence") > least))
    return kept.withColumn("severity", F.when(F.col("confidence") > sure, "high").otherwise("medium"))


def smoothed(df: DataFrame, key: list[str], order: list[str], value: str, sigma: float = 3.0, reach: float = 4.0, name: str = "smooth") -> DataFrame:
    """A Gaussian mean over ``reach`` * sigma frames to each side; at a track's ends over the frames that it has."""
    radius = int(reach * sigma + 0.5)
    w = _by(key, *order)
    numbered = df.withColumn("_i", F.row_number().over(w))
    near = F.collect_list(F.struct("_i", F.col(value).cast("double").alias("x"))).over(_by(key, *order).rowsBetween(-radius, radius))
    weight = lambda s: F.exp(-(s["_i"] - F.col("_i")) * (s["_i"] - F.col("_i")) / (2 * sigma * sigma))
    sums = F.aggregate(F.filter("_near", lambda s: s["x"].isNotNull()), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda a, s: F.struct((a["a"] + weight(s) * s["x"]).alias("a"), (a["b"] + weight(s)).alias("b")), lambda a: F.when(a["b"] > 0, a["a"] / a["b"]))
    return numbered.withColumn("_near", near).withColumn(name, sums).drop("_i", "_near")


def quiet_regions(df: DataFrame, key: list[str], order: list[str], time: str, value: str, shortest: float, longest: float, share: float = 0.3) -> DataFrame:
    """start, end, confidence of the regions that open above ``share`` of their track's mean and close at half of that or
    below, or at the track's last frame, and last ``shortest`` to ``longest``.

    Confidence is the opening frame's value over twice the opening threshold, 1 at most.
    """
    whole, w = Window.partitionBy(*key), _by(key, *order)
    x, high = F.col(value), F.col("_h")
    stats = df.withColumn("_h", share * F.avg(value).over(whole))
    state = F.coalesce(F.last(F.when(x > high, 1).when(x <= high / 2, 0), True).over(w), F.lit(0))
    marked = stats.withColumn("_open", state).withColumn("_was", F.coalesce(F.lag("_open").over(w), F.lit(0))).withColumn("_final", F.lead(time).over(w).isNull())
    edges = marked.where((F.col("_open") != F.col("_was")) | (F.col("_final") & (F.col("_open") == 1)))
    opens = (F.col("_open") == 1) & (F.col("_was") == 0)
    begun = F.when(opens, F.struct(F.col(time).alias("t"), F.least(F.lit(1.0), x / (2 * high)).alias("c")))
    # The edge before a closing one opened it; a track's last frame may open, close or end a region.
    ended = edges.withColumn("_b", begun).withColumn("_b", F.coalesce("_b", F.lag("_b").over(w))).where((F.col("_open") == 0) | F.col("_final"))
    out = ended.select(*key, F.col("_b.t").alias("start"), F.col(time).alias("end"), F.col("_b.c").alias("confidence"))
    return out.where((F.col("end") - F.col("start")).between(shortest, longest))


def tempo(df: DataFrame, key: list[str], time: str) -> DataFrame:
    """Per track: beats, mean tempo (60 over the distance of beats) and its population deviation."""
    each = df.withColumn("_d", F.col(time) - F.lag(time).over(_by(key, time))).where("_d > 0").withColumn("_t", 60 / F.col("_d"))
    return each.groupBy(*key).agg(F.count("*").alias("beats"), F.round(F.avg("_t"), 6).alias("tempo"), F.round(F.stddev_pop("_t"), 6).alias("stability"))


def pattern(df: DataFrame, key: list[str], order: str, x: str, near: float = 1.0, apart: float = 2.0) -> DataFrame:
    """uniform, alternating, accelerating, decelerating or free: the shape of a sequence, in this order of rules."""
    w = _by(key, order)
    sized = df.withColumn("_i", F.row_number().over(w)).withColumn("_d", F.col(x) - F.lag(x).over(w)).withColumn("_m", F.avg(x).over(Window.partitionBy(*key)))
    g = sized.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.abs(F.col(x) - F.col("_m"))).alias("spread"), F.avg(F.when(F.col("_i") % 2 == 1, F.col(x))).alias("odd"), F.avg(F.when(F.col("_i") % 2 == 0, F.col(x))).alias("even"), F.min("_d").alias("least"), F.max("_d").alias("most"))
    kind = F.when(F.col("n") < 2, "free").when(F.col("spread") <= near, "uniform").when(F.abs(F.col("odd") - F.col("even")) >= apart, "alternating").when(F.col("least") >= 0, "accelerating").when(F.col("most") <= 0, "decelerating").otherwise("free")
    return g.select(*key, "n", kind.alias("pattern"))


def slices(df: DataFrame, key: list[str], time: str, every: int) -> DataFrame:
    """Every ``every`` beats as one slice: slice, start, beats, and the next slice's start as end (null on the last)."""
    numbered = df.withColumn("slice", F.floor((F.row_number().over(_by(key, time)) - 1) / every))
    out = numbered.groupBy(*key, "slice").agg(F.min(time).alias("start"), F.count("*").alias("beats"))
    return out.withColumn("end", F.lead("start").over(_by(key, "slice")))


def onset_slices(onsets: DataFrame, tracks: DataFrame, key: list[str], time: str, total: str) -> DataFrame:
    """start, end of each slice from an onset to the next, the last to the track's end; a track of fewer than two onsets
    is one slice, and slices without length go.

    ``tracks``: key and total, the end of each; onsets of other tracks go.
    """
    whole = Window.partitionBy(*key)
    each = tracks.select(*key, F.col(total).alias("_end")).join(onsets.select(*key, F.col(time).alias("_t")), key, "left")
    cut = each.withColumn("_n", F.count("_t").over(whole)).withColumn("_next", F.lead("_t").over(_by(key, "_t"))).withColumn("_r", F.row_number().over(_by(key, "_t")))
    some = F.col("_n") >= 2
    out = cut.where(some | (F.col("_r") == 1)).select(*key, F.when(some, F.col("_t")).otherwise(F.lit(0)).alias("start"), F.when(some, F.coalesce("_next", "_end")).otherwise(F.col("_end")).alias("end"))
    return out.where("end > start")


def section_slices(sections: DataFrame, beats: DataFrame, key: list[str], start: str, end: str, label: str, time: str, width: float, every: int | None = None) -> DataFrame:
    """label, start, end, n (from 1 in its section): sections with both ends moved to the nearest beat of their track (the
    earlier on ties; none moves in a track without beats), cut at every ``every``-th beat inside; those without length go, equal ones are one.

    ``width``: the bucket of the range join of beats with sections, about a section's length.
    """
    named = sections.withColumn("_id", F.struct(start, end, label))
    marks = beats.select(*key, F.col(time).alias("_beat")).distinct()
    ends = named.select(*key, "_id", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col(start).alias("at")), F.struct(F.lit(1).alias("which"), F.col(end).alias("at")))).alias("_e")).select(*key, "_id", "_e.which", "_e.at")
    moved = nearest(ends, marks, key, "at", "_beat")
    at = lambda k: F.max(F.when(F.col("which") == k, F.coalesce("nearest", "at")))
    snapped = moved.groupBy(*key, "_id").agg(at(0).alias("_start"), at(1).alias("_stop")).where("_stop > _start")
    if not every:
        return snapped.select(*key, F.col("_id")[label].alias(label), F.col("_start").alias("start"), F.col("_stop").alias("end"), F.lit(1).alias("n"))
    inside = within(marks, snapped, key, "_beat", "_start", "_stop", width)
    unit = [*key, "_id", "_start", "_stop"]
    cuts = inside.withColumn("_i", F.row_number().over(_by(unit, "_beat"))).where(F.col("_i") % every == 0).select(*unit, F.col("_beat").alias("_cut"))
    points = snapped.select(*unit, F.col("_start").alias("_cut")).unionByName(cuts).distinct()
    pieces = points.withColumn("_to", F.coalesce(F.lead("_cut").over(_by(unit, "_cut")), F.col("_stop"))).where("_to > _cut")
    return pieces.select(*key, F.col("_id")[label].alias(label), F.col("_cut").alias("start"), F.col("_to").alias("end"), F.row_number().over(_by(unit, "_cut")).alias("n"))


def timeline(df: DataFrame, key: list[str], order: list[str], duration: str, gap: int = 200) -> DataFrame:
    """Items laid end to end with a gap: start is the sum of what lies before."""
    before = _by(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(F.col(duration) + gap).over(before), F.lit(0)))


def appended(items: DataFrame, new: DataFrame, key: list[str], order: list[str], start: str, duration: str, gap: int = 200) -> DataFrame:
    """New items with their start: one after the other, each a gap after the latest end so far (0 in an empty story).

    An item ends at its start and its whole duration, trimmed or not.
    """
    last = items.groupBy(*key).agg(F.max(F.col(start) + F.col(duration)).alias("_end"))
    laid = timeline(new.drop(start), key, order, duration, gap).withColumnRenamed("start", "_before")
    return laid.join(last, key, "left").withColumn(start, F.coalesce(F.col("_end") + gap, F.lit(0)) + F.col("_before")).drop("_end", "_before")


def trimmed(items: DataFrame, duration: str, head: str, tail: str, new_head: Column, new_tail: Column) -> DataFrame:
    """Items with new trims where these leave something (and are no less than 0); others keep theirs.  ``changed`` says which."""
    valid = F.coalesce((new_head >= 0) & (new_tail >= 0) & (new_head + new_tail < F.col(duration)), F.lit(False))
    out = items.withColumn("_new", F.when(valid, F.struct(new_head.alias("a"), new_tail.alias("b")))).withColumn("changed", valid)
    return out.withColumns({head: F.coalesce("_new.a", head), tail: F.coalesce("_new.b", tail)}).drop("_new")


def split(items: DataFrame, start: str, duration: str, head: str, tail: str, at: Column) -> DataFrame:
    """Items cut ``at`` a time in what is heard of them, as two rows (``part`` 0 and 1); where it does not lie inside, or
    is null, the item stays whole (part 0)."""
    heard = F.col(duration) - F.col(head) - F.col(tail)
    cut = F.col(head) + at
    fields = lambda s, h, t, k: F.struct(s.alias(start), h.alias(head), t.alias(tail), F.lit(k).alias("part"))
    whole = F.array(fields(F.col(start), F.col(head), F.col(tail), 0))
    two = F.array(fields(F.col(start), F.col(head), F.col(duration) - cut, 0), fields(F.col(start) + at, cut, F.col(tail), 1))
    rows = items.withColumn("_p", F.explode(F.when((at > 0) & (at < heard), two).otherwise(whole)))
    return rows.withColumns({c: F.col(f"_p.{c}") for c in (start, head, tail, "part")}).drop("_p")


def story_length(items: DataFrame, key: list[str], start: str, duration: str, head: str, tail: str) -> DataFrame:
    """key, items, total: where the last of what is heard ends."""
    heard = F.col(duration) - F.col(head) - F.col(tail)
    return items.groupBy(*key).agg(F.count("*").alias("items"), F.max(F.col(start) + heard).alias("total"))


def transitions(df: DataFrame, key: list[str], order: list[str], value: str, silent: Column, jump: float) -> DataFrame:
    """Per track: frames, changes between silent and not, share of jumps over ``jump``, variance of the silent floor."""
    w = _by(key, *order)
    each = df.withColumn("_s", silent).withColumn("_c", F.coalesce((F.lag("_s").over(w) != F.col("_s")).cast("int"), F.lit(0))).withColumn("_j", (F.abs(F.lead(value).over(w) - F.col(value)) > jump).cast("int"))
    return each.groupBy(*key).agg(F.count("*").alias("frames"), F.sum("_c").alias("changes"), F.round(F.coalesce(F.avg("_j"), F.lit(0.0)), 6).alias("jump_share"), F.round(F.coalesce(F.var_pop(F.when(F.col("_s"), F.col(value))), F.lit(0.0)), 6).alias("floor_variance"))


def peaks(df: DataFrame, key: list[str], order: str, value: str, height: float, spacing: int) -> DataFrame:
    """Local maxima of at least ``height`` that are ``spacing`` places apart, higher ones first (ties: earlier first)."""
    w = _by(key, order)
    numbered = df.withColumn("place", F.row_number().over(w)).withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    local = numbered.where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= height)).select(*key, "place", F.col(value).alias("peak"))
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key)

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        import bisect

        taken: list[int] = []
        keep = []
        for row in pdf.sort_values(["peak", "place"], ascending=[False, True]).itertuples():
            k = bisect.bisect(taken, row.place)
            if all(abs(row.place - p) >= spacing for p in taken[max(0, k - 1) : k + 1]):
                taken.insert(k, row.place)
                keep.append(row.Index)
        return pdf.loc[keep]

    return local.groupBy(*key).applyInPandas(chosen, f"{kinds}, place int, peak double")


def order_violations(df: DataFrame, key: list[str], order: str, place: str) -> DataFrame:
    """Rows whose expected place is before that of a row above them."""
    before = _by(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_most", F.max(place).over(before)).where(F.col(place) < F.col("_most")).drop("_most")


def nearest(points: DataFrame, marks: DataFrame, key: list[str], point: str, mark: str) -> DataFrame:
    """Each point with the nearest mark of its track, the earlier on ties: one sort of both together, no join."""
    rows = points.withColumn("_p", F.col(point)).withColumn("_k", F.lit(1)).unionByName(marks.select(*key, F.col(mark).alias("_p"), F.col(mark).alias("_mark")).withColumn("_k", F.lit(0)), True)
    w = Window.partitionBy(*key).orderBy("_p", "_k")
    ahead = Window.partitionBy(*key).orderBy(F.col("_p"), F.desc("_k")).rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumn("_a", F.last("_mark", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_mark", True).over(ahead)).where("_k = 1")
    earlier = F.col("_b").isNull() | (F.col(point) - F.col("_a") <= F.col("_b") - F.col(point))
    return out.select(*points.columns, F.when(F.col("_a").isNotNull() & earlier, F.col("_a")).otherwise(F.col("_b")).alias("nearest"))


def within(points: DataFrame, spans: DataFrame, key: list[str], point: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the spans [start, end) that hold them: equi-join on buckets of ``width`` and a range filter."""
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("_b", F.floor(F.col(point) / width)).join(cut, [*key, "_b"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_b")


def dynamics(df: DataFrame, key: list[str], value: str, silent: float) -> DataFrame:
    """Per track: crest factor in dB, 95th less 5th percentile of what is over ``silent``, variance, and a class."""
    loud = F.when(F.abs(value) > silent, F.abs(value))
    g = df.groupBy(*key).agg(F.max(F.abs(value)).alias("_p"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_r"), F.percentile(loud, F.lit(0.95)).alias("_h"), F.percentile(loud, F.lit(0.05)).alias("_l"), F.var_pop(F.abs(value)).alias("_v"))
    crest = F.when(F.col("_r") > 0, 20 * F.log10(F.col("_p") / F.col("_r"))).otherwise(0.0)
    confidence = F.when(crest < 6, 0.9).when(crest < 10, 0.6).when(crest < 14, 0.3).otherwise(0.1)
    return g.select(*key, F.round(crest, 6).alias("crest_db"), F.round(F.col("_h") - F.col("_l"), 6).alias("dynamic_range"), F.round("_v", 6).alias("envelope_variance"), confidence.alias("confidence"))


def media_gate(df: DataFrame, key: list[str], value: str, rate: float, shortest: float, longest: float, rms: float, peak: float) -> DataFrame:
    """is_valid and the first rule that fails: too short, too long, too quiet, clipping."""
    g = df.groupBy(*key).agg((F.count("*") / rate).alias("_d"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_r"), F.max(F.abs(value)).alias("_p"))
    reason = F.when(F.col("_d") < shortest, "too short").when(F.col("_d") > longest, "too long").when(F.col("_r") < rms, "too quiet").when(F.col("_p") > peak, "clipping")
    return g.select(*key, reason.isNull().alias("is_valid"), reason.alias("reason"))
