"""Interval and frame queries over events: a user is a track, event types are states, values are frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import intervals as I
from .registry import query

#: Events with seconds (whole microseconds as a double), and the interval that each opens.
EVENTS = "ev AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), iv AS (SELECT event_id, user_id, event_type, value, t AS s, t + 60 * (1 + event_id % 7) AS e FROM ev)"


def events(t):
    return t.events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def spans(t):
    return events(t).select("event_id", "user_id", "event_type", "value", F.col("t").alias("s"), (F.col("t") + 60 * (1 + F.col("event_id") % 7)).alias("e"))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 3) for n in names})


query("f4_run_length", f"WITH {EVENTS}, m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS nw FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, event_type, round(min(s), 3) AS start, round(max(e), 3) AS \"end\", round(sum(e - s), 3) AS duration, max(value) AS peak, count(*) AS rows FROM r GROUP BY user_id, run, event_type HAVING sum(e - s) >= 100")(lambda t: _round(I.runs(spans(t), ["user_id"], ["s", "event_id"], "event_type", "s", "e", "value", 100), "start", "end", "duration"))
query("f5_merged_intervals", f"WITH {EVENTS}, m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.05 THEN 1 WHEN max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END AS nw FROM iv), r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, CAST(island AS BIGINT) AS island, round(min(s), 3) AS start, round(max(e), 3) AS \"end\", max(value) AS peak, count(*) AS parts FROM r GROUP BY user_id, island HAVING max(value) > 0.3")(lambda t: _round(I.merged(spans(t), ["user_id"], "s", "e", "value", 0.05, 0.3), "start", "end"))
query("f6_survivors")(lambda t: _round(I.survivors(spans(t), ["user_id"], "s", "e", "value"), "start", "end"))
query("f7_gaps", f"WITH {EVENTS}, g AS (SELECT user_id, e AS start, lead(s) OVER (PARTITION BY user_id ORDER BY s, e) AS \"end\" FROM iv) SELECT user_id, round(start, 3) AS start, round(\"end\", 3) AS \"end\", round(\"end\" - start, 3) AS length, round(least(\"end\" - start, 600.0), 3) AS kept FROM g WHERE \"end\" - start >= 60")(lambda t: _round(I.gaps(spans(t), ["user_id"], "s", "e", 60.0, 600.0), "start", "end", "length", "kept"))
_HYST = "x AS (SELECT *, last_value(CASE WHEN value > h THEN 1 WHEN value <= l THEN 0 END IGNORE NULLS) OVER w AS st FROM st0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, coalesce(st, 0) AS o, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nt FROM x), z AS (SELECT *, CASE WHEN o = 1 AND coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY t, event_id), 0) = 0 THEN 1 ELSE 0 END AS b FROM y), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS region FROM z) SELECT user_id, CAST(region AS BIGINT) AS region, round(min(t), 3) AS start, round(max(coalesce(nt, t)), 3) AS \"end\", max(value) AS peak, count(*) AS rows, round(max(coalesce(nt, t)) - min(t), 3) AS duration FROM r WHERE o = 1 GROUP BY user_id, region"
query("f8_spikes", f"WITH {EVENTS}, st0 AS (SELECT *, avg(value) OVER (PARTITION BY user_id) AS l, avg(value) OVER (PARTITION BY user_id) + 2.0 * stddev_pop(value) OVER (PARTITION BY user_id) AS h FROM ev), {_HYST}")(lambda t: _round(I.spikes(events(t), ["user_id"], ["t", "event_id"], "t", "value"), "start", "end", "duration"))
query("f9_threshold_regions", f"WITH {EVENTS}, st0 AS (SELECT *, 0.3 * avg(value) OVER (PARTITION BY user_id) AS h, 0.15 * avg(value) OVER (PARTITION BY user_id) AS l FROM ev), {_HYST}")(lambda t: _regions(t))


def _regions(t):
    mean = F.avg("value").over(Window.partitionBy("user_id"))
    stats = events(t).withColumn("_h", 0.3 * mean).withColumn("_l", 0.15 * mean)
    return _round(I.hysteresis(stats, ["user_id"], ["t", "event_id"], "t", "value", F.col("_h"), F.col("_l")), "start", "end", "duration")


query("f10_tempo", f"WITH {EVENTS}, d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM ev) SELECT user_id, count(*) AS beats, round(avg(60 / d), 6) AS tempo, round(stddev_pop(60 / d), 6) AS stability FROM d WHERE d > 0 GROUP BY user_id")(lambda t: I.tempo(events(t), ["user_id"], "t"))
query("f12_slices", f"WITH {EVENTS}, n AS (SELECT user_id, t, (row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) // 4 AS slice FROM ev), g AS (SELECT user_id, slice, min(t) AS start, count(*) AS beats FROM n GROUP BY ALL) SELECT user_id, CAST(slice AS BIGINT) AS slice, round(start, 3) AS start, beats, round(lead(start) OVER (PARTITION BY user_id ORDER BY slice), 3) AS \"end\" FROM g")(lambda t: _round(I.slices(events(t), ["user_id"], "t", 4), "start", "end"))
query("f13_top_k", "WITH r AS (SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events) SELECT * FROM r WHERE rank <= 10")(lambda t: C.top_k(t.events.select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.asc("event_id")], 10))
query("f14_timeline", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS duration, CAST(coalesce(sum(CAST(l_quantity AS BIGINT) + 200) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lineitem")(lambda t: I.timeline(t.lineitem.withColumn("duration", F.col("l_quantity").cast("long")), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "duration").select("l_orderkey", "l_linenumber", "l_partkey", "duration", "start"))
query("f15_transitions", f"WITH {EVENTS}, e AS (SELECT *, value < 2 AS s, lag(value < 2) OVER w AS p, CASE WHEN lead(value) OVER w IS NULL THEN NULL WHEN abs(lead(value) OVER w - value) > 5 THEN 1 ELSE 0 END AS j FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, count(*) AS frames, CAST(sum(CASE WHEN p <> s THEN 1 ELSE 0 END) AS BIGINT) AS changes, round(coalesce(avg(j), 0), 6) AS jump_share, round(coalesce(var_pop(value) FILTER (s), 0), 6) AS floor_variance FROM e GROUP BY user_id")(lambda t: I.transitions(events(t), ["user_id"], ["t", "event_id"], "value", F.col("value") < 2, 5.0))
query("f16_peaks")(lambda t: I.peaks(events(t), ["user_id"], "t", "value", 5.0, 3))
query("f17_order_violations", "WITH p AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS place FROM conversations), m AS (SELECT *, max(place) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM p) SELECT conv_id, turn, role, place FROM m WHERE place < most")(lambda t: I.order_violations(t.conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).alias("place")), ["conv_id"], "turn", "place"))
query("d9_nearest", f"WITH {EVENTS}, p AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, t AS b FROM ev WHERE event_type = 'view') SELECT event_id, user_id, round(any_value(t), 3) AS t, round(arg_min(b, (round(abs(b - t), 6), b)), 3) AS nearest FROM p LEFT JOIN b USING (user_id) GROUP BY event_id, user_id")(lambda t: _nearest(t))


def _nearest(t):
    e = events(t)
    marks = e.where("event_type = 'view'").select("user_id", F.col("t").alias("b")).distinct()
    return _round(I.nearest(e.where("event_type = 'click'").select("event_id", "user_id", "t"), marks, ["user_id"], "t", "b"), "t", "nearest")


query("d10_range_join", f"WITH {EVENTS} SELECT p.event_id, i.event_id AS span FROM ev p JOIN iv i ON p.user_id = i.user_id AND p.t >= i.s AND p.t < i.e")(lambda t: I.within(events(t).select("event_id", "user_id", "t"), spans(t).select(F.col("event_id").alias("span"), "user_id", "s", "e"), ["user_id"], "t", "s", "e", 120.0).select("event_id", "span"))
query("e33_status", "SELECT event_type AS status, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")(lambda t: t.events.groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")))
query("e41_dynamics", "WITH g AS (SELECT user_id, max(abs(value)) AS p, sqrt(avg(value * value)) AS r, quantile_cont(CASE WHEN abs(value) > 1 THEN abs(value) END, 0.95) AS h, quantile_cont(CASE WHEN abs(value) > 1 THEN abs(value) END, 0.05) AS l, var_pop(abs(value)) AS v FROM events GROUP BY user_id), c AS (SELECT *, CASE WHEN r > 0 THEN 20 * log10(p / r) ELSE 0 END AS c FROM g) SELECT user_id, round(c, 6) AS crest_db, round(h - l, 6) AS dynamic_range, round(v, 6) AS envelope_variance, CASE WHEN c < 6 THEN 0.9 WHEN c < 10 THEN 0.6 WHEN c < 14 THEN 0.3 ELSE 0.1 END AS confidence FROM c")(lambda t: I.dynamics(t.events, ["user_id"], "value", 1.0))
query("e42_media_gate", "WITH g AS (SELECT user_id, count(*) / 10.0 AS d, sqrt(avg(value * value)) AS r, max(abs(value)) AS p FROM events GROUP BY user_id), x AS (SELECT user_id, CASE WHEN d < 0.5 THEN 'too short' WHEN d > 30 THEN 'too long' WHEN r < 5 THEN 'too quiet' WHEN p > 60 THEN 'clipping' END AS reason FROM g) SELECT user_id, reason IS NULL AS is_valid, reason FROM x")(lambda t: I.media_gate(t.events, ["user_id"], "value", 10.0, 0.5, 30, 5, 60))


# ---- events with confidence, slices by onsets and sections, stories ----

_OVER = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
_EDGES = f"ed AS (SELECT *, lag(value) {_OVER} AS last, lead(t) {_OVER} IS NULL AS final FROM st0), es AS (SELECT *, coalesce(last_value(CASE WHEN x > h THEN 1 WHEN {{0}} THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS o FROM ed), ew AS (SELECT *, coalesce(lag(o) {_OVER}, 0) AS w FROM es)"
query("f8_spike_events", f"WITH {EVENTS}, st0 AS (SELECT *, value AS x, avg(value) OVER u AS l, avg(value) OVER u + 2.0 * stddev_pop(value) OVER u AS h FROM ev WINDOW u AS (PARTITION BY user_id)), {_EDGES.format('x < l')}, eb AS (SELECT *, lag(t) {_OVER} AS s FROM ew WHERE o <> w) SELECT user_id, round(s, 3) AS start, round(t, 3) AS \"end\", round(least(1.0, last / (3 * l)), 6) AS confidence, CASE WHEN last / (3 * l) > 0.8 THEN 'high' ELSE 'medium' END AS severity FROM eb WHERE o = 0 AND t - s BETWEEN 0.1 AND 500000 AND least(1.0, last / (3 * l)) > 0.5")(lambda t: _round(I.events(events(t), ["user_id"], ["t", "event_id"], "t", "value", 0.1, 500000.0), "start", "end").withColumn("confidence", F.round("confidence", 6)))


@query("f9_quiet_regions", f"WITH {EVENTS}, nb AS (SELECT *, row_number() {_OVER} AS i FROM ev), nr AS (SELECT *, list({{'i': i, 'x': value}}) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS nr FROM nb), sm AS (SELECT *, list_sum(list_transform(nr, lambda s: exp(-((s.i - i) * (s.i - i)) / 18.0) * s.x)) / list_sum(list_transform(nr, lambda s: exp(-((s.i - i) * (s.i - i)) / 18.0))) AS x FROM nr), st0 AS (SELECT *, 0.9 * avg(x) OVER (PARTITION BY user_id) AS h FROM sm), {_EDGES.format('x <= h / 2')}, eb AS (SELECT *, CASE WHEN o = 1 AND w = 0 THEN t END AS bt, CASE WHEN o = 1 AND w = 0 THEN least(1.0, x / (2 * h)) END AS bc FROM ew WHERE o <> w OR (final AND o = 1)), ee AS (SELECT *, coalesce(bt, lag(bt) {_OVER}) AS s, coalesce(bc, lag(bc) {_OVER}) AS c FROM eb) SELECT user_id, round(s, 3) AS start, round(t, 3) AS \"end\", round(c, 6) AS confidence FROM ee WHERE (o = 0 OR final) AND t - s BETWEEN 0 AND 10000000")
def quiet_regions(t):
    smooth = I.smoothed(events(t), ["user_id"], ["t", "event_id"], "value")
    return _round(I.quiet_regions(smooth, ["user_id"], ["t", "event_id"], "t", "smooth", 0.0, 1e7, 0.9), "start", "end").withColumn("confidence", F.round("confidence", 6))


@query("f12_onset_slices", f"WITH {EVENTS}, tr AS (SELECT user_id, max(t) + 1 AS total FROM ev GROUP BY user_id), ons AS (SELECT user_id, t FROM ev WHERE event_type = 'click'), c AS (SELECT tr.user_id, total, t, count(t) OVER (PARTITION BY tr.user_id) AS n, lead(t) OVER (PARTITION BY tr.user_id ORDER BY t) AS nx, row_number() OVER (PARTITION BY tr.user_id ORDER BY t) AS r FROM tr LEFT JOIN ons USING (user_id)), x AS (SELECT user_id, CASE WHEN n >= 2 THEN t ELSE 0 END AS s, CASE WHEN n >= 2 THEN coalesce(nx, total) ELSE total END AS e FROM c WHERE n >= 2 OR r = 1) SELECT user_id, round(s, 3) AS start, round(e, 3) AS \"end\" FROM x WHERE e > s")
def onset_slices(t):
    e = events(t)
    tracks = e.groupBy("user_id").agg((F.max("t") + 1).alias("total"))
    return _round(I.onset_slices(e.where("event_type = 'click'"), tracks, ["user_id"], "t", "total"), "start", "end")


_SNAPPED = f"WITH {EVENTS}, b AS (SELECT DISTINCT user_id, t AS b FROM ev), se AS (SELECT DISTINCT user_id, s, e, event_type AS label FROM iv WHERE event_type <> 'view'), sn AS (SELECT user_id, label, s, e, arg_min(b, (round(abs(b - s), 6), b)) AS s1, arg_min(b, (round(abs(b - e), 6), b)) AS e1 FROM se JOIN b USING (user_id) GROUP BY ALL)"


def section_slices(t, every):
    e = spans(t).where("event_type <> 'view'").select("user_id", "s", "e", F.col("event_type").alias("label"))
    return _round(I.section_slices(e, events(t), ["user_id"], "s", "e", "label", "t", 600.0, every), "start", "end")


query("f12_section_slices", f"{_SNAPPED} SELECT user_id, label, round(s1, 3) AS start, round(e1, 3) AS \"end\", 1 AS n FROM sn WHERE e1 > s1")(lambda t: section_slices(t, None))
query("f12_section_beats", f"{_SNAPPED}, ins AS (SELECT sn.*, b, row_number() OVER (PARTITION BY user_id, label, s, e ORDER BY b) AS i FROM sn JOIN b USING (user_id) WHERE e1 > s1 AND b >= s1 AND b < e1), pts AS (SELECT user_id, label, s, e, e1, s1 AS c FROM sn WHERE e1 > s1 UNION SELECT user_id, label, s, e, e1, b FROM ins WHERE i % 2 = 0), pc AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY user_id, label, s, e ORDER BY c), e1) AS nx FROM pts) SELECT user_id, label, round(c, 3) AS start, round(nx, 3) AS \"end\", CAST(row_number() OVER (PARTITION BY user_id, label, s, e ORDER BY c) AS INTEGER) AS n FROM pc WHERE nx > c")(lambda t: section_slices(t, 2))

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_ITEMS = f"it AS (SELECT *, CAST(l_quantity * 100 AS BIGINT) AS duration FROM lineitem), old AS (SELECT *, CAST(coalesce(sum(duration + 200) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM it WHERE {{0}})"
_CUT = f"WITH {_ITEMS.format('true')}, cut AS (SELECT l_orderkey, l_linenumber, duration, start, 100 AS head, 200 AS tail, l_linenumber * 700 AS pos FROM old), inside AS (SELECT *, pos > 0 AND pos < duration - head - tail AS ok FROM cut), parts AS (SELECT l_orderkey, l_linenumber, duration, start, head, CASE WHEN ok THEN duration - head - pos ELSE tail END AS tail, 0 AS part FROM inside UNION ALL SELECT l_orderkey, l_linenumber, duration, start + pos, head + pos, tail, 1 FROM inside WHERE ok)"


def items(t):
    return t.lineitem.withColumn("duration", (F.col("l_quantity") * 100).cast("long"))


def halves(t):
    laid = I.timeline(items(t), ["l_orderkey"], _ORDER, "duration").withColumns({"head": F.lit(100).cast("long"), "tail": F.lit(200).cast("long")})
    return I.split(laid, "start", "duration", "head", "tail", F.col("l_linenumber") * 700).select("l_orderkey", "l_linenumber", "duration", "start", "head", "tail", "part")


@query("f14_appended", f"WITH {_ITEMS.format(chr(39) + 'F' + chr(39) + ' = l_linestatus')}, mx AS (SELECT l_orderkey, max(start + duration) AS last FROM old GROUP BY l_orderkey) SELECT l_orderkey, l_linenumber, l_partkey, duration, CAST(coalesce(last + 200, 0) + coalesce(sum(duration + 200) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM it LEFT JOIN mx USING (l_orderkey) WHERE l_linestatus <> 'F'")
def appended(t):
    old = I.timeline(items(t).where("l_linestatus = 'F'"), ["l_orderkey"], _ORDER, "duration")
    return I.appended(old, items(t).where("l_linestatus <> 'F'"), ["l_orderkey"], _ORDER, "start", "duration").select("l_orderkey", "l_linenumber", "l_partkey", "duration", "start")


query("f14_split", f"{_CUT} SELECT * FROM parts")(halves)
query("f14_story_length", f"{_CUT} SELECT l_orderkey, count(*) AS items, CAST(max(start + duration - head - tail) AS BIGINT) AS total FROM parts GROUP BY l_orderkey")(lambda t: I.story_length(halves(t), ["l_orderkey"], "start", "duration", "head", "tail"))
query("f14_trimmed", f"{_CUT}, tr AS (SELECT *, head + 900 + tail + 300 < duration AS changed FROM parts) SELECT l_orderkey, l_linenumber, part, CASE WHEN changed THEN head + 900 ELSE head END AS head, CASE WHEN changed THEN tail + 300 ELSE tail END AS tail, changed FROM tr")(lambda t: I.trimmed(halves(t), "duration", "head", "tail", F.col("head") + 900, F.col("tail") + 300).select("l_orderkey", "l_linenumber", "part", "head", "tail", "changed"))
