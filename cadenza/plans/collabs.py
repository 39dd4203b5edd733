"""Collaboration, track and upsert queries: conversations as songs, events as frames of tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio as A
from ..operators import collab as B
from ..sources import tracks as K
from .fingerprints import SONGS, songs
from .registry import query

_CATEGORY = "CASE conv_id % 4 WHEN 0 THEN 'x-solo' WHEN 1 THEN 'ana-ivo-duo' WHEN 2 THEN 'Ana-ivo-mia-trio' ELSE 'x-Featured' END"
_CRAFT = {"avg_syllables_per_line": 10, "ttr": 10}
_SIDES = {"solo": "category ILIKE '%solo%'", "collab": "(category ILIKE '%duo%' OR category ILIKE '%trio%' OR category ILIKE '%featured%')"}
_EACH = ", ".join([f"count(*) FILTER ({on}) AS {s}_songs" for s, on in _SIDES.items()] + [f"coalesce(round(avg({c}) FILTER ({on}), 10), 0) AS {s}_{c}" for s, on in _SIDES.items() for c in _CRAFT])


def _songs(t):
    return songs(t).withColumn("category", F.expr(_CATEGORY))


query("e22_craft_comparison", f"WITH RECURSIVE {SONGS}, k AS (SELECT *, {_CATEGORY} AS category FROM songs), g AS (SELECT artist, {_EACH} FROM k GROUP BY artist) SELECT *, " + ", ".join(f"CASE WHEN solo_{c} <> 0 AND collab_{c} <> 0 THEN round(collab_{c} - solo_{c}, 9) END AS delta_{c}" for c in _CRAFT) + " FROM g")(lambda t: B.comparison(_songs(t), "artist", "category", _CRAFT, digits=9))
query("e22_artist_summary", f"WITH RECURSIVE {SONGS}, k AS (SELECT *, {_CATEGORY} AS category FROM songs) SELECT artist, count(*) FILTER ({_SIDES['solo']}) AS solo_songs, count(*) FILTER ({_SIDES['collab']}) AS collab_songs, round(avg(avg_syllables_per_line), 10) AS avg_syllables_per_line, round(avg(ttr), 10) AS avg_ttr FROM k GROUP BY artist HAVING count(*) FILTER ({_SIDES['collab']}) > 0")(lambda t: B.summary(_songs(t), "artist", "category", _CRAFT))

_FILED = f"""cs AS (SELECT conv_id, 'song ' || conv_id AS title, 'A' || conv_id % 7 AS artist, CASE WHEN conv_id % 3 < 2 THEN ['A' || conv_id * 3 % 7, 'B' || conv_id % 5, ''] END AS featured, {_CATEGORY} AS category, CASE conv_id % 3 WHEN 0 THEN 'solo' WHEN 1 THEN 'featured' ELSE 'duo' END AS role, CASE WHEN conv_id % 2 = 0 THEN 'a' || conv_id % 6 END AS target FROM (SELECT DISTINCT conv_id FROM conversations)),
oth AS (SELECT title, role, artist, target, unnest(list_filter(featured, lambda f: f <> '' AND f <> artist)) AS f FROM cs),
ce AS (SELECT title, target AS x, artist AS y FROM cs WHERE role = 'featured' AND target IS NOT NULL
  UNION ALL SELECT title, artist, f FROM oth WHERE role = 'featured' AND target IS NOT NULL OR role = 'solo'
  UNION ALL SELECT title, 'ana', 'ivo' FROM cs WHERE category = 'ana-ivo-duo'
  UNION ALL SELECT title, p, q FROM cs, (VALUES ('Ana', 'ivo'), ('Ana', 'mia'), ('ivo', 'mia')) AS v(p, q) WHERE category = 'Ana-ivo-mia-trio'),
ed AS (SELECT title, least(lower(x), lower(y)) AS a, greatest(lower(x), lower(y)) AS b FROM ce),
pr AS (SELECT a, b, count(*) AS weight FROM ed GROUP BY a, b),
nb AS (SELECT a AS node, b AS other FROM pr UNION SELECT b, a FROM pr)"""


def edges(t):
    each = t.conversations.select("conv_id").distinct()
    name = lambda s, x: F.concat(F.lit(s), x)
    c = F.col("conv_id")
    rows = each.select(
        name("song ", c).alias("title"), name("A", c % 7).alias("artist"), F.when(c % 3 < 2, F.array(name("A", c * 3 % 7), name("B", c % 5), F.lit(""))).alias("featured"), F.expr(_CATEGORY).alias("category"),
        F.when(c % 3 == 0, "solo").when(c % 3 == 1, "featured").otherwise("duo").alias("role"), F.when(c % 2 == 0, name("a", c % 6)).alias("target"))
    return B.edges(rows, "title", "artist", "featured", "category", "role", "target")


query("e23_collab_edges", f"WITH {_FILED} SELECT * FROM pr")(lambda t: B.pairs(edges(t)))
query("e23_collab_centrality", f"WITH {_FILED}, d AS (SELECT node, count(*) AS degree FROM nb GROUP BY node) SELECT node, degree, round(degree / (SELECT max(degree) FROM d), 4) AS centrality FROM d")(lambda t: B.centrality(B.pairs(edges(t))))
query("e23_collab_overview", f"WITH {_FILED} SELECT (SELECT count(DISTINCT node) FROM nb) AS artists, (SELECT count(*) FROM pr) AS edges, (SELECT count(DISTINCT title) FROM ed) AS songs, round(100 * 2 * (SELECT count(*) FROM pr) / ((SELECT count(DISTINCT node) FROM nb) * ((SELECT count(DISTINCT node) FROM nb) - 1)), 4) AS density")(lambda t: B.overview(edges(t)))
query("e23_partners", f"WITH {_FILED}, n2 AS (SELECT a AS node, b AS other, weight FROM pr UNION ALL SELECT b, a, weight FROM pr WHERE a <> b) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS INTEGER) AS rank FROM n2) WHERE rank <= 5")(lambda t: B.partners(B.pairs(edges(t))))
query("c6_collabs_of_any_case", "WITH s AS (SELECT conv_id, list_distinct(list('DJ ' || upper(role))) AS f FROM conversations GROUP BY conv_id) SELECT conv_id FROM s WHERE len(list_filter(f, lambda x: contains(lower(x), 'dj system'))) > 0")(lambda t: _named(t))


def _named(t):
    from ..operators import catalogue

    featured = t.conversations.groupBy("conv_id").agg(F.collect_set(F.concat(F.lit("DJ "), F.upper("role"))).alias("featured")).withColumn("category", F.lit("x"))
    return catalogue.collabs(featured, "category", "featured", F.lit("Dj System")).select("conv_id")


# ---- tracks ----

_COLUMNS = {"value": 1, "ts_s": 1}


def _frames(t):
    return t.events.select("user_id", "event_type", "value", (F.unix_timestamp("ts") % 86400).alias("ts_s"))


def _effects(t):
    """A user's event types as detectors, confident by their share of events."""
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    whole = n.groupBy("user_id").agg(F.sum("n").alias("all"))
    return n.join(whole, "user_id").select("user_id", F.length("event_type").alias("place"), F.col("event_type").alias("effect"), F.round(F.col("n") / F.col("all"), 6).alias("confidence"))


query("e39_spectral_summary", "WITH f AS (SELECT user_id, round(avg(value), 1) AS value, round(avg(epoch(ts) % 86400), 1) AS ts_s FROM (SELECT user_id, value, CAST(floor(epoch(ts)) AS BIGINT) AS e, ts FROM events) GROUP BY user_id), n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT user_id, event_type, length(event_type) AS place, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS c FROM n) SELECT f.user_id, f.value, (SELECT string_agg(event_type, '; ' ORDER BY c DESC, place, event_type) FROM c WHERE c.user_id = f.user_id) AS effects, coalesce((SELECT string_agg(event_type, '; ' ORDER BY c DESC, place, event_type) FROM c WHERE c.user_id = f.user_id AND c > 0.3), '') AS top_effects FROM f")(lambda t: A.summary(_frames(t), _effects(t), ["user_id"], _COLUMNS).drop("ts_s").withColumn("effects", F.array_join(F.transform("effects", lambda e: e["effect"]), "; ")))


def _detectors():
    return [("Loud", lambda f: {"confidence": min(1.0, float(f["value"].max()) / 10)}), ("Never/Works", lambda f: f["no such column"]), ("Long run", lambda f: {"effect": "run", "confidence": min(1.0, len(f) / 200), "params": {"frames": float(len(f))}})]


query("u2_detectors", "WITH g AS (SELECT user_id, max(value) AS m, count(*) AS n FROM events GROUP BY user_id), d AS (SELECT user_id, 0 AS place, 'loud' AS effect, least(1.0, m / 10) AS confidence, '' AS evidence FROM g UNION ALL SELECT user_id, 1, 'never_works', 0.0, 'Error during analysis: ''no such column''' FROM g UNION ALL SELECT user_id, 2, 'run', least(1.0, n / 200.0), '' FROM g) SELECT user_id, place, effect, round(confidence, 6) AS confidence, evidence, CAST(row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, place) AS INTEGER) AS rank FROM d")(lambda t: A.ranked(A.detected(_frames(t), ["user_id"], "ts_s", _detectors()), ["user_id"]).withColumns({"confidence": F.round("confidence", 6), "evidence": F.array_join("evidence", ",")}).drop("params"))

# ---- upserts: customers as what is there, orders' comments as what comes ----

_HAD = "CASE WHEN c_custkey % 3 = 0 THEN 'had' WHEN c_custkey % 3 = 1 THEN ' ' END"
_COMES = "CASE WHEN o_orderkey % 5 < 2 THEN o_orderpriority ELSE '' END"
_UP = f"""ex AS (SELECT c_custkey AS id, {_HAD} AS prompt FROM customer WHERE c_custkey % 2 = 0),
inc AS (SELECT o_custkey AS id, {_COMES} AS prompt, o_orderkey AS n FROM orders),
st AS (SELECT inc.*, ex.id IS NOT NULL AS there, coalesce(trim(ex.prompt) <> '', false) OR coalesce(bool_or(trim(inc.prompt) <> '') OVER (PARTITION BY inc.id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done, row_number() OVER (PARTITION BY inc.id ORDER BY n) AS k FROM inc LEFT JOIN ex ON ex.id = inc.id),
act AS (SELECT *, CASE WHEN done THEN 'skipped' WHEN NOT there AND k = 1 THEN 'saved' ELSE 'updated' END AS action FROM st),
lst AS (SELECT id, arg_max(prompt, k) AS prompt FROM act WHERE action <> 'skipped' GROUP BY id)"""


def _sides(t):
    existing = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.expr(_HAD).alias("prompt"))
    return existing, t.orders.select(F.col("o_custkey").alias("id"), F.expr(_COMES).alias("prompt"), F.col("o_orderkey").alias("n"))


query("d6_upsert_actions", f"WITH {_UP} SELECT id, prompt, n, action FROM act")(lambda t: K.upserted(*_sides(t), "id", "n", "prompt")[1])
query("d6_upserted_table", f"WITH {_UP} SELECT * FROM lst UNION ALL SELECT * FROM ex WHERE id NOT IN (SELECT id FROM lst)")(lambda t: K.upserted(*_sides(t), "id", "n", "prompt")[0])
