"""Collaborations, attribution, loanwords and files, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as K
from ..operators import corpus as C
from .lexical import _SYL, LINES, LOANWORDS, doc_tokens
from .registry import query

_SONGS = "SELECT conv_id, CASE count(DISTINCT role) WHEN 2 THEN 'x-duo' WHEN 3 THEN 'x-Trio' ELSE 'x-solo' END AS category, list(DISTINCT role ORDER BY role) FILTER (role <> 'user') AS featured FROM conversations GROUP BY conv_id"


def _songs(t):
    """Conversations as songs: the category by the number of roles, the roles but ``user`` as featured."""
    n = F.count_distinct("role")
    others = F.sort_array(F.collect_set(F.when(F.col("role") != "user", F.col("role"))))
    return t.conversations.groupBy("conv_id").agg(F.when(n == 2, "x-duo").when(n == 3, "x-Trio").otherwise("x-solo").alias("category"), F.when(F.size(others) > 0, others).alias("featured"))


query("c6_collabs", f"WITH s AS ({_SONGS}) SELECT conv_id, category, CASE WHEN contains(category, 'trio') THEN 'trio' WHEN contains(category, 'duo') THEN 'duo' WHEN len(featured) > 0 THEN 'featured' ELSE 'solo' END AS collab_type FROM s WHERE category ILIKE '%duo%' OR category ILIKE '%trio%' OR featured IS NOT NULL")(lambda t: K.collabs(_songs(t), "category", "featured").select("conv_id", "category", "collab_type"))
query("c6_collabs_of", f"WITH s AS ({_SONGS}) SELECT conv_id, array_to_string(featured, ',') AS featured FROM s WHERE list_contains(featured, 'system')")(lambda t: K.collabs(_songs(t), "category", "featured", F.lit("system")).select("conv_id", F.array_join("featured", ",").alias("featured")))

_TURNS = "each AS (SELECT conv_id, turn, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line FROM conversations)"


@query("e21_attribution", f"WITH {_TURNS}, l AS (SELECT conv_id, turn, count(*) AS line_count, round(avg({_SYL.format('lower(line)')}), 2) AS avg_syllables FROM each GROUP BY ALL) SELECT conv_id, turn, role, coalesce(line_count, 0) AS line_count, coalesce(avg_syllables, 0) AS avg_syllables FROM conversations LEFT JOIN l USING (conv_id, turn)")
def attribution(t):
    lines = C.lines(t.conversations, "text", ["conv_id", "turn"], norm=False)
    return K.attribution(t.conversations.select("conv_id", "turn", "role"), lines, ["conv_id", "turn"])


_CUT = "list_contains(list_transform(range(1, length({0}) + 1), lambda i: substr({0}, 1, i - 1) || substr({0}, i + 1)), {1})"
_NEAR = f"CASE length(w.token) - length(f.token) WHEN 0 THEN len(list_filter(range(1, length(w.token) + 1), lambda i: substr(w.token, i, 1) <> substr(f.token, i, 1))) = 1 WHEN 1 THEN {_CUT.format('w.token', 'f.token')} WHEN -1 THEN {_CUT.format('f.token', 'w.token')} ELSE false END"  # by code points, where levenshtein there goes by bytes


@query("e28_loanwords", f"WITH {LINES}, f AS (SELECT lower(token) AS token, count(*) AS frequency, count(*) FILTER (source = 'src1') AS freq_a, count(*) FILTER (source = 'src2') AS freq_b FROM tokens GROUP BY 1), v AS (SELECT w.token AS word, string_agg(f.token || ':' || f.frequency, ',' ORDER BY f.frequency DESC, f.token) AS variants FROM f w JOIN f ON {_NEAR} WHERE w.token IN {tuple(LOANWORDS)} GROUP BY 1) SELECT f.*, CASE WHEN freq_a > freq_b THEN 'src1' WHEN freq_b > freq_a THEN 'src2' ELSE 'tie' END AS cohort, coalesce(variants, '') AS variants FROM f LEFT JOIN v ON v.word = f.token WHERE f.token IN {tuple(LOANWORDS)}")
def loanwords(t):
    words = t.spark.createDataFrame([(w,) for w in LOANWORDS], "word string")
    named = F.array_join(F.transform("variants", lambda s: F.concat(s["variant"], F.lit(":"), s["frequency"].cast("string"))), ",")
    return K.loanwords(doc_tokens(t), words, "source", "src1", "src2").withColumn("variants", F.coalesce(named, F.lit("")))


query("c7_chosen_files", "SELECT * FROM (SELECT 'trap' AS style, min(p_name) FILTER (contains(lower(p_name), 'widget')) AS file FROM part UNION ALL SELECT 'lofi', min(p_name) FILTER (contains(lower(p_name), 'blue')) FROM part UNION ALL SELECT 'rnb', min(p_name) FILTER (contains(lower(p_name), 'zzz')) FROM part) WHERE file IS NOT NULL")(lambda t: K.chosen_files(t.part, "p_name", [("trap", "Widget"), ("lofi", "BLUE"), ("rnb", "zzz")]))

_KINDS = ["a_analysis.json", "a_voice_analysis.json", "recipe.md", "stems/1.wav", "stems/2.wav", "stems/note.txt", "more/a_analysis.json"]
_PATHS = f"SELECT l_orderkey, list_extract({_KINDS}, CAST(l_linenumber AS INTEGER)) AS path FROM lineitem"


def _tracks(t):
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.col("l_linenumber").cast("int") - 1)
    return K.completeness(t.lineitem.select("l_orderkey", kind.alias("path")), "l_orderkey", "path")


_TRACKS = f"p AS ({_PATHS}), t AS (SELECT l_orderkey, count(*) FILTER (path LIKE 'stems/%.wav') AS stems, count(*) FILTER (path = 'a_voice_analysis.json') > 0 AND count(*) FILTER (path = 'recipe.md') > 0 AND count(*) FILTER (path LIKE 'stems/%.wav') >= 2 AS is_complete FROM p GROUP BY l_orderkey)"
query("d16_completeness", f"WITH {_TRACKS} SELECT * FROM t")(_tracks)


@query("d16_recovered", f"WITH {_TRACKS} SELECT l_orderkey, CASE WHEN o_orderkey IS NULL THEN 'no match' WHEN o_orderstatus = 'F' THEN 'known' WHEN NOT is_complete THEN 'incomplete' ELSE 'recovered' END AS outcome FROM t LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT') ON o_orderkey = l_orderkey")
def recovered(t):
    orders = t.orders.where("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").alias("source"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    return K.recovered(_tracks(t), orders, orders, "l_orderkey", "source").select("l_orderkey", "outcome")
