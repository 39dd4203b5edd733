"""Library searches, cohorts and categories of songs, and summaries, over parts, orders, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators import library as L
from .lexical import _LEX, LOANWORDS, lexicon
from .registry import query


def tagged(t):
    return t.part.withColumn("tags", F.split("p_type", " "))


_SEARCH = "contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND p_size BETWEEN 5 AND 40 AND list_has_any(string_split(p_type, ' '), ['SMALL', 'ECONOMY', 'TIN'])"
query("c2_search_any", f"SELECT p_partkey, p_name FROM part WHERE ({_SEARCH}")(lambda t: L.search(tagged(t), "RING", ("p_name", "p_brand"), ranges={"p_size": (5, 40)}, tags=["SMALL", "ECONOMY", "TIN"]).select("p_partkey", "p_name"))
query("c2_search_brand", f"SELECT p_partkey, p_name FROM part WHERE ({_SEARCH} AND p_brand = 'Brand#13'")(lambda t: L.search(tagged(t), "ring", ("p_name", "p_brand"), ranges={"p_size": (5, 40)}, tags=["SMALL", "ECONOMY", "TIN"], equal={"p_brand": "Brand#13"}).select("p_partkey", "p_name"))
query("c2_facets", "SELECT 'p_brand' AS facet, p_brand AS value FROM part GROUP BY ALL UNION SELECT 'tags', unnest(string_split(p_type, ' ')) FROM part")(lambda t: L.facets(tagged(t), ["p_brand", "tags"]))
query("c3_history_page", "WITH h AS (SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name LIKE '%0001%') SELECT o_orderkey, c_name, (SELECT count(*) FROM h) AS total FROM h ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 10")(lambda t: L.page(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where(F.col("c_name").like("%0001%")), [F.desc("o_orderdate"), F.asc("o_orderkey")], 10, 20).select("o_orderkey", "c_name", "total"))
_SONGS = "so AS (SELECT doc_id, CASE lang WHEN 'en' THEN source ELSE upper(source) || ' & ' || lang END AS artist, CASE lang WHEN 'de' THEN 'duo' ELSE 'solo' END AS role, upper(lang) AS target FROM documents)"


@query("b13_cohorts", f"WITH {_SONGS} SELECT doc_id, coalesce(CASE artist WHEN 'src1' THEN 'north' WHEN 'src2' THEN 'south' END, CASE WHEN role = 'solo' THEN coalesce(CASE WHEN contains(lower(artist), 'src1') THEN 'north' WHEN contains(lower(artist), 'src2') THEN 'south' END, CASE lower(target) WHEN 'fr' THEN 'west' END) END) AS cohort FROM so")
def cohorts(t):
    songs = t.documents.select("doc_id", F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat(F.upper("source"), F.lit(" & "), "lang")).alias("artist"), F.when(F.col("lang") == "de", "duo").otherwise("solo").alias("role"), F.upper("lang").alias("target"))
    return L.cohorts(songs, "artist", "role", "target", {"src1": "north", "src2": "south"}, {"fr": "west"}).select("doc_id", "cohort")


query("b29_categories", "SELECT p_partkey, CASE WHEN a AND b THEN 'duo' WHEN a THEN 'small' WHEN b THEN 'metal' ELSE 'other' END AS category FROM (SELECT p_partkey, list_has_any(string_split(lower(p_type), ' '), ['small', 'economy']) AS a, list_has_any(string_split(lower(p_type), ' '), ['tin', 'steel']) AS b FROM part)")(lambda t: tagged(t).select("p_partkey", L.category(F.col("tags"), {"a": ["small", "economy"], "b": ["tin", "steel"]}, {("a", "b"): "duo", ("a",): "small", ("b",): "metal"}, "other").alias("category")))
query("b18_description", "SELECT p_partkey, CASE WHEN length(p_type) > 20 THEN p_type ELSE coalesce(p_name, '') END AS description FROM part")(lambda t: t.part.select("p_partkey", L.description(F.col("p_type"), F.col("p_name")).alias("description")))


@query("d7_overlap_by_side", f"{_LEX}, b AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM benchmark) GROUP BY token), j AS (SELECT CASE WHEN distinctiveness > 0.5 THEN 'a' ELSE 'b' END AS side, token, n FROM b JOIN lex USING (token) WHERE abs(distinctiveness) > 0.5), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, token) AS r FROM j) SELECT s.side, count(token) AS forms, round(coalesce(100 * sum(n) / (SELECT sum(n) FROM b), 0), 2) AS percent, coalesce(string_agg(token, ',' ORDER BY r) FILTER (r <= 20), '') AS top FROM (VALUES ('a'), ('b')) s(side) LEFT JOIN r ON r.side = s.side GROUP BY s.side")
def overlap(t):
    n = C.tokens(C.lines(t.benchmark, "text", ["item_id"], norm=False), ["item_id"]).groupBy("token").agg(F.count("*").alias("n"))
    return L.overlap(n, "token", "n", lexicon(t), "token", "distinctiveness").withColumn("top", F.array_join("top", ","))


_TEXTS = rf"""tw AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents)),
wn AS (SELECT doc_id, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(p)) AS r FROM tw GROUP BY doc_id, word),
wt AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, count(*) AS unique_words, sum(n) FILTER (word IN {tuple(LOANWORDS)}) AS en, string_agg(word || ':' || n, ',' ORDER BY r) FILTER (r <= 20) AS top_words FROM wn GROUP BY doc_id),
tl AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
ln AS (SELECT doc_id, line, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(p)) AS r FROM tl WHERE regexp_matches(line, '\S') GROUP BY doc_id, line),
lt AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS lines, sum(n * length(line)) / sum(n) AS c, max(length(line)) AS m, sum(n * len(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]+'))) / sum(n) AS w, coalesce(string_agg(n, ',' ORDER BY r) FILTER (r <= 5 AND n > 1), '') AS hooks FROM ln GROUP BY doc_id),
tx AS (SELECT doc_id, coalesce(lines, 0) AS lines, coalesce(words, 0) AS words, coalesce(unique_words, 0) AS unique_words, coalesce(round(unique_words / words, 3), 0) AS ttr, coalesce(round(c, 2), 0) AS avg_line_chars, CAST(coalesce(m, 0) AS INTEGER) AS max_line_chars, coalesce(round(w, 2), 0) AS avg_line_words, coalesce(round(coalesce(en, 0) / words, 3), 0) AS english, coalesce(top_words, '') AS top_words, coalesce(hooks, '') AS hooks FROM documents LEFT JOIN wt USING (doc_id) LEFT JOIN lt USING (doc_id))"""


def texts(t):
    return L.texts(t.documents, "doc_id", "text", LOANWORDS, 20, 5)


@query("e31_texts", f"WITH {_TEXTS} SELECT * FROM tx")
def text_rows(t):
    top = F.array_join(F.transform("top_words", lambda s: F.concat_ws(":", s["word"], s["n"].cast("string"))), ",")
    return texts(t).withColumn("top_words", top).withColumn("hooks", F.array_join(F.transform("hook_lines", lambda s: s["n"].cast("string")), ",")).drop("hook_lines")


query("e30_dataset", f"WITH {_TEXTS} SELECT count(*) AS songs, CAST(sum(lines) AS BIGINT) AS total_lines, CAST(sum(words) AS BIGINT) AS total_words, round(avg(ttr), 3) AS avg_ttr, round(avg(english), 3) AS avg_english FROM tx")(lambda t: L.whole(texts(t)))
query("e32_spans", "SELECT 'o_totalprice' AS measure, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) AS n FROM orders WHERE o_totalprice <> 0 UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey), count(*) FROM orders WHERE o_custkey <> 0")(lambda t: L.spans(t.orders, ["o_totalprice", "o_custkey"]))
query("e32_top_artists", "SELECT coalesce(nullif(c_name, ''), 'Unknown') AS name, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, name LIMIT 10")(lambda t: L.frequent(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left"), "c_name", 10))
query("e33_first_failures", "SELECT event_id, left(coalesce(props, ''), 120) AS error FROM events WHERE event_type = 'view' ORDER BY ts, event_id LIMIT 10")(lambda t: L.failures(t.events, "event_type", "view", "event_id", "props", [F.asc("ts"), F.asc("event_id")]))
query("e34_story_contents", "SELECT o_orderkey, count(l_orderkey) AS items, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")(lambda t: L.contents(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("long").alias("q")), "o_orderkey", "q"))
_AUDITED = {"documents": ("doc_id", "text", "lang", "source", "n_chars"), "conversations": ("conv_id", "turn", "role", "text"), "labels": ("doc_id", "quality", "toxic")}
query("e7_audit", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls FROM {n}" for n, cs in _AUDITED.items() for c in cs))(lambda t: L.audit({n: getattr(t, n).select(*cs) for n, cs in _AUDITED.items()}))
