"""Rhyme queries over documents as songs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import intervals as I
from ..operators import rhyme as R
from .lexical import _SKEL, LINES, doc_lines
from .registry import query

SKELETONS = f"{LINES}, sk AS (SELECT doc_id, source, lang, ordinal, {_SKEL.format('line_norm')} AS skel FROM lines)"


def longest_first(key: str, lines: str) -> str:
    """The longest-first assignment as CTEs of a recursive query: one step for each length that two neighbours of the
    sorted reversed skeletons share; the last is ``found``."""
    return f"""w0 AS MATERIALIZED (SELECT {key}, ordinal, skel, reverse(skel) AS r FROM {lines} WHERE length(skel) >= 2),
w1 AS MATERIALIZED (SELECT *, lag(r) OVER (PARTITION BY {key} ORDER BY r) AS before FROM w0),
lv AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM (SELECT DISTINCT CASE WHEN left(r, length(before)) = before THEN length(before) ELSE list_position(list_transform(range(1, length(before) + 1), lambda i: left(r, i) = left(before, i)), false) - 1 END AS n FROM w1 WHERE left(r, 2) = left(before, 2))),
peel(k, {key}, ordinal, skel, hit) AS (SELECT 0, {key}, ordinal, skel, 0 FROM w0
  UNION ALL SELECT peel.k + 1, {key}, ordinal, skel, CASE WHEN length(skel) >= n AND count(*) OVER (PARTITION BY {key}, right(skel, n), length(skel) >= n) >= 2 THEN n ELSE 0 END FROM peel JOIN lv ON lv.k = peel.k + 1 WHERE hit = 0),
found AS (SELECT {key}, CAST(ordinal AS INTEGER) AS ordinal, CAST(hit AS INTEGER) AS match_length, right(skel, hit) AS suffix FROM peel WHERE hit > 0)"""


def skeletons(t):
    return C.skeletons(t.documents, "text", ["doc_id", "source", "lang"])


def found(t):
    return R.assigned(skeletons(t), "doc_id")


query("r1_rhyme_groups", f"WITH {SKELETONS} SELECT doc_id, right(skel, 2) AS rhyme, array_to_string(list_sort(list(ordinal)), ',') AS members, count(*) AS size FROM sk WHERE length(skel) >= 2 GROUP BY doc_id, right(skel, 2) HAVING count(*) >= 2")(lambda t: R.groups(skeletons(t), "doc_id").withColumn("members", F.array_join("members", ",")))
query("r2_internal_rhymes", f"WITH {SKELETONS}, m AS (SELECT doc_id, ordinal, skel, unnest(range(2, length(skel) // 2 + 1)) AS m FROM sk WHERE length(skel) >= 4), p AS (SELECT doc_id, ordinal, substr(skel, i, m) AS part FROM (SELECT *, unnest(range(1, length(skel) - m + 2)) AS i FROM m)) SELECT doc_id, ordinal, part, count(*) AS times FROM p GROUP BY ALL HAVING count(*) >= 2")(lambda t: R.internal(skeletons(t), "doc_id"))
query("r6_multisyllabic", f"WITH {SKELETONS} SELECT doc_id, right(skel, 3) AS rhyme, array_to_string(list_sort(list(ordinal)), ',') AS members, count(*) AS size FROM sk WHERE length(skel) >= 3 GROUP BY doc_id, right(skel, 3) HAVING count(*) >= 2")(lambda t: R.groups(skeletons(t), "doc_id", 3).withColumn("members", F.array_join("members", ",")))
_FOUND = f"WITH RECURSIVE {SKELETONS}, {longest_first('doc_id', 'sk')}"
_PROFILE = f"""whole AS (SELECT doc_id, source, sum(length(skel)) AS letters_, round(avg(CAST(length(skel) >= 4 AND len(list_distinct(list_transform(range(1, length(skel)), lambda i: substr(skel, i, 2)))) < length(skel) - 1 AS INTEGER)), 4) AS internal_rate FROM sk GROUP BY ALL),
hits AS (SELECT doc_id, sum(match_length) AS hit, count(*) AS end_rows, round(avg(CAST(match_length >= 3 AS INTEGER)), 4) AS pct_multis FROM found GROUP BY doc_id),
profile AS (SELECT doc_id, source, coalesce(end_rows, 0) AS end_rows, coalesce(pct_multis, 0) AS pct_multis, internal_rate, CASE WHEN letters_ > 0 THEN round(coalesce(hit, 0) / letters_, 4) ELSE 0 END AS rhyme_factor FROM whole LEFT JOIN hits USING (doc_id))"""
_CODES = """gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS g FROM (SELECT doc_id, suffix, match_length, min(ordinal) AS first FROM found GROUP BY ALL)),
pl AS (SELECT sk.doc_id, sk.ordinal, g FROM sk LEFT JOIN found USING (doc_id, ordinal) LEFT JOIN gr ON gr.doc_id = sk.doc_id AND gr.suffix = found.suffix AND gr.match_length = found.match_length),
cd AS (SELECT doc_id, ordinal, coalesce(g, coalesce(max(g) OVER (PARTITION BY doc_id), 0) + row_number() OVER (PARTITION BY doc_id, g IS NULL ORDER BY ordinal)) AS c, max(g) OVER (PARTITION BY doc_id) AS top FROM pl)"""
query("r3_longest_first", f"{_FOUND} SELECT * FROM found")(found)
query("r4_rhyme_factor", f"{_FOUND}, {_PROFILE} SELECT doc_id, rhyme_factor FROM profile")(lambda t: R.factor(skeletons(t), found(t), "doc_id"))
query("r5_scheme", f"{_FOUND}, {_CODES} SELECT doc_id, string_agg(c, ',' ORDER BY ordinal) AS scheme, CASE WHEN any_value(top) IS NULL THEN 'free' ELSE string_agg(CASE WHEN c <= 26 THEN chr(CAST(64 + c AS INTEGER)) ELSE '?' END, '' ORDER BY ordinal) END AS letters FROM cd GROUP BY doc_id")(lambda t: R.scheme(skeletons(t), found(t), "doc_id").withColumn("scheme", F.array_join("scheme", ",")))
query("r7_song_rhymes", f"{_FOUND}, {_PROFILE} SELECT * EXCLUDE (source) FROM profile")(lambda t: R.profile(skeletons(t), found(t), "doc_id"))
query("e8_rhymes_by_artist", f"WITH {SKELETONS}, g AS (SELECT doc_id, any_value(source) AS source, right(skel, 2) AS rhyme, count(*) AS size FROM sk WHERE length(skel) >= 2 GROUP BY doc_id, right(skel, 2) HAVING count(*) >= 2) SELECT source, count(DISTINCT doc_id) AS songs, count(*) AS n_groups, round(avg(size), 6) AS avg_size, count(*) FILTER (size >= 3) AS large FROM g GROUP BY source")(lambda t: R.groups(skeletons(t), "doc_id").join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.countDistinct("doc_id").alias("songs"), F.count("*").alias("n_groups"), F.round(F.avg("size"), 6).alias("avg_size"), F.count_if(F.col("size") >= 3).alias("large")))
query("e9_rhyme_fingerprint", f"{_FOUND}, {_PROFILE} SELECT source, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("rhyme_factor", "pct_multis", "internal_rate")) + " FROM profile GROUP BY source")(lambda t: R.profile(skeletons(t), found(t), "doc_id").join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("rhyme_factor", "pct_multis", "internal_rate"))))
query("e10_vowel_pairs", f"WITH {SKELETONS}, g AS (SELECT lang, right(skel, 2) AS pair, count(*) AS n FROM sk WHERE length(skel) >= 2 GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, pair) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 10")(lambda t: C.top_k(skeletons(t).where(F.length("skel") >= 2).groupBy("lang", T.end_rhyme(F.col("skel"), 2).alias("pair")).agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.asc("pair")], 10))
query("d15_suffix_words", f"WITH {LINES}, w AS (SELECT token, count(*) AS n FROM tokens GROUP BY token), sk AS (SELECT token, n, {_SKEL.format('token')} AS skel FROM w), f AS (SELECT * FROM sk WHERE length(skel) >= 2 ORDER BY n DESC, token LIMIT 500), l AS (SELECT DISTINCT right({_SKEL.format('lower(text)')}, 2) AS rhyme FROM benchmark) SELECT rhyme, token, n FROM f JOIN l ON right(skel, 2) = rhyme")(lambda t: _suffixes(t))


def _suffixes(t):
    forms = C.tokens(doc_lines(t), ["doc_id"]).groupBy("token").agg(F.count("*").alias("n")).withColumn("skel", T.skeleton(F.col("token")))
    frequent = R.suffix_words(forms.where(F.length("skel") >= 2).orderBy(F.desc("n"), "token").limit(500), "skel")
    wanted = t.benchmark.select(T.end_rhyme(T.skeleton(F.col("text")), 2).alias("rhyme")).distinct()
    return frequent.join(wanted, "rhyme").select("rhyme", "token", "n")


query("f11_flow_pattern", f"WITH {LINES}, x AS (SELECT doc_id, ordinal, syllable_count AS x, row_number() OVER w AS i, syllable_count - lag(syllable_count) OVER w AS d, avg(syllable_count) OVER (PARTITION BY doc_id) AS m FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)), g AS (SELECT doc_id, count(*) AS n, max(abs(x - m)) AS spread, avg(x) FILTER (i % 2 = 1) AS odd, avg(x) FILTER (i % 2 = 0) AS even, min(d) AS lo, max(d) AS hi FROM x GROUP BY doc_id) SELECT doc_id, n, CASE WHEN n < 2 THEN 'free' WHEN spread <= 1 THEN 'uniform' WHEN abs(odd - even) >= 2 THEN 'alternating' WHEN lo >= 0 THEN 'accelerating' WHEN hi <= 0 THEN 'decelerating' ELSE 'free' END AS pattern FROM g")(lambda t: I.pattern(doc_lines(t), ["doc_id"], "ordinal", "syllable_count"))
