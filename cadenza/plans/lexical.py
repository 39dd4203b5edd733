"""Text scalars, line model, lexical measures, lexicon, comparison and correction over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from .registry import query

LOANWORDS = ["the", "on", "all", "of", "to", "in", "and"]
CLICHES = ["the", "is", "with"]
ROLES = {"user": "strofa", "assistant": "refren", "system": "intro"}
KEYWORDS = ["stone", "tion", "eau", "ción", "ung", "that"]

_FOLD = "translate(replace(replace({0}, 'đ', 'dj'), 'Đ', 'Dj'), 'čćšžČĆŠŽ', 'ccszCCSZ')"
_NORM = "lower(" + _FOLD + ")"
_SYL = "(len(regexp_extract_all({0}, '[aeiou]')) + len(list_filter(range(1, length({0}) + 1), lambda i: substr({0}, i, 1) = 'r' AND NOT (i > 1 AND contains('aeiou', substr({0}, i - 1, 1))) AND NOT (i < length({0}) AND contains('aeiou', substr({0}, i + 1, 1))))))"
_SKEL = "array_to_string(list_filter(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN contains('aeiou', substr({0}, i, 1)) THEN substr({0}, i, 1) WHEN substr({0}, i, 1) = 'r' AND NOT (i > 1 AND contains('aeiou', substr({0}, i - 1, 1))) AND NOT (i < length({0}) AND contains('aeiou', substr({0}, i + 1, 1))) THEN 'r' ELSE '' END), lambda x: x <> ''), '')"
_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"

LINES = f"""cut AS (SELECT doc_id, source, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
each AS (SELECT doc_id, source, lang, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS ordinal FROM cut),
normed AS (SELECT *, {_NORM.format('line')} AS line_norm FROM each),
lines AS (SELECT doc_id, source, lang, CAST(ordinal AS INTEGER) AS ordinal, line, line_norm, CAST(len({_WORDS.format('line_norm')}) AS INTEGER) AS word_count, CAST({_SYL.format('line_norm')} AS INTEGER) AS syllable_count FROM normed),
tokens AS (SELECT doc_id, source, lang, unnest({_WORDS.format('line_norm')}) AS token FROM lines)"""


def doc_lines(t, norm: bool = True):
    return C.lines(t.documents, "text", ["doc_id", "source", "lang"], norm)


def doc_tokens(t):
    return C.words(t.documents, "text", ["doc_id", "source", "lang"])


# ---- scalars ----

query("b1_normalize_text", f"SELECT doc_id, {_NORM.format('text')} AS text_norm FROM documents")(lambda t: t.documents.select("doc_id", T.normalize(F.col("text")).alias("text_norm")))
query("b1_composed_text", f"SELECT doc_id, {_NORM.format('nfc_normalize(text)')} AS text_norm FROM (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) AS text FROM documents)")(lambda t: C.composed(t.documents.select("doc_id", F.replace("text", F.lit("é"), F.lit("e\u0301")).alias("text")), "text").select("doc_id", T.normalize(F.col("text")).alias("text_norm")))
query("b2_to_latin", "SELECT doc_id, trim(replace(text, chr(13) || chr(10), chr(10))) AS text_latin FROM documents")(lambda t: t.documents.select("doc_id", T.clean_lyrics(F.col("text")).alias("text_latin")))
query("b3_script", "SELECT doc_id, CASE WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'cyrillic' ELSE 'latin' END AS script FROM documents")(lambda t: t.documents.select("doc_id", T.script(F.col("text")).alias("script")))
query("b4_words", f"SELECT doc_id, CAST(len({_WORDS.format('lower(text)')}) AS INTEGER) AS n_words, CAST(len(regexp_extract_all(lower(text), '[a-zA-ZÀ-ÿ]+')) AS INTEGER) AS n_latin FROM documents")(lambda t: t.documents.select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"), F.size(T.latin_words(F.col("text"))).alias("n_latin")))
query("b5_syllables", f"SELECT doc_id, CAST({_SYL.format('lower(text)')} AS INTEGER) AS syllables FROM documents")(lambda t: t.documents.select("doc_id", T.syllables(F.col("text")).alias("syllables")))
query("b6_vowel_groups", "SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: greatest(len(regexp_extract_all(w, '[aeiou]+')), 1))), 0) AS INTEGER) AS groups FROM documents")(lambda t: t.documents.select("doc_id", T.vowel_groups(F.col("text")).alias("groups")))
query("b7_vowel_skeleton", f"WITH {LINES} SELECT doc_id, ordinal, {_SKEL.format('line_norm')} AS skel FROM lines")(lambda t: doc_lines(t).select("doc_id", "ordinal", T.skeleton(F.col("line_norm")).alias("skel")))
query("b8_end_rhyme", f"WITH {LINES} SELECT doc_id, ordinal, right({_SKEL.format('line_norm')}, 3) AS rhyme FROM lines")(lambda t: doc_lines(t).select("doc_id", "ordinal", T.end_rhyme(T.skeleton(F.col("line_norm")), 3).alias("rhyme")))
query("b12_role", "SELECT doc_id, nullif(regexp_extract(source || '-' || ['solo', 'duo', 'x'][doc_id % 3 + 1], '-(featured|solo|duo|trio)$', 1), '') AS role, regexp_replace(source || '-' || ['solo', 'duo', 'x'][doc_id % 3 + 1], '-(featured|solo|duo|trio)$', '') AS name FROM documents")(lambda t: _roles(t))


def _roles(t):
    category = F.concat_ws("-", "source", F.get(F.array(F.lit("solo"), F.lit("duo"), F.lit("x")), (F.col("doc_id") % 3).cast("int")))
    role, name = T.role_of(category)
    return t.documents.select("doc_id", role.alias("role"), name.alias("name"))


query("b14_dedup_key", f"SELECT doc_id, regexp_replace({_NORM.format('text')}, '[^a-z0-9]', '', 'g') AS key FROM documents")(lambda t: t.documents.select("doc_id", T.key_part(F.col("text")).alias("key")))
query("b15_slug", f"SELECT page_id, regexp_replace(regexp_replace({_NORM.format('url')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")(lambda t: t.pages.select("page_id", T.slug(F.col("url")).alias("slug")))
query("b17_file_name", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS artist, 'order ' || o_orderkey AS title, CAST(o_custkey AS VARCHAR) AS id FROM orders")(lambda t: t.orders.select("o_orderkey", T.file_parts(F.format_string("%s - %s - order %d [%d].mp3", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", "o_orderkey", "o_custkey")).alias("p")).select("o_orderkey", "p.*"))
query("b18_clip_id", r"SELECT page_id, nullif(regexp_extract(url, '/([^/?#]+)(?:[?#].*)?$', 1), '') AS clip FROM pages")(lambda t: t.pages.select("page_id", T.clip_id(F.col("url")).alias("clip")))
query("b20_prompt", "SELECT o_orderkey, concat_ws(', ', nullif(o_orderstatus, 'F'), o_orderpriority, CASE WHEN o_totalprice > 100000 THEN 'large' END) AS prompt FROM orders")(lambda t: t.orders.select("o_orderkey", F.concat_ws(", ", F.nullif("o_orderstatus", F.lit("F")), "o_orderpriority", F.when(F.col("o_totalprice") > 100000, "large")).alias("prompt")))
query("b21_summary", "WITH s AS (SELECT item_id, CAST(item_id AS VARCHAR) || ' | ' || substr(string_split(text, chr(10))[1], 1, 100) || ' | ' || array_to_string(string_split(text, ' ')[1:5], ', ') AS s FROM benchmark) SELECT item_id, CASE WHEN length(s) > 120 THEN substr(s, 1, 117) || '...' ELSE s END AS summary FROM s")(lambda t: t.benchmark.select("item_id", T.summary(F.col("item_id").cast("string"), F.col("text"), F.split("text", " "), 120).alias("summary")))
query("b22_hints", f"SELECT doc_id, array_to_string(list_filter({KEYWORDS}, lambda k: contains(lower(text), k))[1:3], ',') AS hints FROM documents")(lambda t: t.documents.select("doc_id", F.array_join(T.hints(F.col("text"), KEYWORDS, 3), ",").alias("hints")))
query("b23_semitones", f"WITH k AS (SELECT event_id, ['C', 'F#m', 'Bb', 'Gm', 'A'][event_id % 5 + 1] AS a, ['D', 'Ab', 'E'][event_id % 3 + 1] AS b FROM events), m AS (SELECT MAP {{'C': 0, 'F#m': 6, 'Bb': 10, 'Gm': 7, 'A': 9, 'D': 2, 'Ab': 8, 'E': 4}} AS m) SELECT event_id, CAST(((m[b] - m[a] + 5) % 12 + 12) % 12 - 5 AS INTEGER) AS steps FROM k, m")(lambda t: _keys(t))


def _keys(t):
    pick = lambda names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int"))
    return t.events.select("event_id", T.semitones(pick(["C", "F#m", "Bb", "Gm", "A"]), pick(["D", "Ab", "E"])).alias("steps"))


query("b24_edit_distance", "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance, levenshtein(p_name, p_type) <= 8 AS near FROM part")(lambda t: t.part.select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), (F.levenshtein(F.col("p_name"), F.col("p_type"), 8) >= 0).alias("near")))
query("b25_zscore", "WITH s AS (SELECT lang, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM documents GROUP BY lang) SELECT doc_id, round(greatest(0.0, least(100.0, 50 + 25 * CASE WHEN s = 0 THEN 0 ELSE (n_chars - m) / s END)), 6) AS score FROM documents JOIN s USING (lang)")(lambda t: t.documents.join(t.documents.groupBy("lang").agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("s")), "lang").select("doc_id", F.round(T.score100(T.zscore(F.col("n_chars"), F.col("m"), F.col("s"))), 6).alias("score")))
query("b28_density", f"WITH {LINES} SELECT doc_id, CAST(CASE WHEN avg(syllable_count) < 6 THEN 4 WHEN avg(syllable_count) < 10 THEN 8 ELSE 16 END AS INTEGER) AS density FROM lines GROUP BY doc_id")(lambda t: doc_lines(t).groupBy("doc_id").agg(F.avg("syllable_count").alias("x")).select("doc_id", T.density(F.col("x")).alias("density")))
query("b31_last_word", f"WITH {LINES} SELECT doc_id, ordinal, regexp_extract_all(line_norm, '[a-z]+')[-1] AS word FROM lines")(lambda t: doc_lines(t).select("doc_id", "ordinal", T.last_word(F.col("line_norm")).alias("word")))
query("b32_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")(lambda t: t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k")))

# ---- line model ----

query("f1_dedup_log", f"WITH k AS (SELECT doc_id, source, regexp_replace({_NORM.format('text')}, '[^a-z0-9]', '', 'g') AS key FROM documents), r AS (SELECT *, row_number() OVER w AS n, first_value(doc_id) OVER w AS f FROM k WINDOW w AS (PARTITION BY key ORDER BY doc_id)) SELECT doc_id, n = 1 AS is_kept, CASE WHEN n > 1 THEN f END AS duplicate_of FROM r")(lambda t: C.dedup(t.documents, [T.key_part(F.col("text"))], [F.col("doc_id")], "doc_id").select("doc_id", "is_kept", "duplicate_of"))
query("f2_lines", f"WITH {LINES} SELECT doc_id, ordinal, line, word_count, syllable_count FROM lines")(lambda t: doc_lines(t).select("doc_id", "ordinal", "line", "word_count", "syllable_count"))
query("f3_sections", "WITH c AS (SELECT conv_id, turn, role, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM conversations) SELECT conv_id, role AS label, CAST(sum(len(ls)) AS BIGINT) AS n_lines, CAST(count(*) FILTER (len(ls) > 0) AS BIGINT) AS n_sections FROM c GROUP BY conv_id, role HAVING sum(len(ls)) > 0")(lambda t: _sections(t).groupBy("conv_id", "label").agg(F.count("*").alias("n_lines"), F.countDistinct("section").alias("n_sections")))


def _labelled(t):
    """Conversations as one labelled text each: ``[role]`` above what was said."""
    each = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.concat(F.lit("["), s["role"], F.lit("]\n"), s["text"]))
    return t.conversations.groupBy("conv_id").agg(F.array_join(each, "\n").alias("text"))


def _sections(t):
    return C.sections(C.lines(_labelled(t), "text", ["conv_id"]), ["conv_id"], "ordinal", "line")


query("b9_section_label", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'strofa' WHEN 'assistant' THEN 'refren' WHEN 'system' THEN 'intro' ELSE 'other' END AS type, CAST(turn + 1 AS INTEGER) AS number, 'A,B' AS performers FROM conversations")(lambda t: t.conversations.select("conv_id", "turn", T.section_label(F.format_string("%s %d: A & B", F.initcap("role"), F.col("turn") + 1), ROLES).alias("p")).select("conv_id", "turn", "p.type", "p.number", F.array_join("p.performers", ",").alias("performers")))

# ---- lexical measures ----

METRICS = f"""perline AS (SELECT doc_id, any_value(source) AS source, any_value(lang) AS lang, count(*) AS line_count, round(avg(word_count), 2) AS avg_words_per_line, round(avg(syllable_count), 2) AS avg_syllables_per_line FROM lines GROUP BY doc_id),
tok AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL),
perdoc AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_words, count(*) AS unique_words, sum(CASE WHEN token IN {tuple(LOANWORDS)} THEN n ELSE 0 END) AS loans FROM tok GROUP BY doc_id),
hook AS (SELECT doc_id, max(n) AS hook_repetition_max, count(*) FILTER (n > 1) AS repeated FROM (SELECT doc_id, line_norm, count(*) AS n FROM lines GROUP BY ALL) GROUP BY doc_id),
metrics AS (SELECT doc_id, source, lang, coalesce(total_words, 0) AS total_words, coalesce(unique_words, 0) AS unique_words, CASE WHEN total_words > 0 THEN round(unique_words / total_words, 4) ELSE 0.0 END AS ttr, line_count, avg_words_per_line, avg_syllables_per_line, hook_repetition_max, round(repeated / line_count, 4) AS hook_repetition_ratio, CASE WHEN total_words > 0 THEN round(loans / total_words, 4) ELSE 0.0 END AS english_loanword_rate FROM perline LEFT JOIN perdoc USING (doc_id) LEFT JOIN hook USING (doc_id))"""
_MEANS = dict.fromkeys(("total_words", "ttr", "line_count", "avg_words_per_line", "avg_syllables_per_line", "hook_repetition_ratio", "english_loanword_rate"), 10)
_MEANS_SQL = ", ".join(f"round(avg({c}), {d}) AS avg_{c}" for c, d in _MEANS.items())


def metrics(t):
    whole = t.documents.select("doc_id", "source", "lang", "text").repartition("doc_id")  # the only shuffle: of texts, before they are cut
    return C.song_metrics(C.lines(whole, "text", ["doc_id", "source", "lang"]), ["doc_id", "source", "lang"], LOANWORDS)


query("e1_song_metrics", f"WITH {LINES}, {METRICS} SELECT * FROM metrics")(metrics)
query("e2_artist_stats", f"WITH {LINES}, {METRICS} SELECT source, count(*) AS songs, {_MEANS_SQL} FROM metrics GROUP BY source")(lambda t: C.means(metrics(t), ["source"], _MEANS))
query("e3_cohort_stats", f"WITH {LINES}, {METRICS} SELECT source, lang, count(*) AS songs, {_MEANS_SQL} FROM metrics WHERE doc_id % 3 = 0 GROUP BY source, lang")(lambda t: C.means(metrics(t).where("doc_id % 3 = 0"), ["source", "lang"], _MEANS))
# e3_cohort_stats is held to its SQL, which takes every third document; this one takes all of them, with lang as the cohort.
query("e3_cohort_stats_whole", f"WITH {LINES}, {METRICS} SELECT source, lang, count(*) AS songs, {_MEANS_SQL} FROM metrics GROUP BY source, lang")(lambda t: C.means(metrics(t), ["source", "lang"], _MEANS))
query("e4_top_words", f"WITH {LINES}, n AS (SELECT source, token, count(*) AS n FROM tokens GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, token) AS INTEGER) AS rank FROM n) SELECT source, token, n, rank FROM r WHERE rank <= 20")(lambda t: C.top_words(doc_tokens(t), ["source"], 20))
query("e5_section_types", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")(lambda t: t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations")))
query("e6_syllable_histogram", f"WITH {LINES} SELECT CASE WHEN syllable_count <= 4 THEN '0-4' WHEN syllable_count <= 8 THEN '5-8' WHEN syllable_count <= 12 THEN '9-12' WHEN syllable_count <= 16 THEN '13-16' ELSE '17+' END AS bucket, count(*) AS n FROM lines GROUP BY bucket")(lambda t: doc_lines(t).groupBy(C.bucketed(F.col("syllable_count"), [4, 8, 12, 16]).alias("bucket")).agg(F.count("*").alias("n")))
query("e7_inventory", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")(lambda t: t.documents.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")))
query("e11_structure", "WITH s AS (SELECT conv_id, role, count(*) AS n, sum(len(string_split(text, chr(10)))) AS ls FROM conversations GROUP BY ALL) SELECT role, round(avg(n), 6) AS sections_per_song, round(sum(ls) / sum(n), 6) AS lines_per_section, round(sum(n) / (SELECT count(*) FROM conversations), 6) AS share FROM s GROUP BY role")(lambda t: _structure(t))


def _structure(t):
    each = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", "\n"))).alias("ls"))
    g = each.groupBy("role").agg(F.round(F.avg("n"), 6).alias("sections_per_song"), F.round(F.sum("ls") / F.sum("n"), 6).alias("lines_per_section"), F.sum("n").alias("n"))
    total = t.conversations.agg(F.count("*").alias("all"))
    return g.crossJoin(F.broadcast(total)).select("role", "sections_per_song", "lines_per_section", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # total: one row


query("e12_lexical_quartiles", f"WITH {LINES}, {METRICS} SELECT lang, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in ("ttr", "avg_syllables_per_line") for n, q in (("q1", .25), ("median", .5), ("q3", .75))) + " FROM metrics GROUP BY lang")(lambda t: C.quartiles(metrics(t), ["lang"], ["ttr", "avg_syllables_per_line"]))
query("e14_fingerprints", f"WITH {LINES}, {METRICS} SELECT lang, source, count(*) AS songs, round(median(ttr), 6) AS ttr, round(median(avg_syllables_per_line), 6) AS syllables, round(median(hook_repetition_ratio), 6) AS hooks, CASE WHEN median(ttr) > 0.6 THEN 'varied' ELSE 'plain' END AS profile FROM metrics GROUP BY GROUPING SETS ((lang, source), (lang))")(lambda t: metrics(t).groupingSets([["lang", "source"], ["lang"]], "lang", "source").agg(F.count("*").alias("songs"), F.round(F.median("ttr"), 6).alias("ttr"), F.round(F.median("avg_syllables_per_line"), 6).alias("syllables"), F.round(F.median("hook_repetition_ratio"), 6).alias("hooks"), F.when(F.median("ttr") > 0.6, "varied").otherwise("plain").alias("profile")))
_LEX = f"WITH {LINES}, n AS (SELECT token, count(*) FILTER (lang = 'en') AS freq_a, count(*) FILTER (lang = 'fr') AS freq_b FROM tokens WHERE lang IN ('en', 'fr') GROUP BY token), lex AS (SELECT token, freq_a, freq_b, round(log2((freq_a * 10000.0 / (SELECT sum(freq_a) FROM n) + 0.5) / (freq_b * 10000.0 / (SELECT sum(freq_b) FROM n) + 0.5)), 6) AS distinctiveness FROM n WHERE freq_a + freq_b >= 3)"


def lang_counts(t):
    """lang, token, n: word counts that the parts of one plan share (with a token that cannot be null no part's join adds a
    filter of its own below them, so that their shuffle is one)."""
    return doc_tokens(t).withColumn("token", F.coalesce("token", F.lit(""))).groupBy("lang", "token").agg(F.count("*").alias("n"))


def lexicon(t):
    return C.mined_lexicon(doc_tokens(t), "lang", "en", "fr")


query("e15_lexicon", f"{_LEX} SELECT * FROM lex")(lexicon)
query("b26_log_ratio", "SELECT doc_id, round(log2((n_chars + 0.5) / (length(source) + 0.5)), 6) AS ratio FROM documents")(lambda t: t.documents.select("doc_id", F.round(T.log_ratio(F.col("n_chars"), F.length("source")), 6).alias("ratio")))
query("c4_lexicon_top", f"{_LEX} SELECT * FROM lex WHERE distinctiveness > 0.5 ORDER BY distinctiveness DESC, token LIMIT 50")(lambda t: C.lexicon_top(lexicon(t), "a", 50))
query("g6_by_absolute_score", f"{_LEX} SELECT * FROM lex ORDER BY abs(distinctiveness) DESC, token LIMIT 50")(lambda t: C.lexicon_top(lexicon(t), None, 50))
_SHARES = f"WITH {LINES}, n AS (SELECT lang, token, count(*) AS n FROM tokens WHERE lang IN ('en', 'fr') GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share FROM n), al AS (SELECT coalesce(a.token, b.token) AS token, coalesce(a.share, 0) AS p, coalesce(b.share, 0) AS q FROM (SELECT * FROM s WHERE lang = 'en') a FULL JOIN (SELECT * FROM s WHERE lang = 'fr') b ON a.token = b.token)"


def _aligned(t):
    s = C.shares(doc_tokens(t).where(F.col("lang").isin("en", "fr")), ["lang"], "token")
    return C.aligned(s.where("lang = 'en'"), s.where("lang = 'fr'"), "token")


_JSD = "sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)"
query("d17_aligned_shares", f"{_SHARES} SELECT token, round(p, 9) AS p, round(q, 9) AS q FROM al")(lambda t: _aligned(t).select("token", F.round("p", 9).alias("p"), F.round("q", 9).alias("q")))
query("b27_divergence", f"{_SHARES} SELECT round({_JSD} / ln(2), 6) AS jsd FROM al")(lambda t: C.divergence(_aligned(t)))
query("b27_divergence_rooted", f"{_SHARES} SELECT round(sqrt({_JSD}), 6) AS jsd FROM al")(lambda t: C.divergence(_aligned(t), base=2.718281828459045, rooted=True))
query("e16_over_represented", f"{_SHARES} SELECT token, CASE WHEN q = 0 THEN 'only en' WHEN p = 0 THEN 'only fr' WHEN p / q >= 2 THEN 'over' WHEN q / p >= 2 THEN 'under' ELSE 'even' END AS verdict FROM al")(lambda t: _aligned(t).select("token", F.when(F.col("q") == 0, "only en").when(F.col("p") == 0, "only fr").when(F.col("p") / F.col("q") >= 2, "over").when(F.col("q") / F.col("p") >= 2, "under").otherwise("even").alias("verdict")))
query("e17_topic_mix", "SELECT label, vec_id % 3 AS cohort, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY vec_id % 3), 9) AS share FROM embeddings GROUP BY label, vec_id % 3")(lambda t: C.shares(t.embeddings.withColumn("cohort", F.col("vec_id") % 3), ["cohort"], "label").withColumn("share", F.round("share", 9)))
query("e18_coverage", f"WITH {LINES} SELECT lang, count(*) AS n_lines, count(*) FILTER (word_count > 0) AS annotated, round(100.0 * count(*) FILTER (word_count > 0) / count(*), 4) AS percent FROM lines GROUP BY lang")(lambda t: doc_lines(t).groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(F.col("word_count") > 0).alias("annotated"), F.round(100.0 * F.count_if(F.col("word_count") > 0) / F.count("*"), 4).alias("percent")))
query("e19_flow", f"WITH {LINES} SELECT doc_id, round(avg(syllable_count), 6) AS mean, round(avg(syllable_count) / nullif(avg(word_count), 0), 6) AS density, round(coalesce(stddev_samp(syllable_count), 0) / nullif(avg(syllable_count), 0), 6) AS variation FROM lines GROUP BY doc_id")(lambda t: doc_lines(t).groupBy("doc_id").agg(F.round(F.avg("syllable_count"), 6).alias("mean"), F.round(F.avg("syllable_count") / F.nullif(F.avg("word_count"), F.lit(0.0)), 6).alias("density"), F.round(F.coalesce(F.stddev_samp("syllable_count"), F.lit(0.0)) / F.nullif(F.avg("syllable_count"), F.lit(0.0)), 6).alias("variation")))
query("e20_flow_by_artist", f"WITH {LINES} SELECT source, count(*) AS n_lines, round(avg(syllable_count), 6) AS mean, round(avg(syllable_count / nullif(word_count, 0)), 6) AS density FROM lines GROUP BY source")(lambda t: doc_lines(t).groupBy("source").agg(F.count("*").alias("n_lines"), F.round(F.avg("syllable_count"), 6).alias("mean"), F.round(F.avg(F.col("syllable_count") / F.nullif("word_count", F.lit(0))), 6).alias("density")))
query("e24_effect_sizes", f"WITH {LINES}, {METRICS}, l AS (SELECT lang, 'ttr' AS metric, CAST(ttr AS DOUBLE) AS x FROM metrics UNION ALL SELECT lang, 'line_count', line_count FROM metrics), g AS (SELECT metric, avg(x) FILTER (lang = 'en') AS ma, avg(x) FILTER (lang = 'fr') AS mb, var_samp(x) FILTER (lang = 'en') AS va, var_samp(x) FILTER (lang = 'fr') AS vb, count(*) FILTER (lang = 'en') AS na, count(*) FILTER (lang = 'fr') AS nb FROM l GROUP BY metric), d AS (SELECT *, (mb - ma) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM g) SELECT metric, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(d, 6) AS cohens_d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d")(lambda t: C.effect_sizes(metrics(t), "lang", "en", "fr", ["ttr", "line_count"]))
query("e30_repeated_lines", f"WITH {LINES}, n AS (SELECT doc_id, line_norm, count(*) AS n FROM lines GROUP BY ALL HAVING count(*) > 1), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line_norm) AS INTEGER) AS rank FROM n) SELECT * FROM r WHERE rank <= 5")(lambda t: C.top_k(doc_lines(t).groupBy("doc_id", "line_norm").agg(F.count("*").alias("n")).where("n > 1"), ["doc_id"], [F.desc("n"), F.asc("line_norm")], 5))
query("e31_text_stats", f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, CAST(sum(word_count) AS BIGINT) AS n_words, round(avg(length(line)), 6) AS avg_length, CAST(max(length(line)) AS INTEGER) AS max_length FROM lines GROUP BY doc_id")(lambda t: doc_lines(t).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("word_count").alias("n_words"), F.round(F.avg(F.length("line")), 6).alias("avg_length"), F.max(F.length("line")).alias("max_length")))
query("e37_section_variation", "WITH x AS (SELECT role, CAST(length(text) AS DOUBLE) AS x FROM conversations) SELECT role, round(avg(x), 6) AS mean, round(stddev_pop(x) / avg(x), 6) AS cv FROM x GROUP BY role")(lambda t: t.conversations.select("role", F.length("text").cast("double").alias("x")).groupBy("role").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x") / F.avg("x"), 6).alias("cv")))
query("e27_orderings", "WITH o AS (SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS ordering FROM conversations GROUP BY conv_id), n AS (SELECT ordering, count(*) AS n FROM o GROUP BY ordering) SELECT * FROM n ORDER BY n DESC, ordering LIMIT 20")(lambda t: t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">").alias("ordering")).groupBy("ordering").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ordering").limit(20))

# ---- joins of vocabularies, correction ----

query("d7_vocabulary_overlap", f"{_LEX}, b AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM benchmark), bn AS (SELECT token, count(*) AS n FROM b GROUP BY token) SELECT token, n, distinctiveness, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM bn JOIN lex USING (token)")(lambda t: _overlap(t))


def _overlap(t):
    n = C.tokens(C.lines(t.benchmark, "text", ["item_id"], norm=False), ["item_id"]).groupBy("token").agg(F.count("*").alias("n"))
    both = n.join(lexicon(t).select("token", "distinctiveness"), "token")
    total = both.agg(F.sum("n").alias("_all"))
    return both.crossJoin(F.broadcast(total)).select("token", "n", "distinctiveness", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("percent"))  # total: one row


_VOCAB = f"WITH {LINES}, v AS (SELECT token, count(*) AS n FROM tokens GROUP BY token), b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM benchmark), ks AS (SELECT word, word AS k, 0 AS i FROM b UNION SELECT word, substr(word, 1, i - 1) || substr(word, i + 1), i FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM b)), kv AS (SELECT token, n, token AS k, 0 AS j FROM v WHERE n >= 3 UNION SELECT token, n, substr(token, 1, i - 1) || substr(token, i + 1), i FROM (SELECT token, n, unnest(range(1, length(token) + 1)) AS i FROM v WHERE n >= 3)), pairs AS (SELECT DISTINCT word, token, n FROM ks JOIN kv USING (k) WHERE word <> token AND (length(word) = length(token) AND i = j AND i > 0 OR abs(length(word) - length(token)) = 1 AND (i = 0) <> (j = 0)))"


def _vocabulary(t):
    return doc_tokens(t).groupBy("token").agg(F.count("*").alias("n"))


def _drafts(t):
    return C.tokens(C.lines(t.benchmark, "text", ["item_id"], norm=False), ["item_id"]).select(F.col("token").alias("word")).distinct()


query("d8_fuzzy_join", f"{_VOCAB} SELECT * FROM pairs")(lambda t: C.fuzzy_pairs(_drafts(t), _vocabulary(t).where("n >= 3"), "word", "token"))
query("t7_unknown_words", f"{_VOCAB}, un AS (SELECT word FROM b ANTI JOIN v ON word = token), r AS (SELECT word, token, n, CAST(row_number() OVER (PARTITION BY word ORDER BY n DESC, token) AS INTEGER) AS rank FROM un JOIN pairs USING (word)) SELECT word, string_agg(token, ',' ORDER BY rank) FILTER (rank <= 3) AS suggested FROM un LEFT JOIN r USING (word) GROUP BY word")(lambda t: _unknown(t))


def _unknown(t):
    vocabulary = _vocabulary(t)
    unknown = _drafts(t).join(vocabulary, F.col("word") == F.col("token"), "left_anti")
    near = C.top_k(C.fuzzy_pairs(unknown, vocabulary.where("n >= 3"), "word", "token"), ["word"], [F.desc("n"), F.asc("token")], 3)
    best = near.groupBy("word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda s: s["token"]), ",").alias("suggested"))
    return unknown.join(best, "word", "left")


query("t1_cliches", f"WITH {LINES} SELECT doc_id, count(*) AS n, count(*) FILTER (token IN {tuple(CLICHES)}) AS cliches, round(count(*) FILTER (token IN {tuple(CLICHES)}) / count(*), 6) AS density FROM tokens GROUP BY doc_id")(lambda t: doc_tokens(t).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("token").isin(CLICHES)).alias("cliches"), F.round(F.count_if(F.col("token").isin(CLICHES)) / F.count("*"), 6).alias("density")))
query("t2_token_cleaner", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '###|%%%|&&&', '', 'g'))), lambda x: x <> ''), chr(10)) AS cleaned, CAST(len(regexp_extract_all(text, '###|%%%|&&&')) AS INTEGER) AS removed FROM documents")(lambda t: t.documents.select("doc_id", T.blank_lines_cleaned(F.regexp_replace("text", "###|%%%|&&&", "")).alias("cleaned"), F.regexp_count("text", F.lit("###|%%%|&&&")).alias("removed")))
query("t3_whitespace", "WITH l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), x AS (SELECT doc_id, line_no, ls[line_no] AS x FROM l) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN contains(x, '  ') THEN 'double space' ELSE 'trailing space' END AS issue FROM x WHERE contains(x, '  ') OR x LIKE '% '")(lambda t: t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x")).where(F.contains("x", F.lit("  ")) | F.col("x").endswith(" ")).select("doc_id", (F.col("p") + 1).alias("line_no"), F.when(F.contains("x", F.lit("  ")), "double space").otherwise("trailing space").alias("issue")))
query("t6_diacritics", rf"WITH {LINES}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]+')) AS form FROM lines), n AS (SELECT doc_id, strip_accents(form) AS folded, form, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER p AS rank, count(*) OVER (PARTITION BY doc_id, folded) AS forms, first_value(form) OVER p AS suggested FROM n WINDOW p AS (PARTITION BY doc_id, folded ORDER BY n DESC, form)) SELECT doc_id, form AS original, suggested, n FROM r WHERE forms >= 2 AND rank > 1")(lambda t: _diacritics(t))

#: Accented letters of the corpus' languages and their plain forms.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿčćšž", "aaaaaaceeeeiiiinooooouuuuyyccsz")


def _diacritics(t):
    whole = C.dealt(t.documents.select("doc_id", "text"), "doc_id", "text")  # the only shuffle: of texts, before they are cut
    words = whole.select("doc_id", F.explode(T.words(F.col("text"))).alias("form")).groupBy("doc_id", "form").agg(F.count("*").alias("n"))
    n = words.withColumn("folded", F.translate("form", *ACCENTS))
    w = Window.partitionBy("doc_id", "folded").orderBy(F.desc("n"), "form")
    return n.withColumn("_r", F.row_number().over(w)).withColumn("suggested", F.first("form").over(w)).where("_r > 1").select("doc_id", F.col("form").alias("original"), "suggested", "n")


query("d12_folded_pairs", rf"WITH {LINES}, w AS (SELECT unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]+')) AS form FROM lines), n AS (SELECT form, strip_accents(form) AS folded, count(*) AS n FROM w GROUP BY ALL) SELECT a.form AS marked, b.form AS plain, a.n AS n_marked, b.n AS n_plain FROM n a JOIN n b ON a.folded = b.folded AND a.form <> a.folded AND b.form = b.folded")(lambda t: _folded(t))


def _folded(t):
    n = doc_lines(t).select(F.explode(T.words(F.col("line"))).alias("form")).groupBy("form").agg(F.count("*").alias("n")).withColumn("folded", F.translate("form", *ACCENTS))
    marked, plain = n.where("form <> folded"), n.where("form = folded")
    return marked.select(F.col("form").alias("marked"), F.col("n").alias("n_marked"), "folded").join(plain.select(F.col("form").alias("plain"), F.col("n").alias("n_plain"), "folded"), "folded").drop("folded")
