"""Fingerprints and themes: conversations as songs (artist and cohort by id), embeddings as sections of topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import drafts as D
from ..operators import fingerprint as P
from ..operators import retrieval as V
from ..operators import rhyme as R
from ..operators import suggest as S
from ..operators import themes as M
from .lexical import _NORM, _SYL, _WORDS
from .registry import query
from .rhymes import longest_first
from .suggestions import _RHYME, _TAG, DRAFTS, drafts, skeletons

_BY = ("cohort", "artist")
_OWNER = "'c' || conv_id % 2 AS cohort, 'a' || conv_id % 5 AS artist"
_SETS = "GROUPING SETS ((cohort, artist{0}), (cohort{0}))"
SONGS = f"""{DRAFTS}, {_RHYME}, {longest_first('conv_id', 'sk')},
sl AS (SELECT conv_id, skel, {_NORM.format('line')} AS line_norm FROM sk),
sx AS (SELECT *, {_WORDS.format('line_norm')} AS ws, CAST({_SYL.format('line_norm')} AS INTEGER) AS syl, length(skel) >= 4 AND len(list_distinct(list_transform(range(1, length(skel)), lambda i: substr(skel, i, 2)))) < length(skel) - 1 AS inner_ FROM sl),
s1 AS (SELECT conv_id, round(len(list_distinct(flatten(list(ws)))) / sum(len(ws)), 4) AS ttr, round(avg(syl), 2) AS avg_syllables_per_line, round(avg(CAST(inner_ AS INTEGER)), 4) AS internal_rate, sum(length(skel)) AS letters_all, count(*) AS line_count FROM sx GROUP BY conv_id),
s2 AS (SELECT conv_id, count(*) FILTER (n > 1) AS repeated FROM (SELECT conv_id, line_norm, count(*) AS n FROM sx GROUP BY ALL) GROUP BY conv_id),
s3 AS (SELECT conv_id, sum(match_length) AS hit, round(avg(CAST(match_length >= 3 AS INTEGER)), 4) AS pct_multis FROM found GROUP BY conv_id),
songs AS (SELECT conv_id, {_OWNER}, ttr, avg_syllables_per_line, round(repeated / line_count, 4) AS hook_repetition_ratio, internal_rate, coalesce(pct_multis, 0) AS pct_multis, CASE WHEN letters_all > 0 THEN round(coalesce(hit, 0) / letters_all, 4) ELSE 0 END AS rhyme_factor, coalesce(letters, 'free') AS scheme FROM s1 JOIN s2 USING (conv_id) LEFT JOIN s3 USING (conv_id) LEFT JOIN schemes USING (conv_id)),
parts AS (SELECT conv_id, section, kind, count(*) FILTER (NOT is_label) AS n_lines FROM marks GROUP BY ALL)"""


def _owner(df):
    return df.withColumns({"cohort": F.concat(F.lit("c"), F.col("conv_id") % 2), "artist": F.concat(F.lit("a"), F.col("conv_id") % 5)})


def songs(t):
    lines = skeletons(t)
    lexical = lines.select("conv_id", T.normalize(F.col("line")).alias("line_norm")).withColumns({"word_count": F.size(T.words(F.col("line_norm"))), "syllable_count": T.syllables(F.col("line_norm"))})
    measured = C.song_metrics(lexical, ["conv_id"], []).select("conv_id", "ttr", "avg_syllables_per_line", "hook_repetition_ratio")
    rhymes = R.profile(lines, R.assigned(lines, "conv_id"), "conv_id").select("conv_id", "pct_multis", "internal_rate", "rhyme_factor")
    schemes = R.scheme(lines, S.matched(lines, "conv_id").drop("first"), "conv_id").select("conv_id", F.col("letters").alias("scheme"))
    return _owner(measured.join(rhymes, "conv_id").join(schemes, "conv_id"))


def owners(t):
    return _owner(t.conversations.select("conv_id").distinct())


def parts(t):
    return drafts(t).groupBy("conv_id", "section", "kind").agg(F.count_if(~F.col("is_label")).alias("n_lines"))


# Rounded to where no tie of rounded values can differ between engines.
_THREE = ", ".join(f"round(quantile_cont({c}, {q}), 8) AS {c}_{n}" for c in ("rhyme_factor", "pct_multis") for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
_CRAFT = f"SELECT cohort, artist, count(*) AS songs, {_THREE}, round(median(internal_rate), 8) AS internal_rate_median FROM songs GROUP BY {_SETS.format('')}"
query("e10_rhyme_craft", f"WITH RECURSIVE {SONGS} {_CRAFT}")(lambda t: P.rhyme_craft(songs(t), *_BY, digits=8))
query("e10_scheme_counts", f"WITH RECURSIVE {SONGS} SELECT cohort, artist, scheme, count(*) AS n FROM songs GROUP BY {_SETS.format(', scheme')}")(lambda t: P.scheme_counts(songs(t), *_BY))


@query("e10_song_vowel_pairs", f"WITH RECURSIVE {SONGS}, v AS (SELECT conv_id, suffix, n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, suffix) AS r FROM (SELECT conv_id, suffix, count(*) AS n FROM found GROUP BY ALL)) WHERE r <= 5), g AS (SELECT cohort, artist, suffix, CAST(sum(n) AS BIGINT) AS n FROM v JOIN songs USING (conv_id) GROUP BY {_SETS.format(', suffix')}) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cohort, artist ORDER BY n DESC, suffix) AS INTEGER) AS rank FROM g) WHERE rank <= 10")
def vowel_pairs(t):
    return P.vowel_pairs(R.assigned(skeletons(t), "conv_id"), "conv_id", "suffix", owners(t), *_BY)


_STRUCTURE = f"SELECT cohort, artist, coalesce(round(avg(p), 2), 0) AS sections_per_song, round(sum(l) / sum(p), 2) AS lines_per_section, round(sum(r) / sum(p), 4) AS refren_share, round(median(hook_repetition_ratio), 8) AS hook_repetition_ratio FROM songs JOIN (SELECT conv_id, count(*) AS p, sum(n_lines) AS l, count(*) FILTER (kind = 'refren') AS r FROM parts GROUP BY conv_id) USING (conv_id) GROUP BY {_SETS.format('')}"
query("e11_structure_by_artist", f"WITH RECURSIVE {SONGS} {_STRUCTURE}")(lambda t: P.structure(parts(t), songs(t), "conv_id", *_BY, digits=8))
query("e11_section_types", f"WITH {DRAFTS} SELECT cohort, artist, kind, count(*) AS n FROM (SELECT kind, {_OWNER} FROM dsec) GROUP BY {_SETS.format(', kind')}")(lambda t: P.section_types(parts(t), owners(t), "conv_id", *_BY))
_LEXICAL = f"SELECT cohort, artist, round(median(ttr), 8) AS ttr_median, round(median(avg_syllables_per_line), 8) AS syllables_median FROM songs GROUP BY {_SETS.format('')}"


@query("e12_top_forms", f"WITH {DRAFTS}, w AS (SELECT conv_id, unnest({_WORDS.format(_NORM.format('line'))}) AS token FROM dl), g AS (SELECT cohort, artist, token AS form, count(*) AS n FROM (SELECT token, {_OWNER} FROM w WHERE {_TAG} NOT IN ('ADJ', 'X')) GROUP BY {_SETS.format(', token')}) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cohort, artist ORDER BY n DESC, form) AS INTEGER) AS rank FROM g) WHERE rank <= 20")
def top_forms(t):
    words = S.lyric_lines(drafts(t)).select("conv_id", F.explode(T.words(T.normalize(F.col("line")))).alias("token")).select("conv_id", F.col("token").alias("form"), F.expr(_TAG).alias("upos"))
    return P.top_forms(words, owners(t), "conv_id", *_BY, exclude=("ADJ", "X"))


# No tagger: words with a capital are entities, of a type by their first letter; every third word begins one anew.
_BIO = "CASE WHEN NOT regexp_like(word, '^[A-Z]') THEN 'O' ELSE concat(CASE WHEN position % 3 = 1 THEN 'B-' ELSE 'I-' END, CASE WHEN left(word, 1) <= 'I' THEN 'PER' WHEN left(word, 1) <= 'R' THEN 'LOC' ELSE 'ORG' END) END"
_ENTITIES = f"""et AS (SELECT *, {_BIO.replace('regexp_like', 'regexp_matches')} AS tag FROM (SELECT conv_id, line_no, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS position FROM (SELECT conv_id, line_no, {_WORDS.format('line')} AS ws FROM dl))),
es AS (SELECT *, CASE WHEN tag <> 'O' THEN substr(tag, 3) END AS k, lag(tag) OVER (PARTITION BY conv_id, line_no ORDER BY position) AS pt FROM et),
en AS (SELECT *, sum(CASE WHEN k IS NOT NULL AND (left(tag, 2) = 'B-' OR pt IS NULL OR pt = 'O' OR substr(pt, 3) <> k) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, line_no ORDER BY position) AS n FROM es),
ent AS (SELECT conv_id, line_no, k AS type, string_agg(word, ' ' ORDER BY position) AS text FROM en WHERE k IS NOT NULL GROUP BY conv_id, line_no, n, k)"""


def entities(t):
    words = S.lyric_lines(drafts(t)).select("conv_id", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(T.WORD), 0)).alias("_p", "word")).withColumn("position", F.col("_p") + 1)
    return D.entities(words.withColumn("tag", F.expr(_BIO)), ["conv_id", "line_no"], "position", "word", "tag")


query("m5_entities", f"WITH {DRAFTS}, {_ENTITIES} SELECT * FROM ent")(entities)
query("e13_top_entities", f"WITH {DRAFTS}, {_ENTITIES}, g AS (SELECT cohort, artist, type, text, count(*) AS n FROM (SELECT type, text, {_OWNER} FROM ent) GROUP BY {_SETS.format(', type, text')}) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cohort, artist, type ORDER BY n DESC, text) AS INTEGER) AS rank FROM g) WHERE rank <= 10")(lambda t: P.top_entities(entities(t), owners(t), "conv_id", *_BY))
query("e13_top_topics", f"WITH {DRAFTS}, g AS (SELECT cohort, artist, label, count(*) AS n FROM (SELECT 't' || (conv_id * 7 + section) % 9 AS label, {_OWNER} FROM dsec) GROUP BY {_SETS.format(', label')}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cohort, artist ORDER BY n DESC, label) AS INTEGER) AS rank FROM g) SELECT *, round(n / sum(n) OVER (PARTITION BY cohort, artist), 4) AS share FROM r WHERE rank <= 5")(lambda t: P.top_topics(parts(t).withColumn("label", F.concat(F.lit("t"), (F.col("conv_id") * 7 + F.col("section")) % 9)), owners(t), "conv_id", *_BY))

_N = "CAST(round(CAST({0} AS DECIMAL(14,8)){2}, {1}) AS DECIMAL(12,{1}))"
_P = lambda c, d: f"{_N.format(c, d, ' * 100')} || '%'"
_PROFILE = f"""CASE WHEN rhyme_factor_median > 0.7 THEN 'High rhyme density (RF=' || {_N.format('rhyme_factor_median', 2, '')} || ') with heavy multisyllabic rhymes (' || {_P('pct_multis_median', 1)} || ').' WHEN rhyme_factor_median > 0.55 THEN 'Moderate rhyme density (RF=' || {_N.format('rhyme_factor_median', 2, '')} || ') with ' || {_P('pct_multis_median', 1)} || ' multisyllabic rhymes.' ELSE 'Lean rhyme style (RF=' || {_N.format('rhyme_factor_median', 2, '')} || ') with ' || {_P('pct_multis_median', 1)} || ' multis.' END
|| ' ' || CASE WHEN refren_share > 0.25 THEN 'Hook-heavy' ELSE 'Verse-driven' END || ' structure (' || {_P('refren_share', 0)} || ' refren, ' || {_N.format('sections_per_song', 1, '')} || ' sections/song).'
|| ' ' || CASE WHEN ttr_median > 0.55 THEN 'Lexically diverse' ELSE 'Repetitive lexicon' END || ' (TTR=' || {_N.format('ttr_median', 2, '')} || ', ' || {_N.format('syllables_median', 1, '')} || ' syllables/line).' AS profile"""
query("e14_artist_fingerprints", f"WITH RECURSIVE {SONGS}, a AS ({_CRAFT}), b AS ({_STRUCTURE}), c AS ({_LEXICAL}), f AS (SELECT a.*, b.* EXCLUDE (cohort, artist), c.* EXCLUDE (cohort, artist) FROM a JOIN b ON a.cohort = b.cohort AND a.artist IS NOT DISTINCT FROM b.artist JOIN c ON a.cohort = c.cohort AND a.artist IS NOT DISTINCT FROM c.artist) SELECT *, {_PROFILE} FROM f")(lambda t: P.fingerprints(songs(t), parts(t), "conv_id", *_BY, digits=8))

# ---- themes ----

_DISTANCE = "list_sum(list_transform(list_zip(e.embedding, c.v), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
_ASSIGNED = f"""ce AS (SELECT CAST(vec_id / 40 AS INTEGER) AS k, embedding AS v FROM embeddings WHERE vec_id IN (0, 40, 80, 120, 160)),
ds AS (SELECT e.vec_id, c.k, {_DISTANCE} AS d FROM embeddings e, ce c),
bs AS (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM ds GROUP BY vec_id),
mem AS (SELECT bs.vec_id, CASE WHEN sqrt(bs.d) <= 1.3 THEN bs.k ELSE -1 END AS topic, round(sqrt(any_value(bs.d)), 6) AS distance, round(1 / sum(exp(-(ds.d - bs.d) / 2)), 6) AS probability FROM bs JOIN ds USING (vec_id) GROUP BY bs.vec_id, bs.k, bs.d)"""


def centres(t):
    """Five sections of the table as centres (five rows)."""
    rows = t.embeddings.where("vec_id in (0, 40, 80, 120, 160)").orderBy("vec_id").select("embedding").collect()
    return M.Centres([[float(x) for x in r.embedding] for r in rows], [1.3] * len(rows))


def members(t, *keys):
    return M.assigned(t.embeddings, list(keys) or "vec_id", "embedding", centres(t))


query("m3_assigned_topics", f"WITH {_ASSIGNED} SELECT * FROM mem")(members)
query("m4_draft_themes", f"WITH {_ASSIGNED}, dr AS (SELECT vec_id % 7 AS draft, topic FROM mem), ct AS (SELECT topic, count(*) / sum(count(*)) OVER () AS q FROM mem WHERE topic <> -1 AND vec_id % 2 = 0 GROUP BY topic), mi AS (SELECT draft, topic, count(*) / sum(count(*)) OVER (PARTITION BY draft) AS p FROM dr WHERE topic <> -1 GROUP BY draft, topic), x AS (SELECT coalesce(a.draft, mi.draft) AS draft, coalesce(a.topic, mi.topic) AS topic, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT draft, topic, q FROM (SELECT DISTINCT draft FROM dr), ct) a FULL JOIN mi ON a.draft = mi.draft AND a.topic = mi.topic), y AS (SELECT *, round(p - q, 9) AS gap, CASE WHEN round(p - q, 9) > 0.02 THEN 'over' WHEN round(p - q, 9) < -0.02 THEN 'under' ELSE 'even' END AS verdict FROM x) SELECT draft, topic, round(p, 4) AS input_pct, round(q, 4) AS cohort_pct, verdict, CAST(row_number() OVER (PARTITION BY draft, verdict ORDER BY abs(gap) DESC, topic) AS INTEGER) AS place FROM y")(lambda t: M.compared(*_sides(t), "draft"))
query("m4_divergences", f"WITH {_ASSIGNED}, dr AS (SELECT vec_id % 7 AS draft, topic FROM mem), ct AS (SELECT topic, count(*) / sum(count(*)) OVER () AS q FROM mem WHERE topic <> -1 AND vec_id % 2 = 0 GROUP BY topic), mi AS (SELECT draft, topic, count(*) / sum(count(*)) OVER (PARTITION BY draft) AS p FROM dr WHERE topic <> -1 GROUP BY draft, topic), x AS (SELECT coalesce(a.draft, mi.draft) AS draft, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT draft, topic, q FROM (SELECT DISTINCT draft FROM dr), ct) a FULL JOIN mi ON a.draft = mi.draft AND a.topic = mi.topic) SELECT draft, round(sqrt(greatest(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)), 6) AS jsd FROM x GROUP BY draft")(lambda t: M.divergences(*_sides(t), "draft"))


def _sides(t):
    found = members(t)
    return found.select((F.col("vec_id") % 7).alias("draft"), "topic"), found.where("vec_id % 2 = 0").select("topic")


_MEMBERS = "mb AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN -1 ELSE CAST(doc_id % 5 AS INTEGER) END AS topic FROM documents)"
_TERMS = rf"tw AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2) AS ws FROM documents), te AS (SELECT doc_id, unnest(ws) AS term FROM tw UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM tw), ctf AS (SELECT topic, term, count(*) AS tf FROM te JOIN mb USING (doc_id) WHERE topic <> -1 GROUP BY ALL), cn AS (SELECT topic, sum(tf) AS n FROM ctf GROUP BY topic), cw AS (SELECT topic, term, round(tf / n * ln(1 + (SELECT avg(n) FROM cn) / sum(tf) OVER (PARTITION BY term)), 9) AS weight FROM ctf JOIN cn USING (topic)), cr AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS INTEGER) AS rank FROM cw)"


def _by_id(t):
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 11 == 0, -1).otherwise((F.col("doc_id") % 5).cast("int")).alias("topic"))


query("m3_topic_terms", f"WITH {_MEMBERS}, {_TERMS} SELECT * FROM cr WHERE rank <= 10")(lambda t: M.class_terms(V.ngrams(t.documents, "doc_id", "text"), _by_id(t), "doc_id"))
query("m3_topic_table", f"WITH {_MEMBERS}, {_TERMS}, s AS (SELECT topic, count(*) AS size, min(doc_id) AS exemplar FROM mb WHERE topic <> -1 GROUP BY topic), w AS (SELECT topic, string_agg(term, ',' ORDER BY rank) AS top_terms, string_agg(term, '_' ORDER BY rank) FILTER (rank <= 4) AS named FROM cr WHERE rank <= 10 GROUP BY topic) SELECT topic, topic || '_' || named AS label, top_terms, size, exemplar FROM s JOIN w USING (topic)")(lambda t: M.table(_by_id(t), M.class_terms(V.ngrams(t.documents, "doc_id", "text"), _by_id(t), "doc_id"), "doc_id").withColumn("top_terms", F.array_join("top_terms", ",")))
query("m3_fitted_topics")(lambda t: M.assigned(t.embeddings, "vec_id", "embedding", M.fit(t.embeddings, "vec_id", "embedding", 8)))
