"""Suggestion queries: conversations as drafts (a ``[role]`` line above each turn), documents as the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import drafts as D
from ..operators import rhyme as R
from ..operators import suggest as S
from .lexical import _FOLD, _LEX, _NORM, _SKEL, _labelled, LINES, ROLES, doc_tokens, lang_counts
from .registry import query

_ROLE = "CASE label " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items()) + " END"
DRAFTS = rf"""dtext AS (SELECT conv_id, string_split(string_agg('[' || role || ']' || chr(10) || text, chr(10) ORDER BY turn, role, text), chr(10)) AS ls FROM conversations GROUP BY conv_id),
draw AS (SELECT conv_id, trim(unnest(ls)) AS line, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_no FROM dtext),
dmark AS (SELECT *, regexp_extract(line, '^\[(.+?)\]$', 1) AS label FROM draw WHERE line <> ''),
marks AS (SELECT *, label <> '' AS is_label, sum(CAST(label <> '' AS INTEGER)) OVER w AS section, sum(CAST(label = '' AS INTEGER)) OVER w AS ordinal, coalesce(last_value({_ROLE} IGNORE NULLS) OVER w, 'unknown') AS kind FROM dmark WINDOW w AS (PARTITION BY conv_id ORDER BY line_no)),
dl AS (SELECT * FROM marks WHERE NOT is_label),
dsec AS (SELECT conv_id, section, kind, CAST(coalesce(min(line_no) FILTER (is_label), 0) AS INTEGER) AS line_no FROM marks GROUP BY ALL)"""
_OUT = "conv_id, line_no, direction, category, severity, original, suggested, auto_safe"


def drafts(t):
    return S.marked(_labelled(t), "conv_id", "text", ROLES)


# The corpus has no annotation: four letters stand for the lemma, the last letter for the word class.
_TAG = "CASE WHEN right(token, 1) IN ('e', 'n') THEN 'NOUN' WHEN right(token, 1) IN ('t', 'd') THEN 'VERB' WHEN right(token, 1) = 'r' THEN 'ADJ' ELSE 'X' END"
_FORMS = f"""ct AS (SELECT token AS form, left(token, 4) AS lemma, {_TAG} AS upos, lang FROM tokens),
known AS (SELECT form, lemma, upos, freq FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY freq DESC, lemma, upos) AS r FROM (SELECT form, lemma, upos, count(*) AS freq FROM ct GROUP BY ALL)) WHERE r = 1),
w AS (SELECT conv_id, line_no, word, {_NORM.format('word')} AS form FROM (SELECT conv_id, line_no, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM dl) WHERE length({_NORM.format('word')}) >= 3)"""


def annotated(t):
    return lang_counts(t).select(F.col("token").alias("form"), F.left("token", F.lit(4)).alias("lemma"), F.expr(_TAG).alias("upos"), "lang", "n")


_VOCABULARY = f"""bl AS (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, form) AS r FROM (SELECT lemma, form, count(*) AS n FROM ct WHERE lang = 'en' GROUP BY ALL)),
bt AS (SELECT *, row_number() OVER (PARTITION BY upos ORDER BY n DESC, form) AS r FROM (SELECT upos, form, count(*) AS n FROM ct WHERE lang = 'en' GROUP BY ALL HAVING count(*) >= 5)),
rare AS (SELECT known.* FROM known JOIN (SELECT DISTINCT form FROM w) USING (form) WHERE freq < 5 AND upos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN')),
sl AS (SELECT rare.form, arg_min(bl.form, r) AS other FROM rare JOIN bl ON bl.lemma = rare.lemma AND bl.form <> rare.form GROUP BY rare.form),
st AS (SELECT rare.form, arg_min(bt.form, r) AS other FROM rare JOIN bt ON bt.upos = rare.upos AND bt.form <> rare.form GROUP BY rare.form),
vocabulary AS (SELECT conv_id, line_no, 'vocabulary' AS direction, CASE WHEN sl.other IS NULL THEN 'vocabulary_upos_fallback' ELSE 'vocabulary_same_lemma' END AS category, CASE WHEN sl.other IS NULL THEN 'suggest' ELSE 'safe' END AS severity, word AS original, coalesce(sl.other, st.other) AS suggested, sl.other IS NOT NULL AS auto_safe
  FROM w JOIN rare USING (form) LEFT JOIN sl USING (form) LEFT JOIN st USING (form) WHERE coalesce(sl.other, st.other) IS NOT NULL)"""


def vocabulary(t):
    return S.vocabulary(S.lyric_lines(drafts(t)), "conv_id", annotated(t), F.col("lang") == "en", n="n")


query("t12_vocabulary", f"WITH {LINES}, {DRAFTS}, {_FORMS}, {_VOCABULARY} SELECT * FROM vocabulary")(vocabulary)

_SLANG = f"""dear AS (SELECT form, folded, d FROM (SELECT token AS form, {_NORM.format('token')} AS folded, distinctiveness AS d, row_number() OVER (PARTITION BY {_NORM.format('token')} ORDER BY distinctiveness DESC, token) AS r FROM lex WHERE distinctiveness > 1) WHERE r = 1),
tagged AS (SELECT upos, dear.form, d, row_number() OVER (PARTITION BY upos ORDER BY d DESC, dear.form) AS r FROM dear JOIN known ON known.form = folded),
slang AS (SELECT conv_id, line_no, 'slang' AS direction, 'slang_injection' AS category, 'suggest' AS severity, word AS original, tagged.form AS suggested, false AS auto_safe FROM w JOIN known USING (form) JOIN tagged ON tagged.upos = known.upos AND tagged.r = 1 WHERE known.upos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN') AND w.form NOT IN (SELECT folded FROM dear))"""


def terms(t):
    return C.mined_lexicon(lang_counts(t), "lang", "en", "fr", n="n").select(F.col("token").alias("form"), "distinctiveness")


def slang(t):
    return S.slang(S.lyric_lines(drafts(t)), "conv_id", annotated(t), terms(t), n="n")


query("t13_slang", f"{_LEX}, {DRAFTS}, {_FORMS}, {_SLANG} SELECT * FROM slang")(slang)


@query("d14_slang_by_class", f"{_LEX}, {DRAFTS}, {_FORMS}, {_SLANG} SELECT upos, string_agg(form, ',' ORDER BY r) AS best FROM tagged WHERE r <= 2 GROUP BY upos")
def slang_by_class(t):
    best = S.slang_by_tag(S.distinctive(terms(t), True), S.most_seen(annotated(t), n="n"))
    return best.select("upos", F.array_join(F.transform("best", lambda s: s["form"]), ",").alias("best"))


_STRUCTURE = f"""placed AS (SELECT *, CASE kind WHEN 'intro' THEN 0 WHEN 'hook' THEN 1 WHEN 'refren' THEN 1 WHEN 'strofa' THEN 2 WHEN 'prerefren' THEN 3 WHEN 'bridge' THEN 6 WHEN 'outro' THEN 8 END AS place, row_number() OVER (PARTITION BY conv_id ORDER BY section) AS i FROM dsec),
most AS (SELECT *, max(place) OVER (PARTITION BY conv_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM placed),
nsec AS (SELECT conv_id, count(*) AS n, list(DISTINCT kind) AS kinds FROM dsec GROUP BY conv_id),
seqs AS (SELECT sequence, count(*) AS n FROM (SELECT conv_id, list(kind ORDER BY section) AS sequence FROM dsec WHERE conv_id % 2 = 0 GROUP BY conv_id) GROUP BY sequence ORDER BY n DESC, sequence LIMIT 5),
structure AS (SELECT conv_id, line_no, 'structure' AS direction, 'structure_ordering' AS category, 'suggest' AS severity, kind || ' at position ' || i AS original, 'Move after position ' || (most + 1) || ' in template order' AS suggested, true AS auto_safe FROM most WHERE place < most
  UNION ALL SELECT conv_id, 0, 'structure', 'structure_missing_section', 'safe', '(missing)', label, true FROM nsec, (VALUES ('intro', '[Intro]'), ('hook', '[Hook]'), ('strofa', '[Strofa]'), ('prerefren', '[Pred-Refren]'), ('bridge', '[Prelaz]'), ('outro', '[Završetak]')) AS x(k, label) WHERE NOT list_contains(kinds, k)
  UNION ALL SELECT conv_id, 0, 'structure', 'structure_count_mismatch', 'suggest', n || ' sections', '~' || CAST(round_even(m, 0) AS INTEGER) || ' sections (cohort average)', true FROM nsec, (SELECT round(avg(len(sequence)), 1) AS m FROM seqs) WHERE n < m - 2)"""


def structure(t):
    parts = S.sections(drafts(t), "conv_id")
    return S.structure(parts, "conv_id", S.TEMPLATES["drill_trap"], S.common_sequences(parts.where("conv_id % 2 = 0"), "conv_id"))


query("t14_structure", f"WITH {DRAFTS}, {_STRUCTURE} SELECT * FROM structure")(structure)

_EST = "CAST(list_sum(list_transform(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda v: greatest(len(regexp_extract_all(v, '[aeiou]+')), 1))) AS INTEGER)"
_FLOW = f"""fx AS (SELECT conv_id, section, kind, line_no, coalesce({_EST.format('line')}, 0) AS x FROM dl),
fd AS (SELECT *, x - lag(x) OVER w AS d, row_number() OVER w % 2 AS odd FROM fx WINDOW w AS (PARTITION BY conv_id, section ORDER BY line_no)),
fg AS (SELECT conv_id, section, kind, min(line_no) AS line_no, count(*) AS n, avg(x) AS m, min(x) AS lo, max(x) AS hi, avg(x) FILTER (odd = 1) AS ma, min(x) FILTER (odd = 1) AS loa, max(x) FILTER (odd = 1) AS hia, avg(x) FILTER (odd = 0) AS mb, min(x) FILTER (odd = 0) AS lob, max(x) FILTER (odd = 0) AS hib, min(d) AS dlo, max(d) AS dhi, sum(d) AS total FROM fd GROUP BY ALL HAVING count(*) >= 2),
fp AS (SELECT *, CASE WHEN hi - m <= 1 AND m - lo <= 1 THEN 'uniform' WHEN n >= 4 AND abs(ma - mb) >= 3 AND hia - ma <= 2 AND ma - loa <= 2 AND hib - mb <= 2 AND mb - lob <= 2 THEN 'alternating' WHEN dlo >= -1 AND total >= n THEN 'accelerating' WHEN dhi <= 1 AND total <= -n THEN 'decelerating' ELSE 'free' END AS pattern FROM fg),
fc AS (SELECT kind, avg(x) AS mean, avg(x * x) AS sq FROM fx WHERE conv_id % 2 = 0 GROUP BY kind),
fj AS (SELECT fp.*, round(m, 2) AS u, coalesce(round(mean, 2), (SELECT round(avg(x), 2) FROM fx WHERE conv_id % 2 = 0)) AS c, CASE WHEN sq - mean * mean > 1e-9 THEN sqrt(sq - mean * mean) / mean ELSE 0 END AS cv FROM fp LEFT JOIN fc USING (kind)),
flow AS (SELECT conv_id, line_no, 'flow' AS direction, 'flow_syllable_count' AS category, 'suggest' AS severity, printf('%.2f', u) || ' syllables/line' AS original, printf('%.2f', c) || ' syllables/line (' || CASE WHEN u > c THEN 'split' ELSE 'merge' END || ')' AS suggested, false AS auto_safe FROM fj WHERE c > 0 AND abs(round(u - c, 2)) >= 1.5
  UNION ALL SELECT conv_id, line_no, 'flow', 'flow_pattern_mismatch', 'suggest', pattern, CASE pattern WHEN 'uniform' THEN 'alternating or varied' ELSE 'uniform' END, false FROM fj WHERE pattern = 'uniform' AND n >= 3 AND cv > 0.15 OR pattern = 'alternating' AND cv < 0.05)"""


def flow(t):
    lines = S.lyric_lines(drafts(t))
    return S.flow(lines, "conv_id", lines.where("conv_id % 2 = 0").select("kind", S.estimated_syllables(F.col("line")).alias("syllables")))


query("t15_flow_patterns", f"WITH {DRAFTS}, {_FLOW} SELECT * FROM flow")(flow)


def skeletons(t):
    """Lyric lines with their place among a draft's lines and their skeletons."""
    return S.lyric_lines(drafts(t)).withColumn("skel", T.skeleton(T.normalize(F.col("line"))))


_RHYME = f"""sk AS (SELECT *, {_SKEL.format('line_norm')} AS skel FROM (SELECT *, {_NORM.format('line')} AS line_norm FROM dl)),
rg AS (SELECT conv_id, right(skel, 2) AS suffix, min(ordinal) AS first FROM sk WHERE length(skel) >= 2 GROUP BY ALL HAVING count(*) >= 2),
rm AS (SELECT sk.*, suffix, first FROM sk JOIN rg ON rg.conv_id = sk.conv_id AND rg.suffix = right(skel, 2) AND length(skel) >= 2),
alone AS (SELECT * FROM sk ANTI JOIN rm USING (conv_id, ordinal)),
nearest AS (SELECT alone.conv_id, alone.ordinal, alone.line_no, alone.line, arg_min(rm.suffix, abs(rm.ordinal - alone.ordinal) * 1000000 + rm.first) AS suffix, min(abs(rm.ordinal - alone.ordinal)) AS distance FROM alone JOIN rm ON rm.conv_id = alone.conv_id GROUP BY ALL),
codes AS (SELECT sk.conv_id, sk.ordinal, coalesce(g, top + row_number() OVER (PARTITION BY sk.conv_id, g IS NULL ORDER BY sk.ordinal)) AS code, top FROM sk LEFT JOIN rm USING (conv_id, ordinal) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS g FROM rg) n ON n.conv_id = sk.conv_id AND n.suffix = rm.suffix LEFT JOIN (SELECT conv_id, count(*) AS top FROM rg GROUP BY conv_id) c ON c.conv_id = sk.conv_id),
schemes AS (SELECT conv_id, list(code ORDER BY ordinal) AS codes, string_agg(CASE WHEN code <= 26 THEN chr(CAST(64 + code AS INTEGER)) ELSE '?' END, '' ORDER BY ordinal) AS letters FROM codes WHERE top IS NOT NULL GROUP BY conv_id)"""
_TOP = f"tw AS (SELECT token, n, folded, {_SKEL.format('folded')} AS ws FROM (SELECT token, {_NORM.format('token')} AS folded, count(*) AS n FROM tokens GROUP BY token ORDER BY n DESC, token LIMIT 500))"


def corpus_words(t):
    return S.rhyme_words(doc_tokens(t).groupBy("token").agg(F.count("*").alias("n")), "token", "n")


@query("d11_nearest_group", f"WITH {DRAFTS}, {_RHYME} SELECT conv_id, ordinal, suffix, distance FROM nearest")
def nearest_group(t):
    lines = skeletons(t)
    return S.nearest_group(lines.select("conv_id", "ordinal"), S.matched(lines, "conv_id"), "conv_id").select("conv_id", "ordinal", "suffix", "distance")


_LAST = r"regexp_extract_all(line, '[\p{L}\p{N}_]+')[-1]"
query("r10_isolated_lines", f"WITH {LINES}, {DRAFTS}, {_RHYME}, {_TOP}, nl AS (SELECT *, {_LAST} AS word FROM nearest WHERE {_LAST} IS NOT NULL), b AS (SELECT conv_id, ordinal, arg_min(token, -n * 1000 + r) AS best FROM nl JOIN (SELECT *, row_number() OVER (ORDER BY n DESC, token) AS r FROM tw) ON length(ws) >= 2 AND right(ws, 2) = suffix AND folded <> {_NORM.format('word')} GROUP BY ALL) SELECT conv_id, line_no, 'rhyme' AS direction, 'rhyme_isolated_line' AS category, 'suggest' AS severity, word AS original, coalesce(best, '(word with vowel skeleton ''' || suffix || ''')') AS suggested, false AS auto_safe FROM nl LEFT JOIN b USING (conv_id, ordinal)")(lambda t: S.isolated_lines(skeletons(t), "conv_id", corpus_words(t)))
query("r10_scheme_upgrades", f"WITH {DRAFTS}, {_RHYME} SELECT conv_id, 0 AS line_no, 'rhyme' AS direction, 'rhyme_scheme_upgrade' AS category, 'suggest' AS severity, letters AS original, 'ABAB with internal rhymes' AS suggested, false AS auto_safe FROM schemes WHERE len(list_filter(range(1, len(codes) - 2, 2), lambda i: codes[i] = codes[i + 1] AND codes[i + 2] = codes[i + 3] AND codes[i] <> codes[i + 2])) > 0")(lambda t: S.scheme_upgrades(schemes(t), "conv_id"))


def schemes(t):
    lines = skeletons(t)
    return R.scheme(lines, S.matched(lines, "conv_id").drop("first"), "conv_id").where("letters <> 'free'")


def density(t):
    lines = skeletons(t)
    factors = R.factor(lines, R.assigned(lines, "conv_id"), "conv_id")
    return S.low_density(factors, "conv_id", factors.where("conv_id % 2 = 0"), S.RHYME_FACTORS["drill_trap"])


query("r10_low_density")(density)


@query("t16_suggestion_counts", f"{_LEX}, {DRAFTS}, {_FORMS}, {_VOCABULARY}, {_SLANG}, {_STRUCTURE}, {_FLOW}, every AS (SELECT {_OUT} FROM vocabulary UNION ALL SELECT {_OUT} FROM slang UNION ALL SELECT {_OUT} FROM structure UNION ALL SELECT {_OUT} FROM flow), named AS (SELECT conv_id, category FROM every UNION ALL SELECT conv_id, 'total' FROM every UNION ALL SELECT conv_id, 'auto_safe' FROM every WHERE auto_safe) SELECT conv_id, category, count(*) AS n FROM named GROUP BY ALL")
def counts(t):
    parts = {"vocabulary": vocabulary(t), "slang": slang(t), "structure": structure(t), "flow": flow(t)}
    return S.run(parts, ["vocabulary", "slang", "structure", "flow"], "conv_id")[1]


@query("t16_ordered", f"WITH {DRAFTS}, {_STRUCTURE}, {_FLOW}, every AS (SELECT {_OUT} FROM structure UNION ALL SELECT {_OUT} FROM flow) SELECT {_OUT}, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY line_no, direction, category, original, suggested) AS INTEGER) AS place FROM every")
def ordered(t):
    return S.run({"structure": structure(t), "flow": flow(t)}, ["flow", "structure"], "conv_id")[0]


# ---- drafts' metrics and a cohort's benchmarks ----

_DRAFT_METRICS = f"""mw AS (SELECT conv_id, list_distinct(flatten(list(ws))) AS distinct_, CAST(sum(len(ws)) AS BIGINT) AS word_count, count(*) AS line_count FROM (SELECT conv_id, regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM dl) GROUP BY conv_id),
ml AS (SELECT conv_id, count(*) AS isolated_lines FROM alone GROUP BY conv_id)"""


@query("e36_draft_report", f"WITH {LINES}, {DRAFTS}, {_RHYME}, {_DRAFT_METRICS} SELECT conv_id, word_count, len(distinct_) AS unique_words, round(len(distinct_) / nullif(word_count, 0), 4) AS ttr, line_count, coalesce(letters, 'free') AS rhyme_scheme, coalesce(isolated_lines, 0) AS isolated_lines, (SELECT round(avg(word_count), 2) FROM lines WHERE lang = 'en') AS avg_words_per_line FROM mw LEFT JOIN ml USING (conv_id) LEFT JOIN schemes USING (conv_id)")
def draft_report(t):
    from .lexical import doc_lines

    return S.draft_metrics(skeletons(t), "conv_id").drop("rhyme_factor").crossJoin(F.broadcast(doc_lines(t).where("lang = 'en'").agg(F.round(F.avg("word_count"), 2).alias("avg_words_per_line"))))  # one row


# ---- schemes of sections ----

_SECTION_LINES = f"""ln AS (SELECT conv_id, section, kind, CAST(row_number() OVER (PARTITION BY conv_id, section ORDER BY line_no) AS INTEGER) AS ordinal, line, {_SKEL.format('line_norm')} AS skel FROM (SELECT *, {_NORM.format('line')} AS line_norm FROM dl)),
sgr AS (SELECT *, row_number() OVER (PARTITION BY conv_id, section ORDER BY first) AS g FROM (SELECT conv_id, section, right(skel, 2) AS suffix, min(ordinal) AS first FROM ln WHERE length(skel) >= 2 GROUP BY ALL HAVING count(*) >= 2)),
scd AS (SELECT ln.*, sgr.g, max(sgr.g) OVER (PARTITION BY ln.conv_id, ln.section) AS top FROM ln LEFT JOIN sgr ON sgr.conv_id = ln.conv_id AND sgr.section = ln.section AND length(skel) >= 2 AND sgr.suffix = right(skel, 2)),
sc AS (SELECT *, coalesce(g, coalesce(top, 0) + row_number() OVER (PARTITION BY conv_id, section, g IS NULL ORDER BY ordinal)) AS code FROM scd),
ck AS (SELECT conv_id, section, CAST(count(*) AS INTEGER) AS line_count, CASE WHEN any_value(top) IS NULL THEN 'free' ELSE string_agg(CASE WHEN code <= 26 THEN chr(CAST(64 + code AS INTEGER)) ELSE '?' END, '' ORDER BY ordinal) END AS detected, coalesce(string_agg(ordinal - 1, ',' ORDER BY ordinal) FILTER (top IS NULL OR ordinal > 4 OR code <> [1, 1, 2, 2][ordinal]), '') AS broken, round(100 * (1 - count(*) FILTER (top IS NULL OR ordinal > 4 OR code <> [1, 1, 2, 2][ordinal]) / count(*)), 1) AS match_pct FROM sc GROUP BY conv_id, section)"""


def section_lines(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "section").orderBy("line_no")
    return skeletons(t).withColumn("ordinal", F.row_number().over(w)).select("conv_id", "section", "ordinal", "line", "skel")


def _checked(t):
    return D.section_schemes(section_lines(t), ["conv_id", "section"], "AABB")


query("r8_section_schemes", f"WITH {DRAFTS}, {_SECTION_LINES} SELECT * FROM ck")(lambda t: _checked(t).drop("rhyme_factor").withColumn("broken", F.array_join("broken", ",")))
query("r9_fix_candidates", rf"WITH {DRAFTS}, {_SECTION_LINES}, br AS (SELECT ln.*, [2, 1, 4, 3][ordinal] AS partner FROM ln JOIN ck USING (conv_id, section) WHERE line_count = 4 AND list_contains(string_split(broken, ','), CAST(ordinal - 1 AS VARCHAR))), lw AS (SELECT conv_id, section, ordinal, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT *, regexp_extract_all(line, '[a-zA-Z]+') AS ws FROM ln)), lk AS (SELECT *, {_SKEL.format('lower(w)')} AS s FROM lw), fs AS (SELECT *, min(ordinal * 100000 + p) OVER (PARTITION BY conv_id, section, s) AS firsts FROM lk WHERE length(s) >= 2), pw AS (SELECT br.conv_id, br.section, br.ordinal, coalesce(regexp_extract_all(br.line, '[a-zA-Z]+')[-1], '') AS word, right(o.skel, 2) AS ps, br.partner FROM br JOIN ln o ON o.conv_id = br.conv_id AND o.section = br.section AND o.ordinal = br.partner), cn AS (SELECT pw.conv_id, pw.section, pw.ordinal, lk.w, lk.p AS o FROM pw JOIN lk ON lk.conv_id = pw.conv_id AND lk.section = pw.section AND lk.ordinal = pw.partner WHERE length(ps) >= 2 AND right(s, 2) = ps UNION ALL SELECT pw.conv_id, pw.section, pw.ordinal, fs.w, 1000000 + fs.firsts * 1000000 + fs.ordinal * 100000 + fs.p FROM pw JOIN fs ON fs.conv_id = pw.conv_id AND fs.section = pw.section WHERE length(ps) >= 2 AND right(s, 2) = ps AND fs.w <> pw.word), c1 AS (SELECT conv_id, section, ordinal, w, min(o) AS o FROM cn GROUP BY ALL), c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, section, ordinal ORDER BY o) AS r FROM c1) SELECT pw.conv_id, pw.section, CAST(pw.ordinal - 1 AS INTEGER) AS line, word, ['A', 'A', 'B', 'B'][pw.ordinal] AS expected_letter, ps AS partner_skeleton, coalesce(string_agg(w, ',' ORDER BY r) FILTER (r <= 10), '') AS candidates FROM pw LEFT JOIN c2 ON c2.conv_id = pw.conv_id AND c2.section = pw.section AND c2.ordinal = pw.ordinal GROUP BY ALL")(lambda t: D.scheme_fixes(section_lines(t), _checked(t), ["conv_id", "section"], "AABB").withColumn("candidates", F.array_join("candidates", ",")))
