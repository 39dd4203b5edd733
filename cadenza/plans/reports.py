"""Structure templates, the discrimination report and component scores: conversations as songs, with cohorts by their id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import report as E
from ..operators import suggest as S
from ..operators import templates as P
from ..sources import readers
from .fingerprints import _ENTITIES, SONGS, _owner, entities, parts
from .lexical import _LEX, _WORDS, ROLES, _labelled, lexicon
from .registry import query
from .suggestions import _SECTION_LINES, DRAFTS, drafts

# ---- templates ----

_PARTS = "pt AS (SELECT conv_id, 'c' || conv_id % 2 AS cohort, section, kind, count(*) FILTER (NOT is_label) AS n_lines FROM marks GROUP BY ALL)"
_TYPES = "ty AS (SELECT cohort, kind, count(*) AS n, CAST(round(avg(n_lines) FILTER (n_lines > 0)) AS BIGINT) AS lines FROM pt GROUP BY ALL)"
_TOP = "top AS (SELECT cohort, ordering, n, CAST(rank AS INTEGER) AS rank FROM (SELECT cohort, ordering, count(*) AS n, row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, min(conv_id)) AS rank FROM (SELECT cohort, conv_id, string_agg(kind, '>' ORDER BY section) AS ordering FROM pt GROUP BY cohort, conv_id) GROUP BY cohort, ordering) WHERE rank <= 20)"


def _template(n: int) -> str:
    schemes = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in P.SCHEMES.items()) + "}"
    return f"""WITH {DRAFTS}, {_PARTS}, {_TYPES}, {_TOP},
tl AS (SELECT cohort, string_split(ordering, '>') AS o, rank FROM top),
lg AS (SELECT cohort, arg_min(o, rank) AS o FROM tl WHERE len(o) >= {n} GROUP BY cohort),
ks AS (SELECT cohort, list(kind ORDER BY n DESC, kind) AS ks FROM ty GROUP BY cohort),
fl AS (SELECT cohort, CASE WHEN list_has_any(ks, ['strofa', 'refren']) THEN list_filter(ks, lambda x: x IN ('strofa', 'refren')) ELSE ks[1:2] END AS f FROM ks),
pg AS (SELECT fl.cohort, CASE WHEN lg.o IS NOT NULL THEN lg.o[1:{n}] ELSE b.o || list_transform(range(len(b.o), {n}), lambda i: f[i % len(f) + 1]) END AS p FROM fl LEFT JOIN lg USING (cohort) JOIN tl b ON b.cohort = fl.cohort AND b.rank = 1),
hk AS (SELECT cohort, CASE WHEN cohort = 'c1' AND len(p) >= 2 AND NOT list_has_any(p[1:2], ['refren', 'hook']) THEN (p[1:1] || ['refren'] || p[2:])[1:{n}] ELSE p END AS p FROM pg),
ex AS (SELECT cohort, unnest(p) AS kind, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS place FROM hk)
SELECT ex.cohort, place, ex.kind, coalesce(ty.lines, 8) AS lines, coalesce({schemes}[ex.kind], 'AABB') AS rhyme_scheme, CAST(sum(coalesce(ty.lines, 8)) OVER (PARTITION BY ex.cohort) AS BIGINT) AS total_lines FROM ex LEFT JOIN ty USING (cohort, kind)"""


def owned_parts(t):
    return _owner(parts(t))


def shaped(sections, n):
    return P.template(sections, "conv_id", "cohort", "section", "kind", "n_lines", n, ("c1",))


query("e27_types", f"WITH {DRAFTS}, {_PARTS}, {_TYPES} SELECT * FROM ty")(lambda t: P.types(owned_parts(t), "cohort", "kind", "n_lines"))
query("e27_cohort_orderings", f"WITH {DRAFTS}, {_PARTS}, {_TOP} SELECT * FROM top")(lambda t: P.orderings(owned_parts(t), "conv_id", "cohort", "section", "kind").withColumn("ordering", F.array_join("ordering", ">")))
query("e27_template", _template(6))(lambda t: shaped(owned_parts(t), 6))
query("e27_filled_template", _template(40))(lambda t: shaped(owned_parts(t), 40))

# ---- discrimination ----


def line_tokens(t):
    return S.lyric_lines(drafts(t)).select("conv_id", "line_no", F.explode(T.words(F.col("line"))).alias("token")).withColumn("script", T.script(F.col("token")))


@query("e16_coverage", f"WITH {DRAFTS}, {_ENTITIES}, tk AS (SELECT conv_id, line_no, unnest({_WORDS.format('line')}) AS token FROM dl), a AS (SELECT count(DISTINCT (conv_id, line_no)) AS annotated_lines, count(*) AS tokens, count(*) FILTER (regexp_matches(token, '[А-Яа-яЁё]')) AS cyrillic FROM tk) SELECT (SELECT count(*) FROM dl) AS total_lines, annotated_lines, round(100 * annotated_lines / (SELECT count(*) FROM dl), 1) AS percent, tokens, cyrillic, tokens - cyrillic AS latin, (SELECT count(*) FROM ent) AS entities FROM a")
def coverage(t):
    return E.coverage(S.lyric_lines(drafts(t)), "line", line_tokens(t), ["conv_id", "line_no"], "script", entities(t))


_SUMMARY = "sm AS (SELECT count(*) AS terms, count(*) FILTER (distinctiveness > 0.5) AS distinct_a, count(*) FILTER (distinctiveness < -0.5) AS distinct_b, count(*) FILTER (abs(distinctiveness) > 1) AS strong FROM lex)"
query("e16_lexicon_summary", f"{_LEX}, {_SUMMARY} SELECT * FROM sm")(lambda t: E.lexicon_summary(lexicon(t)))
query("e16_histogram", f"{_LEX} SELECT CASE WHEN distinctiveness > 2 THEN '>2' WHEN distinctiveness > 1 THEN '1-2' WHEN distinctiveness > 0.5 THEN '0.5-1' WHEN distinctiveness > -0.5 THEN '-0.5 to 0.5' WHEN distinctiveness > -1 THEN '-1 to -0.5' WHEN distinctiveness > -2 THEN '-2 to -1' ELSE '<-2' END AS bucket, count(*) AS n FROM lex GROUP BY bucket")(lambda t: E.histogram(lexicon(t)))
_MIX = "mx AS (SELECT label, count(*) FILTER (vec_id % 2 = 0) / sum(count(*) FILTER (vec_id % 2 = 0)) OVER () AS p, count(*) FILTER (vec_id % 2 = 1) / sum(count(*) FILTER (vec_id % 2 = 1)) OVER () AS q FROM embeddings GROUP BY label), dv AS (SELECT round(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0), 6) AS jsd FROM mx)"


def topic_mix(t):
    s = C.shares(t.embeddings.withColumn("side", F.col("vec_id") % 2), ["side"], "label")
    return C.aligned(s.where("side = 0"), s.where("side = 1"), "label")


query("e16_topic_ratios", f"WITH {_MIX} SELECT label, round(p, 9) AS p, round(q, 9) AS q, CASE WHEN q > 0 THEN round(p / q, 6) ELSE 'infinity'::DOUBLE END AS ratio FROM mx")(lambda t: E.over_represented(topic_mix(t), "label").withColumns({"p": F.round("p", 9), "q": F.round("q", 9), "ratio": F.round("ratio", 6)}))
query("e16_gate", f"{_LEX}, {_SUMMARY}, {_MIX} SELECT jsd, distinct_a > 0 AND distinct_b > 0 AS words_differ, strong > 0 AS words_strong, jsd > 0.05 AS topics_differ, distinct_a > 0 AND distinct_b > 0 AND strong > 0 AND jsd > 0.05 AS passed FROM sm, dv")(lambda t: E.gate(E.lexicon_summary(lexicon(t)), C.divergence(topic_mix(t))))

# ---- scores by component ----

_MEASURES = [c for names in E.COMPONENTS.values() for c in names]
_SCORED = f"""whole AS (SELECT songs.*, line_count, section_count FROM songs JOIN (SELECT conv_id, line_count FROM s1) USING (conv_id) JOIN (SELECT conv_id, count(*) AS section_count FROM dsec GROUP BY conv_id) USING (conv_id)),
multi AS (SELECT conv_id, sum(n) AS n FROM (SELECT conv_id, count(*) AS n FROM sk WHERE length(skel) >= 3 GROUP BY conv_id, right(skel, 3) HAVING count(*) >= 2) GROUP BY conv_id),
dr AS (SELECT whole.* EXCLUDE (pct_multis), round(coalesce(multi.n, 0) / line_count, 4) AS pct_multis FROM whole LEFT JOIN multi USING (conv_id)),
base AS (SELECT cohort, count(*) AS songs, {", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in _MEASURES)} FROM whole GROUP BY cohort),
zs AS (SELECT conv_id, cohort, ttr, hook_repetition_ratio, {", ".join(f"CASE WHEN {c}_std = 0 THEN 0 ELSE ({c} - {c}_mean) / {c}_std END AS z_{c}" for c in _MEASURES if c != E.LEVEL)}, 0 AS z_{E.LEVEL} FROM dr JOIN base USING (cohort)),
cs AS (SELECT conv_id, cohort, ttr, hook_repetition_ratio, {", ".join("greatest(0, least(100, 50 + 25 * (" + " + ".join(f"z_{c}" for c in cs) + f") / {len(cs)})) AS {n}" for n, cs in E.COMPONENTS.items())} FROM zs),
scores AS (SELECT conv_id, cohort, round((structural + rhyme + lexical + repetition) / 4, 2) AS overall, round(structural, 2) AS structural, round(rhyme, 2) AS rhyme, round(lexical, 2) AS lexical, round(repetition, 2) AS repetition, ttr, hook_repetition_ratio FROM cs),
weak AS (SELECT *, CASE WHEN structural <= least(rhyme, lexical, repetition) THEN 'structural' WHEN rhyme <= least(lexical, repetition) THEN 'rhyme' WHEN lexical <= repetition THEN 'lexical' ELSE 'repetition' END AS weakest FROM scores)"""


def measured(t):
    """Conversations by their measures and sections."""
    return _owner(E.measured(_labelled(t), "conv_id", "text", ROLES))


def _baselines(each):
    return E.baselines(each.where("line_count > 0"), "cohort")


def scored(each, *keep):
    """Conversations as drafts, whose multisyllabic share is by lines, against those of their cohort; ``each``: of ``measured``."""
    own = each.where("line_count > 0").withColumn("pct_multis", F.col("line_multis"))
    return E.component_scores(own, _baselines(each), "conv_id", "cohort", keep)


query("e26_baselines", f"WITH RECURSIVE {SONGS}, {_SCORED} SELECT cohort, songs, " + ", ".join(f"round({c}_{k}, 6) AS {c}_{k}" for c in _MEASURES for k in ("mean", "std")) + " FROM base")(lambda t: _baselines(measured(t)).select("cohort", "songs", *(F.round(f"{c}_{k}", 6).alias(f"{c}_{k}") for c in _MEASURES for k in ("mean", "std"))))
query("e26_components", f"WITH RECURSIVE {SONGS}, {_SCORED} SELECT conv_id, cohort, overall, structural, rhyme, lexical, repetition, weakest FROM weak")(lambda t: scored(C.shared(measured(t))))


@query("e38_advice", f"""WITH RECURSIVE {SONGS}, {_SCORED}, {_SECTION_LINES},
tp AS ({_template(6).replace(f"WITH {DRAFTS}, {_PARTS}", f"WITH {_PARTS}")}),
se AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY section) AS INTEGER) AS place, kind, CASE WHEN broken = '' THEN 0 ELSE len(string_split(broken, ',')) END AS n FROM ck JOIN (SELECT DISTINCT conv_id, section, kind FROM ln) USING (conv_id, section))
SELECT conv_id, weakest, place, 'section' AS advice, kind || CASE WHEN rhyme_scheme = '' THEN '' ELSE ' ' || rhyme_scheme END AS subject, CAST(lines AS DOUBLE) AS amount FROM weak JOIN tp USING (cohort) WHERE weakest = 'structural'
UNION ALL SELECT conv_id, weakest, place, CASE WHEN n > 0 THEN 'mend' ELSE 'keep' END, kind, CAST(n AS DOUBLE) FROM weak JOIN se USING (conv_id) WHERE weakest = 'rhyme'
UNION ALL SELECT conv_id, weakest, 1, CASE WHEN ttr > 0.55 THEN 'fewer' WHEN ttr < 0.35 THEN 'more' ELSE 'keep' END, 'distinct words', ttr FROM weak WHERE weakest = 'lexical'
UNION ALL SELECT conv_id, weakest, 1, 'repeat', 'hook', hook_repetition_ratio FROM weak WHERE weakest = 'repetition'""")
def advice(t):
    each = C.shared(measured(t))
    sections = each.select("conv_id", "cohort", F.inline("parts"))
    return E.advice(scored(each, "ttr", "hook_repetition_ratio"), shaped(sections, 6), sections.where("n_lines > 0"), "conv_id", "cohort")

# ---- song pages: a page for each conversation, with a box, labels and what stands above ----

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PAGES = f"""ptext AS (SELECT conv_id, string_split(string_agg('[' || role || ']' || chr(10) || text, chr(10) ORDER BY turn, role, text), chr(10)) AS ls FROM conversations GROUP BY conv_id),
pl AS (SELECT conv_id, x, {_TRIM.format('x')} AS t, i FROM (SELECT conv_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM ptext)),
pm AS (SELECT *, regexp_extract(t, '^\\[(.+?)\\]$', 1) AS l FROM pl),
pn AS (SELECT *, sum(CAST(l <> '' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY i) AS n FROM pm)"""


def song_html(t):
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("_t"), F.concat(F.lit("["), "role", F.lit("]<br>"), safe).alias("_h"))))
    box = F.array_join(F.transform(rows, lambda s: s["_h"]), "<br/>")
    each = t.conversations.where("text is not null and role is not null").groupBy("conv_id").agg(box.alias("_box"))
    head = F.concat(F.lit('<html><head><meta property="og:title" content="Ana (Ft. Ivo) – Other"></head><body><h1>Song '), F.col("conv_id").cast("string"), F.lit(' Lyrics</h1><div data-lyrics-container="true">3 Contributors<br>'))
    return each.select("conv_id", F.concat(head, "_box", F.lit("</div></body></html>")).alias("html"))


@query("a13_song_pages", rf"WITH {_PAGES} SELECT conv_id, 'Song ' || conv_id AS title, 'Ana' AS artist, true AS found, string_agg(regexp_replace(t, '[ \t]+', ' ', 'g'), chr(10) ORDER BY i) FILTER (t <> '') AS clean_lyrics FROM pm GROUP BY conv_id")
def song_pages(t):
    return readers.song_pages(song_html(t), "conv_id").drop("raw_lyrics")


query("a13_page_sections", f"WITH {_PAGES}, g AS (SELECT conv_id, n, max(CASE WHEN l <> '' THEN {_TRIM.format('l')} END) AS label, string_agg(x, chr(10) ORDER BY i) FILTER (l = '') AS content FROM pn GROUP BY conv_id, n) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY n) AS INTEGER) AS place, label, {_TRIM.format('content')} AS content FROM g WHERE content IS NOT NULL")(lambda t: readers.page_sections(readers.song_pages(song_html(t), "conv_id"), "conv_id"))
