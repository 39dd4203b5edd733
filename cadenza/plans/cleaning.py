"""Cleaning and retrieval queries over conversations as drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as X
from ..operators import retrieval as M
from ..operators import suggest as S
from .lexical import _FOLD, _WORDS, ACCENTS, LINES, doc_lines
from .library import _GRAMS
from .registry import query
from .suggestions import DRAFTS, drafts
from ..functions import text as T

TERMS, AUDIO = ["the", "der", "on the", "of the", "de la"], ["is", "and", "in", "ing", "la"]
_ONE, _TWO = [t for t in TERMS if " " not in t], [t for t in TERMS if " " in t]
_HITS = f"""hw AS (SELECT conv_id, line_no, {_WORDS.format('lower(' + _FOLD.format('line') + ')')} AS ws, list_filter({_TWO}, lambda p: contains(lower(line), p)) AS ps FROM dl),
hits AS (SELECT conv_id, line_no, CAST(len(ws) AS INTEGER) AS tokens, list_concat(list_filter(ws, lambda w: list_contains({_ONE}, w)), ps) AS terms, CAST(len(list_filter(ws, lambda w: list_contains({_ONE}, w))) + coalesce(list_sum(list_transform(ps, lambda p: len(string_split(p, ' ')))), 0) AS INTEGER) AS worn, CAST(len(list_filter(ws, lambda w: list_contains({AUDIO}, w))) AS INTEGER) AS audio FROM hw)"""


def _lines(t):
    return S.lyric_lines(drafts(t)).select("conv_id", "line_no", "line")


query("t1_cliche_lines", f"WITH {DRAFTS}, {_HITS} SELECT conv_id, line_no, tokens, array_to_string(terms, ',') AS terms, worn, audio FROM hits")(lambda t: X.cliche_hits(_lines(t), "conv_id", TERMS, AUDIO).withColumn("terms", F.array_join("terms", ",")))
query("t1_cliche_report", f"WITH {DRAFTS}, {_HITS} SELECT conv_id, CAST(sum(worn) AS BIGINT) AS total_cliches, CASE WHEN sum(tokens) > 0 THEN round(100 * sum(worn) / sum(tokens), 2) ELSE 0 END AS density_pct, count(*) FILTER (len(terms) > 0) AS lines_hit, CAST(sum(audio) AS BIGINT) AS audio_token_count, count(*) FILTER (audio > 0) AS audio_lines FROM hits GROUP BY conv_id")(lambda t: X.cliche_report(X.cliche_hits(_lines(t), "conv_id", TERMS, AUDIO), "conv_id"))

# Role lines are bracketed tokens here, so that both kinds of removal occur.
_GONE = ["user", "system", "der", "the", "la"]
_CLEAN = f"""al AS (SELECT conv_id, line_no, line, regexp_replace(line, '(?i)\\[({'|'.join(_GONE)})\\]', '', 'g') AS a, regexp_extract_all(line, '(?i)\\[({'|'.join(_GONE)})\\]', 1) AS b FROM marks),
ar AS (SELECT *, regexp_extract_all(a, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS runs FROM al),
cl AS (SELECT conv_id, line_no, rtrim(array_to_string(list_filter(runs, lambda r: NOT list_contains({_GONE}, lower(r))), ''), ' ') AS line, list_transform(list_concat(b, list_filter(runs, lambda r: list_contains({_GONE}, lower(r)))), lambda x: lower(x)) AS removed, trim(array_to_string(list_filter(runs, lambda r: NOT list_contains({_GONE}, lower(r))), '')) = '' AND trim(line) <> '' AS emptied FROM ar)"""


def _cleaned(t):
    return X.cleaned_lines(drafts(t).select("conv_id", "line_no", "line"), "conv_id", _GONE)


query("t2_cleaned_texts", f"WITH {DRAFTS}, {_CLEAN} SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT emptied), '') AS text, CAST(sum(len(removed)) AS BIGINT) AS removed_count, count(*) FILTER (len(removed) > 0) AS lines_affected FROM cl GROUP BY conv_id")(lambda t: X.cleaned(_cleaned(t), "conv_id"))
query("t2_removed_tokens", f"WITH {DRAFTS}, {_CLEAN} SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(removed) AS token FROM cl) GROUP BY ALL")(lambda t: X.removed_tokens(_cleaned(t), "conv_id"))


def _fold(c):
    return F.translate(c, *ACCENTS)


_F = f"translate({{0}}, '{ACCENTS[0]}', '{ACCENTS[1]}')"
_MARKS = f"""cw AS (SELECT {_WORDS.format('lower(line)')} AS ws FROM lines), cn AS (SELECT form, {_F.format('form')} AS folded, count(*) AS n FROM (SELECT unnest(ws) AS form FROM cw) GROUP BY ALL),
canon AS (SELECT folded, first(form ORDER BY n DESC, form <> folded, form) AS canonical FROM cn GROUP BY folded HAVING count(*) FILTER (form = folded) > 0 AND count(*) FILTER (form <> folded) > 0)"""


def canonical(t):
    counted = doc_lines(t).select(F.explode(T.words(F.col("line"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    return X.canonical_forms(counted, "form", "n", _fold)


query("t6_canonical_forms", f"WITH {LINES}, {_MARKS} SELECT * FROM canon")(canonical)
query("t6_diacritic_issues", f"WITH {LINES}, {_MARKS}, {DRAFTS}, dw AS (SELECT conv_id, line_no, form, {_F.format('form')} AS folded FROM (SELECT conv_id, line_no, unnest({_WORDS.format('lower(line)')}) AS form FROM dl) WHERE length({_F.format('form')}) >= 2), dn AS (SELECT conv_id, folded, form, count(*) AS n FROM dw GROUP BY ALL), dd AS (SELECT conv_id, folded, first(form ORDER BY n DESC, form) AS most FROM dn GROUP BY ALL HAVING count(*) > 1) SELECT DISTINCT conv_id, line_no, 'diacritic_inconsistency' AS category, 'suggest' AS severity, form AS original, coalesce(canonical, most) AS suggested, false AS auto_safe FROM dw JOIN dd USING (conv_id, folded) LEFT JOIN canon USING (folded) WHERE form <> most")(lambda t: X.diacritic_issues(_lines(t), "conv_id", canonical(t), _fold, least=2))

# ---- excerpts and examples ----

_EXCERPTS = """sn AS (SELECT conv_id, section, kind, count(*) AS n FROM dl GROUP BY ALL), sb AS (SELECT conv_id, first(section ORDER BY CASE kind WHEN 'refren' THEN 0 WHEN 'strofa' THEN 1 WHEN 'hook' THEN 2 ELSE 3 END, n DESC, section) AS section FROM sn GROUP BY conv_id), sl AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY line_no) AS r FROM dl JOIN sb USING (conv_id, section)), excerpts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY line_no) AS excerpt FROM sl WHERE r <= 4 GROUP BY conv_id)"""


def excerpts(t):
    return M.excerpts(S.lyric_lines(drafts(t)), "conv_id")


query("m1_excerpts", f"WITH {DRAFTS}, {_EXCERPTS} SELECT * FROM excerpts")(excerpts)


@query("m1_few_shot", f"WITH c AS (SELECT item_id AS k, text FROM benchmark UNION ALL SELECT -conv_id - 1, string_agg(text, chr(10) ORDER BY turn, text) FROM conversations GROUP BY conv_id), {_GRAMS}, {DRAFTS}, {_EXCERPTS} SELECT item_id, doc_id AS conv_id, rank, cosine, '--- Example ' || rank || ' ---' || chr(10) || 'Artist: a' || doc_id % 5 || chr(10) || 'Title: song ' || doc_id || chr(10) || 'Excerpt:' || chr(10) || coalesce(excerpt, '') || chr(10) || '--- End Example ' || rank || ' ---' AS few_shot_block FROM r LEFT JOIN excerpts ON conv_id = doc_id WHERE rank <= 3")
def few_shot(t):
    texts = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"))
    both = t.benchmark.select(F.col("item_id").alias("k"), "text").unionAll(texts.select(-F.col("conv_id") - 1, "text"))
    v = M.tfidf(M.ngrams(both, "k", "text"), "k", 5000)
    corpus = v.where("k < 0").withColumn("conv_id", -F.col("k") - 1).drop("k")
    found = M.similar(v.where("k >= 0").withColumnRenamed("k", "item_id"), corpus, "item_id", "conv_id", 3, draft_terms=M.ngrams(t.benchmark, "item_id", "text").count())
    named = found.join(excerpts(t), "conv_id", "left").withColumns({"artist": F.concat(F.lit("a"), F.col("conv_id") % 5), "title": F.concat(F.lit("song "), F.col("conv_id"))})
    return M.few_shot(named, "artist", "title").select("item_id", "conv_id", "rank", "cosine", "few_shot_block")
