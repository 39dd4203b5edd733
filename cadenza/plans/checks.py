"""Draft queries: issues, fixes, scores, suggestions, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import drafts as D
from ..operators import rhyme as R
from .lexical import _SYL, LINES, METRICS, doc_lines, doc_tokens, lexicon, metrics
from .registry import query
from .rhymes import found, skeletons

_RAW = "raw AS (SELECT doc_id, ls[i] AS line, CAST(i AS INTEGER) AS line_no FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
_PHONETIC = {"the": "de", "is": "iz", "that": "det"}


def raw_lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_p", "line")).select("doc_id", (F.col("_p") + 1).alias("line_no"), "line")


def phonetic(t):
    return t.spark.createDataFrame(sorted(_PHONETIC.items()), "spelling string, word string")


def issues(t):
    lines = raw_lines(t)
    return D.all_issues([D.whitespace_issues(lines, "doc_id", "line_no", "line"), D.phonetic_issues(lines, "doc_id", "line_no", "line", phonetic(t)), D.label_issues(lines, "doc_id", "line_no", "line")])


query("t5_phonetic", rf"WITH {_RAW}, w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]+')) AS original FROM raw), p(spelling, suggested) AS (VALUES ('the', 'de'), ('is', 'iz'), ('that', 'det')) SELECT doc_id, line_no, 'phonetic' AS category, 'medium' AS severity, original, suggested, false AS auto_safe FROM w JOIN p ON original = spelling")(lambda t: D.phonetic_issues(raw_lines(t), "doc_id", "line_no", "line", phonetic(t)))
query("t9_all_checks", rf"WITH {_RAW}, w AS (SELECT doc_id, unnest(regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}_]+')) AS w FROM raw), i AS (SELECT doc_id, 'phonetic' AS category, false AS s FROM w WHERE w IN ('the', 'is', 'that') UNION ALL SELECT doc_id, 'whitespace', true FROM raw WHERE contains(line, '  ') OR line LIKE '% ') SELECT doc_id, category, count(*) AS n, count(*) FILTER (s) AS safe FROM i GROUP BY ALL")(lambda t: D.issue_counts(issues(t), "doc_id"))
query("t10_fixed_texts", "SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN contains(x, '  ') OR x LIKE '% ' THEN rtrim(regexp_replace(x, ' {2,}', ' ', 'g'), ' ') ELSE x END), chr(10)) AS text FROM documents")(lambda t: D.apply_fixes(t.documents, issues(t), "doc_id", "text"))
_SCORE = ("ttr", "avg_words_per_line", "avg_syllables_per_line", "hook_repetition_ratio")
_BASE = "b AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _SCORE) + " FROM metrics WHERE lang = 'en')"
query("e26_draft_scores", f"WITH {LINES}, {METRICS}, {_BASE} SELECT doc_id, " + ", ".join(f"round(greatest(0.0, least(100.0, 50 + 25 * CASE WHEN {c}_s = 0 THEN 0 ELSE ({c} - {c}_m) / {c}_s END)), 6) AS {c}_score" for c in _SCORE) + " FROM metrics, b")(lambda t: _scores(t).drop("score", "weakest"))
query("e38_weakest_component")(lambda t: _scores(t).select("doc_id", "weakest"))


def _scores(t):
    m = metrics(t)
    return D.draft_scores(m, D.baselines(m.where("lang = 'en'"), [], list(_SCORE)), "doc_id", list(_SCORE))


query("e36_draft_metrics", f"WITH {LINES.replace('FROM documents', 'FROM (SELECT item_id AS doc_id, NULL AS source, NULL AS lang, text FROM benchmark)')}, {METRICS} SELECT * EXCLUDE (source, lang, doc_id), doc_id AS item_id FROM metrics")(lambda t: C.song_metrics(C.lines(t.benchmark, "text", ["item_id"]), ["item_id"], ["the", "on", "all", "of", "to", "in", "and"]))
query("e25_two_corpora", f"WITH {LINES.replace('FROM documents', 'FROM (SELECT doc_id, ' + repr('corpus') + ' AS source, lang, text FROM documents UNION ALL SELECT -item_id - 1, ' + repr('drafts') + ', ' + repr('en') + ', text FROM benchmark)')}, {METRICS} SELECT source, lang, count(*) AS songs, round(avg(ttr), 6) AS ttr, round(median(total_words), 6) AS words FROM metrics GROUP BY source, lang")(lambda t: _two(t))


def _two(t):
    both = t.documents.select("doc_id", F.lit("corpus").alias("source"), "lang", "text").unionByName(t.benchmark.select((-F.col("item_id") - 1).alias("doc_id"), F.lit("drafts").alias("source"), F.lit("en").alias("lang"), "text"))
    m = C.song_metrics(C.lines(both, "text", ["doc_id", "source", "lang"]), ["doc_id", "source", "lang"], ["the"])
    return m.groupBy("source", "lang").agg(F.count("*").alias("songs"), F.round(F.avg("ttr"), 6).alias("ttr"), F.round(F.median("total_words"), 6).alias("words"))


query("r8_scheme_check")(lambda t: D.scheme_check(R.scheme(skeletons(t), found(t), "doc_id").where("letters <> 'free'"), "doc_id", "scheme", "AABB").withColumn("broken", F.array_join("broken", ",")))
query("r9_partners")(lambda t: D.partner_lines(found(t), "doc_id", "ordinal", "suffix"))
query("t11_slang_injection")(lambda t: D.injected(C.lines(C.dealt(t.documents.select("doc_id", "text"), "doc_id", "text"), "text", ["doc_id"]), "doc_id", C.lexicon_top(lexicon(t), "a", 200).select(F.col("token").alias("form"), "distinctiveness"), 0.02))
query("d13_alternatives", f"WITH {LINES}, n AS (SELECT left(token, 3) AS stem, token, count(*) AS n FROM tokens GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY stem ORDER BY n DESC, token) AS INTEGER) AS rank FROM n) SELECT * FROM r WHERE rank <= 3")(lambda t: D.alternatives(doc_tokens(t).withColumn("stem", F.left("token", F.lit(3))), "stem", "token"))
query("t14_missing_types", "WITH k AS (SELECT conv_id, list(DISTINCT role) AS k FROM conversations GROUP BY conv_id) SELECT conv_id, unnest(list_filter(['system', 'user', 'assistant'], lambda x: NOT list_contains(k, x))) AS missing FROM k")(lambda t: D.missing_types(t.conversations, "conv_id", "role", ["system", "user", "assistant"]))
query("t15_flow", f"WITH x AS (SELECT conv_id, turn, role, {_SYL.format('lower(text)')} / len(string_split(text, chr(10))) AS m FROM conversations), c AS (SELECT role, avg(m) AS c FROM x GROUP BY role) SELECT conv_id, turn, role, CASE WHEN m > c THEN 'split' ELSE 'merge' END AS advice, round(m - c, 6) AS gap FROM x JOIN c USING (role) WHERE abs(m - c) >= 1.5")(lambda t: _flow(t))


def _flow(t):
    from ..functions import text as T

    x = t.conversations.select("conv_id", "turn", "role", (T.syllables(F.col("text")) / F.size(F.split("text", "\n"))).alias("m"))
    return D.flow_suggestions(x, ["conv_id", "turn"], "role", "m", x.groupBy("role").agg(F.avg("m").alias("mean")))


query("m5_annotation", f"WITH {LINES}, lx AS (SELECT DISTINCT token AS form FROM tokens WHERE lang = 'en') SELECT doc_id, count(*) AS n, count(*) FILTER (form IS NULL) AS oov FROM tokens LEFT JOIN lx ON token = form GROUP BY doc_id")(lambda t: D.token_annotations(doc_lines(t), ["doc_id", "ordinal"], doc_tokens(t).where("lang = 'en'").select(F.col("token").alias("form"), F.left("token", F.lit(4)).alias("lemma"), F.lit("X").alias("upos")).distinct()).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("is_oov")).alias("oov")))
query("m4_theme_comparison", "WITH s AS (SELECT vec_id % 2 AS side, label, count(*) / sum(count(*)) OVER (PARTITION BY vec_id % 2) AS share FROM embeddings GROUP BY vec_id % 2, label), a AS (SELECT coalesce(x.label, y.label) AS label, coalesce(x.share, 0) AS p, coalesce(y.share, 0) AS q FROM (SELECT * FROM s WHERE side = 0) x FULL JOIN (SELECT * FROM s WHERE side = 1) y ON x.label = y.label) SELECT label, round(p - q, 6) AS gap, CASE WHEN p - q > 0.02 THEN 'over' WHEN q - p > 0.02 THEN 'under' ELSE 'even' END AS verdict FROM a")(lambda t: _themes(t))


def _themes(t):
    s = C.shares(t.embeddings.withColumn("side", F.col("vec_id") % 2), ["side"], "label")
    gap = F.col("p") - F.col("q")
    return C.aligned(s.where("side = 0"), s.where("side = 1"), "label").select("label", F.round(gap, 6).alias("gap"), F.when(gap > 0.02, "over").when(gap < -0.02, "under").otherwise("even").alias("verdict"))


# Labels of every rule, dealt over the turns: (label, type, number, performers) by the rules, and the other two readings.
FORMS = [
    ("Refren", "refren", None, "", "refren"), ("Strofa 2: Ana & Ivo", "strofa", 2, "Ana,Ivo", "strofa"), ("Pre-Chorus", "prerefren", None, "", "prerefren"), ("Pred-Refren: Ana", "prerefren", None, "Ana", "prerefren"),
    ("Post-Hook", "postrefren", None, "", "postrefren"), ("Završetak: Ivo", "outro", None, "Ivo", "other"), ("Instrumentalna pauza", "instrumental", None, "", "instrumental"), ("Tekst iz isječka", "interlude", None, "", "other"),
    ("Strofa 4 - Ivo", "strofa", 4, "Ivo", "strofa"), ("Ana Ivić:Strofa 1", "strofa", 1, "Ana Ivić", "other"), ("Refrain/Refren: Ana", "refren", None, "Ana", "other"), ("2. Strofa", "strofa", 2, "", "other"),
    ("Songtext zu X", "tekst", None, "", "other"), ("Drop", "hook", None, "", "hook"), ("Female", "other", None, "", "strofa"), ("...", "other", None, "", "other"),
]
_VALUES = ", ".join("({}, '{}', '{}', {}, '{}', '{}')".format(k, f[0], f[1], "NULL" if f[2] is None else f[2], f[3], f[4]) for k, f in enumerate(FORMS))


def _forms(t):
    labels = F.array(*(F.lit(f[0]) for f in FORMS))
    each = t.conversations.select("conv_id", "turn", F.get(labels, ((F.col("conv_id") + F.col("turn")) % len(FORMS)).cast("int")).alias("label"))
    return each.select("conv_id", "turn", "label", T.section_label(F.col("label")).alias("p"), T.library_label(F.col("label")).alias("library"))


query("b9_label_forms", f"WITH f(k, label, type, number, performers, library) AS (VALUES {_VALUES}) SELECT conv_id, turn, label, type, CAST(number AS INTEGER) AS number, performers FROM conversations JOIN f ON (conv_id + turn) % {len(FORMS)} = k")(lambda t: _forms(t).select("conv_id", "turn", "label", "p.type", "p.number", F.array_join("p.performers", ",").alias("performers")))
query("b10_library_label", f"WITH f(k, label, type, number, performers, library) AS (VALUES {_VALUES}) SELECT conv_id, turn, library FROM conversations JOIN f ON (conv_id + turn) % {len(FORMS)} = k")(lambda t: _forms(t).select("conv_id", "turn", "library"))

DRAFT_LABELS = [("Male - Verse", "Strofa: Male"), ("Female - Build-up", "Pred-Refren: Female"), ("Male calls - Female answers", "Call-Response: Male & Female"), ("Female", "Refren: Female"), ("Ana - Songs", None), ("Verse 1", None)]
_DRAFTS = ", ".join("({}, '{}', {})".format(k, a, "NULL" if b is None else f"'{b}'") for k, (a, b) in enumerate(DRAFT_LABELS))


def _draft_labels(t):
    labels = F.array(*(F.lit(a) for a, _ in DRAFT_LABELS))
    each = t.conversations.select("conv_id", "turn", F.get(labels, ((F.col("conv_id") + F.col("turn")) % len(DRAFT_LABELS)).cast("int")).alias("label"))
    return each.select("conv_id", "turn", T.canonical_label(F.col("label")).alias("canonical"))


query("b11_canonical_label", f"WITH f(k, label, canonical) AS (VALUES {_DRAFTS}) SELECT conv_id, turn, canonical FROM conversations JOIN f ON (conv_id + turn) % {len(DRAFT_LABELS)} = k")(_draft_labels)
