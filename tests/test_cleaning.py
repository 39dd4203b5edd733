"""Worn phrases, cleaned tokens, marked letters, excerpts, and schemes of sections on small drafts."""

from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import cleaning as X
from cadenza.operators import drafts as D
from cadenza.operators import retrieval as M
from cadenza.operators import suggest as S


def lines(spark, *texts):
    rows = [(d, k + 1, x) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "id int, line_no int, line string")


def test_cliches(spark):
    df = lines(spark, "Neon lights in the dark\nFIRE fire\n\nfemale, chorus Čoveče", "")
    hits = X.cliche_hits(df, "id", ["fire", "Neon Lights", "in the dark", "čoveče"], ["Female", "chorus"])
    got = {(r.id, r.line_no): (r.tokens, r.terms, r.worn, r.audio) for r in hits.collect()}
    assert got[0, 1] == (5, ["neon lights", "in the dark"], 5, 0) and got[0, 2] == (2, ["fire", "fire"], 2, 0) and got[0, 4] == (3, ["covece"], 1, 2) and got[1, 1] == (0, [], 0, 0)
    report = {r.id: r for r in X.cliche_report(hits, "id").collect()}
    assert (report[0].total_cliches, report[0].density_pct, report[0].lines_hit, report[0].audio_token_count, report[0].audio_lines) == (8, 80.0, 3, 2, 1)
    assert report[1].density_pct == 0.0 and X.cliche_hits(df, "id", [], []).where("worn > 0 or audio > 0").count() == 0


def test_cleaner(spark):
    df = lines(spark, "[Female]\nkeep this male line \n\n  bars bar barsky\nčmale male", "nothing")
    got = X.cleaned_lines(df, "id", ["female", "male", "bar", "bars"])
    rows = {(r.id, r.line_no): (r.line, r.removed, r.emptied) for r in got.collect()}
    assert rows[0, 1] == ("", ["female"], True) and rows[0, 2] == ("keep this  line", ["male"], False) and rows[0, 3] == ("", [], False)
    assert rows[0, 4] == ("    barsky", ["bars", "bar"], False) and rows[0, 5] == ("čmale", ["male"], False)
    whole = {r.id: (r.text, r.removed_count, r.lines_affected) for r in X.cleaned(got, "id").collect()}
    assert whole == {0: ("keep this  line\n\n    barsky\nčmale", 5, 4), 1: ("nothing", 0, 0)}
    assert {r.token: r.n for r in X.removed_tokens(got, "id").collect()} == {"female": 1, "male": 2, "bar": 1, "bars": 1}


def test_marked_letters(spark):
    fold = lambda c: F.lower(T.ascii_fold(c))
    counted = spark.createDataFrame([("šta", 5), ("sta", 9), ("noć", 7), ("noc", 7), ("reč", 4), ("rec", 1), ("dan", 3)], "form string, n int")
    canonical = X.canonical_forms(counted, "form", "n", fold)
    assert {r.folded: r.canonical for r in canonical.collect()} == {"sta": "sta", "noc": "noc", "rec": "reč"}
    df = lines(spark, "Šta šta sta\nrec reč rec\nže ze\nživot život zivot", "sta")
    got = sorted((r.line_no, r.original, r.suggested) for r in X.diacritic_issues(df, "id", canonical, fold).collect())
    assert got == [(1, "sta", "sta"), (2, "reč", "reč"), (4, "zivot", "život")]
    assert sorted((r.line_no, r.suggested) for r in X.diacritic_issues(df, "id", None, fold).collect()) == [(1, "šta"), (2, "rec"), (4, "život")]


def test_excerpts(spark):
    rows = [(1, 0, "intro", k, f"i{k}") for k in range(9)] + [(1, 1, "strofa", 20 + k, f"s{k}") for k in range(5)] + [(1, 2, "refren", 40 + k, f"r{k}") for k in range(2)] + [(1, 3, "refren", 60 + k, f"t{k}") for k in range(6)]
    rows += [(2, 0, "intro", 1, "only")]
    df = spark.createDataFrame(rows, "song int, section int, kind string, ordinal int, line string")
    assert {r.song: r.excerpt for r in M.excerpts(df, "song").collect()} == {1: "t0\nt1\nt2\nt3", 2: "only"}
    one = spark.createDataFrame([(1, "A", None, "x\ny")], "rank int, artist string, title string, excerpt string")
    assert M.few_shot(one, "artist", "title").first().few_shot_block == "--- Example 1 ---\nArtist: A\nTitle: \nExcerpt:\nx\ny\n--- End Example 1 ---"


def test_similar_either_way(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["red blue green", "red blue", "one two", "blue green red", "two three one", "none"])], "k long, text string")
    v = M.tfidf(M.ngrams(texts, "k", "text"), "k", 100)
    drafts, corpus = v.where("k < 2").withColumnRenamed("k", "draft"), v.where("k >= 2")
    got = [sorted(map(tuple, M.similar(drafts, corpus, "draft", "k", 2, n).collect())) for n in (None, 10, M.SENT + 1)]
    assert got[0] == got[1] == got[2] and got[0]
    assert "BroadcastHashJoin" in M.similar(drafts, corpus, "draft", "k", 2, 10)._jdf.queryExecution().toString()


def sections(spark, *texts):
    rows = [(s, k + 1, line) for s, t in enumerate(texts) for k, line in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "section int, ordinal int, line string").withColumn("skel", T.skeleton(F.lower("line")))


def test_schemes_of_sections(spark):
    good = "ovaj plamen\nkose pramen\nbih te mazio\nse pazio"
    df = sections(spark, good, "ovaj plamen\nbih te mazio\nkose pramen\nse pazio", "a\ne\ni\no", good + "\nhvala", "ovaj plamen\nkose pramen")
    got = {r.section: r for r in D.section_schemes(df, ["section"], "AABB").collect()}
    assert [(got[k].detected, got[k].match_pct, got[k].broken) for k in range(5)] == [("AABB", 100.0, []), ("ABAB", 50.0, [1, 2]), ("free", 0.0, [0, 1, 2, 3]), ("AABBC", 80.0, [4]), ("AA", 100.0, [])]
    assert got[0].line_count == 4 and got[0].rhyme_factor > 0 and all(r.broken == [] and r.match_pct == 100.0 for r in D.section_schemes(df, ["section"]).collect())
    fixes = {(r.section, r.line): r for r in D.scheme_fixes(df, D.section_schemes(df, ["section"], "AABB"), ["section"], "AABB").collect()}
    assert {k for k in fixes if k[0] in (0, 3, 4)} == set()
    r = fixes[1, 1]
    assert (r.word, r.expected_letter, r.partner_skeleton, r.candidates) == ("mazio", "A", "ae", ["plamen", "pramen"])
    assert fixes[1, 2].candidates == ["pazio", "mazio"] and fixes[2, 0].candidates == [] and fixes[2, 0].partner_skeleton == "e"
    lone = D.scheme_fixes(df, D.section_schemes(df, ["section"], "ABBC"), ["section"], "ABBC").where("section = 2 and line = 0").first()
    assert lone.partner_skeleton is None and lone.candidates == []


def test_marked_drafts_number_lines(spark):
    marks = S.marked(spark.createDataFrame([(1, "a\n[x]\nb")], "id int, text string"), "id", "text")
    assert [r.ordinal for r in S.lyric_lines(marks).orderBy("line_no").collect()] == [1, 2]
