"""Templates, reports, component scores, events, slices, stories and song pages on small cases."""

import math
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import intervals as I
from cadenza.operators import report as E
from cadenza.operators import templates as P


def parts(spark, songs):
    rows = [(s, c, k, kind, n) for s, (c, kinds) in songs.items() for k, (kind, n) in enumerate(kinds)]
    return spark.createDataFrame(rows, "song int, cohort string, place int, kind string, n int")


def shape(df, cohort):
    return [(r.kind, r.lines, r.rhyme_scheme) for r in df.where(F.col("cohort") == cohort).orderBy("place").collect()]


def test_template_takes_the_first_ordering_that_is_long_enough(spark):
    short = [("intro", 0), ("strofa", 8)]
    long_ = [("strofa", 9), ("strofa", 8), ("bridge", 4), ("outro", 2)]
    df = parts(spark, {1: ("pop", short), 2: ("pop", short), 3: ("pop", long_), 4: ("drill", long_)})
    ranked = P.orderings(df, "song", "cohort", "place", "kind")
    assert {(r.cohort, tuple(r.ordering), r.n, r.rank) for r in ranked.collect()} == {("pop", ("intro", "strofa"), 2, 1), ("pop", ("strofa", "strofa", "bridge", "outro"), 1, 2), ("drill", ("strofa", "strofa", "bridge", "outro"), 1, 1)}
    out = P.template(df, "song", "cohort", "place", "kind", "n", 3, ("pop",))
    # Verses have 8.25 lines on average; the chorus put second is a type that the cohort has not.
    assert shape(out, "pop") == [("strofa", 8, "AABB"), ("refren", 8, "AABB"), ("strofa", 8, "AABB")]
    assert shape(out, "drill") == [("strofa", 9, "AABB"), ("strofa", 9, "AABB"), ("bridge", 4, "ABAB")]
    assert {(r.cohort, r.total_lines) for r in out.collect()} == {("pop", 24), ("drill", 22)}


def test_template_fills_up_the_most_common_ordering(spark):
    df = parts(spark, {1: ("a", [("intro", 2), ("refren", 4)]), 2: ("a", [("strofa", 6)]), 3: ("b", [("intro", 0), ("outro", 3)]), 4: ("c", [("strofa", 5)])})
    out = P.template(df, "song", "cohort", "place", "kind", "n", 5, ("c",))
    # One song each: the first one's ordering; equally frequent types by name; a section without lines has 8.
    assert [k for k, _, _ in shape(out, "a")] == ["intro", "refren", "refren", "strofa", "refren"]
    assert shape(out, "b") == [("intro", 8, "free"), ("outro", 3, "free"), ("intro", 8, "free"), ("outro", 3, "free"), ("intro", 8, "free")]
    assert [k for k, _, _ in shape(out, "c")] == ["strofa", "refren", "strofa", "strofa", "strofa"]
    assert shape(P.template(df, "song", "cohort", "place", "kind", "n", 1, ("c",)), "c") == [("strofa", 5, "AABB")]
    assert P.template(df.limit(0), "song", "cohort", "place", "kind", "n").count() == 0
    with pytest.raises(ValueError):
        P.template(df, "song", "cohort", "place", "kind", "n", 0)


def test_discrimination(spark):
    lexicon = spark.createDataFrame([(w, d) for w, d in zip("abcdefgh", (2.1, 2.0, 1.0, 0.5, -0.5, -1.0, -2.0, -9.0))], "form string, distinctiveness double")
    assert E.lexicon_summary(lexicon).collect()[0].asDict() == {"terms": 8, "distinct_a": 3, "distinct_b": 3, "strong": 4}
    assert {r.bucket: r.n for r in E.histogram(lexicon).collect()} == {">2": 1, "1-2": 1, "0.5-1": 1, "-0.5 to 0.5": 1, "-1 to -0.5": 1, "-2 to -1": 1, "<-2": 2}
    ratios = E.over_represented(spark.createDataFrame([(1, 0.5, 0.25), (2, 0.5, 0.0), (3, 0.0, 0.75)], "topic int, p double, q double"), "topic")
    assert {r.topic: r.ratio for r in ratios.collect()} == {1: 2.0, 2: math.inf, 3: 0.0}
    jsd = lambda x: spark.createDataFrame([(x,)], "jsd double")
    passed = lambda df, x: E.gate(E.lexicon_summary(df), jsd(x)).collect()[0]
    assert passed(lexicon, 0.06).passed and not passed(lexicon, 0.05).passed
    one = lexicon.where("distinctiveness > 0")
    assert (passed(one, 1.0).words_differ, passed(one, 1.0).words_strong, passed(one, 1.0).passed) == (False, True, False)
    assert not passed(lexicon.limit(0), 1.0).passed


def test_coverage(spark):
    lines = spark.createDataFrame([(1, 1, "a b"), (1, 2, ""), (1, 3, None), (2, 1, "x")], "song int, no int, line string")
    tokens = spark.createDataFrame([(1, 1, "latin"), (1, 1, "cyrillic")], "song int, no int, script string")
    got = E.coverage(lines, "line", tokens, ["song", "no"], "script", tokens.limit(0)).collect()[0]
    assert got.asDict() == {"total_lines": 2, "annotated_lines": 1, "percent": 50.0, "tokens": 2, "cyrillic": 1, "latin": 1, "entities": 0}
    none = E.coverage(lines.limit(0), "line", tokens.limit(0), ["song", "no"], "script", tokens.limit(0)).collect()[0]
    assert set(none.asDict().values()) == {0}


MEASURES = "line_count int, section_count int, rhyme_factor double, pct_multis double, internal_rate double, ttr double, avg_syllables_per_line double, hook_repetition_ratio double"


def test_component_scores_and_advice(spark):
    songs = spark.createDataFrame([("a", 10, 2, 0.2, 0.0, 0.4, 0.3, 8.0, 0.1), ("a", 30, 6, 0.6, 0.0, 0.4, 0.5, 8.0, 0.3), ("b", 5, 1, 0.5, 0.5, 0.5, 0.5, 5.0, 0.5)], f"cohort string, {MEASURES}")
    base = E.baselines(songs, "cohort")
    a = base.where("cohort = 'a'").collect()[0]
    assert (a.songs, a.line_count_mean, a.line_count_std, a.pct_multis_std) == (2, 20.0, 10.0, 0.0)
    drafts = spark.createDataFrame([
        (1, "a", 20, 99, 0.4, 0.9, 0.4, 0.4, 8.0, 0.2),  # the means, but for what has no deviation
        (2, "a", 40, 2, 0.0, 0.0, 0.9, 0.8, 8.0, 0.2),  # lines +2, rhyme factor -2, distinct words +4
        (3, "a", 20, 2, 0.4, 0.0, 0.4, 0.3, 8.0, 0.9),  # distinct words -1, hooks +7
        (4, "a", 0, 2, 0.4, 0.0, 0.4, 0.4, 8.0, 0.2), (5, "a", 20, 2, 0.4, 0.0, 0.4, 0.4, 8.0, None), (6, "none", 1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ], f"id int, cohort string, {MEASURES}")
    scored = E.component_scores(drafts, base, "id", "cohort", ("ttr", "hook_repetition_ratio"))
    got = {r.id: (r.structural, r.rhyme, r.lexical, r.repetition, r.overall, r.weakest) for r in scored.collect()}
    assert got[1] == (50.0, 50.0, 50.0, 50.0, 50.0, "structural")
    assert got[2] == (75.0, 33.33, 100.0, 50.0, 64.58, "rhyme")
    assert got[3] == (50.0, 50.0, 37.5, 100.0, 59.38, "lexical")
    assert got[4][0] == 25.0 and got[5][3:] == (0.0, 37.5, "repetition") and 6 not in got
    templates = P.template(parts(spark, {1: ("a", [("strofa", 8), ("instrumental", 1)])}), "song", "cohort", "place", "kind", "n", 2)
    checked = spark.createDataFrame([(2, 2, "refren", []), (2, 1, "strofa", [1, 3]), (3, 1, "strofa", [0])], "id int, section int, kind string, broken array<int>")
    rows = sorted((r.id, r.place, r.advice, r.subject, r.amount) for r in E.advice(scored, templates, checked, "id", "cohort").collect())
    assert rows[:4] == [(1, 1, "section", "strofa AABB", 8.0), (1, 2, "section", "instrumental", 1.0), (2, 1, "mend", "strofa", 2.0), (2, 2, "keep", "refren", 0.0)]
    assert rows[4] == (3, 1, "more", "distinct words", 0.3) and rows[-1] == (5, 1, "repeat", "hook", None)


def frames(spark, *values, step=0.1):
    return spark.createDataFrame([(k, i, round(i * step, 3), float(x)) for k, xs in enumerate(values) for i, x in enumerate(xs)], "track int, i int, t double, v double")


def test_events(spark):
    quiet = [1.0] * 30
    one = quiet + [30.0, 20.0, 9.0, 0.0] + quiet  # closes three frames on, 9 before it: 9 / (3 mean)
    long_ = quiet + [30.0] * 4 + quiet + [40.0] * 2  # 0.4 s; the last never closes
    got = I.events(frames(spark, one, long_, [1.0] * 9, []), ["track"], ["i"], "t", "v").orderBy("track", "start").collect()
    assert [(r.track, r.start, r.end, r.severity) for r in got] == [(0, 3.0, 3.3, "high"), (1, 3.0, 3.4, "high")]
    soft = I.events(frames(spark, quiet + [30.0, 4.0, 0.0] + quiet), ["track"], ["i"], "t", "v")
    mean = sum(quiet + [30.0, 4.0, 0.0] + quiet) / 63
    assert [round(r.confidence, 9) for r in soft.collect()] == [round(4 / (3 * mean), 9)]
    assert I.events(frames(spark, quiet + [30.0, 0.0] + quiet), ["track"], ["i"], "t", "v", 0.15).count() == 0


def test_smoothed_and_quiet_regions(spark):
    flat = I.smoothed(frames(spark, [2.0] * 40, [5.0]), ["track"], ["i"], "v").collect()
    assert all(abs(r.smooth - r.v) < 1e-12 for r in flat)
    xs = [0.0] * 5 + [4.0] + [0.0] * 5
    weights = [math.exp(-(i * i) / 18) for i in range(-12, 13)]
    got = {r.i: r.smooth for r in I.smoothed(frames(spark, xs), ["track"], ["i"], "v").collect()}
    assert all(abs(got[i] - 4 * weights[12 + i - 5] / sum(weights[12 + j - i] for j in range(11))) < 1e-12 for i in range(11))
    loud = [0.0, 10.0, 10.0, 1.6, 1.4, 0.0, 0.0, 2.5, 0.0, 10.0]  # mean 3.55: opens above 1.065, closes at 0.5325
    regions = I.quiet_regions(frames(spark, loud), ["track"], ["i"], "t", "v", 0.0, 1.0).orderBy("start").collect()
    assert [(r.start, r.end) for r in regions] == [(0.1, 0.5), (0.7, 0.8), (0.9, 0.9)] and regions[0].confidence == 1.0
    assert [(r.start, r.end) for r in I.quiet_regions(frames(spark, loud), ["track"], ["i"], "t", "v", 0.2, 1.0).collect()] == [(0.1, 0.5)]


def test_slices(spark):
    tracks = spark.createDataFrame([(1, 10.0), (2, 4.0), (3, 5.0)], "track int, total double")
    onsets = spark.createDataFrame([(1, 2.0), (1, 5.0), (1, 5.0), (1, 10.0), (2, 1.0), (9, 1.0)], "track int, t double")
    got = sorted((r.track, r.start, r.end) for r in I.onset_slices(onsets, tracks, ["track"], "t", "total").collect())
    assert got == [(1, 2.0, 5.0), (1, 5.0, 10.0), (2, 0.0, 4.0), (3, 0.0, 5.0)]
    beats = spark.createDataFrame([(1, float(b)) for b in range(0, 20, 2)], "track int, b double")
    sections = spark.createDataFrame([(1, 0.9, 9.2, "verse"), (1, 9.2, 10.9, "short"), (1, 11.0, 18.9, "hook"), (2, 1.5, 2.5, "alone")], "track int, s double, e double, label string")
    cut = lambda every: sorted((r.track, r.label, r.start, r.end, r.n) for r in I.section_slices(sections, beats, ["track"], "s", "e", "label", "b", 4.0, every).collect())
    assert cut(None) == [(1, "hook", 10.0, 18.0, 1), (1, "verse", 0.0, 10.0, 1), (2, "alone", 1.5, 2.5, 1)]  # both ends of the short one move to 10
    # Beats inside a section count from its own first one: the second and fourth cut it.
    assert cut(2) == [(1, "hook", 10.0, 12.0, 1), (1, "hook", 12.0, 16.0, 2), (1, "hook", 16.0, 18.0, 3), (1, "verse", 0.0, 2.0, 1), (1, "verse", 2.0, 6.0, 2), (1, "verse", 6.0, 10.0, 3), (2, "alone", 1.5, 2.5, 1)]


def test_stories(spark):
    schema = "story int, id int, start long, duration long, head long, tail long"
    items = spark.createDataFrame([(1, 1, 0, 1000, 100, 200), (1, 2, 5000, 300, 0, 0)], schema)
    new = spark.createDataFrame([(1, 3, None, 400, 0, 0), (1, 4, None, 50, 0, 0), (2, 5, None, 70, 0, 0)], schema)
    assert {r.id: r.start for r in I.appended(items, new, ["story"], ["id"], "start", "duration").collect()} == {3: 5500, 4: 6100, 5: 0}
    pieces = lambda at: sorted((r.id, r.part, r.start, r.head, r.tail) for r in I.split(items, "start", "duration", "head", "tail", F.lit(at)).collect())
    assert pieces(300) == [(1, 0, 0, 100, 600), (1, 1, 300, 400, 200), (2, 0, 5000, 0, 0)]
    assert pieces(0) == pieces(700) == pieces(None) == [(1, 0, 0, 100, 200), (2, 0, 5000, 0, 0)]
    total = I.story_length(items, ["story"], "start", "duration", "head", "tail").collect()
    assert [(r.story, r["items"], r.total) for r in total] == [(1, 2, 5300)]
    kept = I.trimmed(items, "duration", "head", "tail", F.lit(150), F.lit(150)).collect()
    assert sorted((r.id, r.head, r.tail, r.changed) for r in kept) == [(1, 150, 150, True), (2, 0, 0, False)]
    assert not I.trimmed(items, "duration", "head", "tail", F.lit(-1), F.lit(0)).where("changed").count()


PAGE = """<html><head><title>x</title><meta property="og:title" content="{og}"></head><body>{h1}{artist}<nav>menu</nav>{body}</body></html>"""


def page(og="", h1="", artist="", body=""):
    return PAGE.format(og=og, h1=h1, artist=artist, body=body)


def test_song_pages(spark):
    from cadenza.sources import readers

    box = '<div class="c" data-lyrics-container="true">{}</div>'
    rows = [
        (1, page("Ana (Ft. Ivo) \u2013 Other", "<h1> My Song  Lyrics </h1>", '<a data-artist_id="7" href="#"> Ana <b>B</b></a>', box.format("<div>12 Contributors</div><h2>My Song Lyrics</h2><br>[Verse 1: Ana]<br>one   two<br><a href='#'><span>a &amp; b</span></a><br><br>[Chorus]<br>three") + box.format("four<br>[End]"))),
        (2, page("Ana B (Ft. Ivo) \u2013 A \u2013 Title", body='<div class="old lyrics">\n3 Embed\n<p>first</p>\n  [Hook]  \nsecond</div>')),
        (3, page("X - Y - Z", "<h1></h1>", body=box.format("words"))), (4, page("Only", body=box.format(""))), (5, page(h1="<h1>T</h1>", body="<p>nothing here</p>")), (6, None), (7, "<div data-lyrics-container='true'>un<b>closed"),
    ]
    df = spark.createDataFrame(rows, "id int, html string")
    out = readers.song_pages(df, "id", "html")
    got = {r.id: r for r in out.collect()}
    one = got[1]
    assert (one.title, one.artist, one.found) == ("My Song", "AnaB", True)
    assert one.clean_lyrics == "[Verse 1: Ana]\none two\na & b\n[Chorus]\nthree\nfour\n[End]"
    parts = {(r.id, r.place): (r.label, r.content) for r in readers.page_sections(out, "id").collect()}
    assert (parts[1, 1], parts[1, 2]) == (("Verse 1: Ana", "one   two\na & b"), ("Chorus", "three\nfour")) and (1, 3) not in parts
    two = got[2]
    assert (two.title, two.artist, two.clean_lyrics) == ("Title", "Ana B", "first\n[Hook]\nsecond")
    assert (parts[2, 1], parts[2, 2]) == ((None, "first"), ("Hook", "second"))
    assert (got[3].title, got[3].artist) == ("", "X - Y") and (got[4].title, got[4].artist, got[4].clean_lyrics, got[4].found) == ("Only", "Unknown", "", True)
    assert (got[5].title, got[5].artist, got[5].found, got[5].raw_lyrics) == ("T", "Unknown", False, None)
    assert (got[6].title, got[6].found) == ("Unknown", False) and got[7].clean_lyrics == "un\nclosed"
    assert {r.id: r.clean_lyrics for r in readers.song_pages(df, "id", "html", labels=False).collect()}[2] == "first\nsecond"
    assert readers.song_pages(df.limit(0), "id", "html").count() == 0


def test_drafts_are_measured_in_one_pass_as_by_their_parts(spark):
    from cadenza.operators import corpus as C
    from cadenza.operators import drafts as D
    from cadenza.operators import rhyme as R
    from cadenza.operators import suggest as S

    texts = [
        (1, "[Verse]\nmama tata\nmama tata\nkuca vuca\n  \nsama\n[Chorus]\n[Chorus]\nvrt smrt\nbela vrela cela\n[x]"),
        (2, "bez oznake\nbez oznake\nbez oznake\nnula\nprva\nnula"), (3, "[Verse]"), (4, ""), (5, None), (6, "...\n!"), (None, "mama"),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    types = {"verse": "strofa", "chorus": "refren"}
    got = {r.id: r for r in E.measured(df, "id", "text", types).collect()}
    marks = S.marked(df.where("id is not null"), "id", "text", types)
    lines = S.lyric_lines(marks).withColumn("line_norm", T.normalize(F.col("line"))).withColumn("skel", T.skeleton(F.col("line_norm")))
    words = lines.withColumns({"word_count": F.size(T.words(F.col("line_norm"))), "syllable_count": T.syllables(F.col("line_norm"))})
    metrics = {r.id: r for r in C.song_metrics(words, ["id"], []).collect()}
    rhymes = {r.id: r for r in R.profile(lines, R.assigned(lines, "id"), "id").collect()}
    multis = {r.id: r.n for r in R.groups(lines, "id", 3).groupBy("id").agg(F.sum("size").alias("n")).collect()}
    placed = lines.withColumn("ordinal", F.row_number().over(Window.partitionBy("id", "section").orderBy("line_no")))
    broken = {(r.id, r.section): len(r.broken) for r in D.section_schemes(placed, ["id", "section"], "AABB").collect()}
    assert set(got) == {r.id for r in marks.select("id").distinct().collect()} == {1, 2, 3, 6}
    for i, m in metrics.items():
        r = got[i]
        assert [r[c] for c in ("line_count", "ttr", "avg_syllables_per_line", "hook_repetition_ratio")] == [m[c] for c in ("line_count", "ttr", "avg_syllables_per_line", "hook_repetition_ratio")]
        assert [r[c] for c in ("rhyme_factor", "pct_multis", "internal_rate")] == [rhymes[i][c] for c in ("rhyme_factor", "pct_multis", "internal_rate")]
        assert r.line_multis == round(multis.get(i, 0) / m.line_count, 4)
        assert {(i, p.section): p.broken for p in r.parts if p.n_lines} == {k: v for k, v in broken.items() if k[0] == i}
    assert [(p.kind, p.n_lines) for p in got[1].parts] == [("strofa", 4), ("refren", 0), ("refren", 2), ("other", 0)] and got[3].line_count == 0 and got[3].section_count == 1


def test_advice_cuts_the_drafts_once(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.queries()["e38_advice"](spark, sf_dir)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1 and final.count("ReusedExchange") >= 4 and len(re.findall(r"\bWindow\b", final)) <= 12
