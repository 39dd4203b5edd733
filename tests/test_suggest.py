"""Suggestions on small drafts and corpora, by the cases their rules name."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import rhyme as R
from cadenza.operators import suggest as S

NISI = """[Male - Verse]
Nisi svesna
Kako bih te mazio
Pitam se
kao u koridi, osecam se kao bull

[Female]
Oseti kako te greje ovaj plamen
Kada oko prsta motam kose pramen"""
AABB = "Oseti kako te greje ovaj plamen\nKada oko prsta motam kose pramen\nNisi svesna kako bih te mazio\nDa li bih se ja tako pazio"
ABAB = "Oseti kako te greje ovaj plamen\nNisi svesna kako bih te mazio\nKada oko prsta motam kose pramen\nDa li bih se ja tako pazio"
AAB = "Oseti kako te greje ovaj plamen\nKada oko prsta motam kose pramen\nPitam se da li si ti sama"


def draft(spark, *texts):
    return S.marked(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text")


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("mazio", "maziti", "VERB")] + [("mazim", "maziti", "VERB")] * 20 + [("koridi", "korid", "NOUN")] + [("ulica", "ulica", "NOUN")] * 16 + [("svesna", "svesan", "ADJ")] * 50
    rows += [("malo", "malo", "ADV")] * 30 + [("brat", "brat", "NOUN"), ("brat", "brati", "VERB"), ("brat", "brat", "NOUN"), ("kes", "kes", "NOUN"), ("ljubav", "ljubav", "NOUN")]
    return spark.createDataFrame([(*r, "drill") for r in rows] + [("pevam", "maziti", "VERB", "pop")] * 90, "form string, lemma string, upos string, cohort string")


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([("brat", 2.5), ("kes", 1.8), ("malo", 0.3), ("Ljubav", -2.0)], "form string, distinctiveness double")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_marks(spark):
    rows = [tuple(r) for r in draft(spark, "la\n[Refren: Ana]\n\n  la la \n[x]\ny\n").select("line_no", "line", "is_label", "section", "kind", "ordinal").orderBy("line_no").collect()]
    assert rows == [(1, "la", False, 0, "unknown", 1), (2, "[Refren: Ana]", True, 1, "refren", 1), (4, "la la", False, 1, "refren", 2), (5, "[x]", True, 2, "other", 2), (6, "y", False, 2, "other", 3)]
    assert got(S.sections(draft(spark, "la\n[Refren]\n[Strofa]\nx"), "id"), "section", "kind", "line_no") == [(0, "unknown", 0), (1, "refren", 2), (2, "strofa", 3)]


def test_most_seen_reading(spark, corpus):
    known = {r.form: (r.lemma, r.upos, r.freq) for r in S.most_seen(corpus).collect()}
    assert known["brat"] == ("brat", "NOUN", 2) and known["mazim"] == ("maziti", "VERB", 20)


def test_vocabulary(spark, corpus):
    found = S.vocabulary(S.lyric_lines(draft(spark, NISI, "mazio Koridi mazio\nko bi malo", "nista ovde")), "id", corpus, F.col("cohort") == "drill")
    assert got(found.where("id = 0"), "line_no", "category", "severity", "original", "suggested", "auto_safe") == [
        (3, "vocabulary_same_lemma", "safe", "mazio", "mazim", True), (5, "vocabulary_upos_fallback", "suggest", "koridi", "ulica", False)]
    assert got(found.where("id = 1"), "line_no", "original", "suggested") == [(1, "Koridi", "ulica"), (1, "mazio", "mazim"), (1, "mazio", "mazim")]
    assert found.where("id = 2").count() == 0
    # Of another cohort the other form of the lemma is another.
    pop = S.vocabulary(S.lyric_lines(draft(spark, "mazio")), "id", corpus, F.col("cohort") == "pop")
    assert got(pop, "suggested") == [("pevam",)]


def test_own_form_is_never_suggested(spark):
    tokens = spark.createDataFrame([("kes", "kes", "NOUN")] * 4 + [("pare", "kes", "NOUN")] * 3, "form string, lemma string, upos string")
    assert got(S.vocabulary(S.lyric_lines(draft(spark, "kes pare")), "id", tokens, F.lit(True)), "original", "suggested") == [("kes", "pare"), ("pare", "kes")]


def test_slang(spark, corpus, terms):
    lines = S.lyric_lines(draft(spark, "ulica brat malo svesna nepoznato\nul"))
    assert got(S.slang(lines, "id", corpus, terms), "original", "suggested", "auto_safe") == [("ulica", "brat", False)]
    assert got(S.slang(lines, "id", corpus, terms, positive=False), "original", "suggested") == [("brat", "Ljubav"), ("ulica", "Ljubav")]
    best = {r.upos: [x.form for x in r.best] for r in S.slang_by_tag(S.distinctive(terms, True), S.most_seen(corpus)).collect()}
    assert best == {"NOUN": ["brat", "kes"]}
    same = S.distinctive(spark.createDataFrame([("čao", 1.5), ("cao", 3.0), ("cao", 1.0)], "form string, distinctiveness double"), True)
    assert got(same, "form", "folded", "distance") == [("cao", "cao", 3.0)]


def test_structure(spark):
    parts = S.sections(draft(spark, "[Strofa]\na\n[Refren]\nb\n[Intro]\nc", "[Intro]\na\n[Hook]\nb\n[Strofa]\nc\n[Pred-Refren]\nd\n[Hook]\ne\n[Prelaz]\nf\n[Outro]\ng"), "id")
    found = S.structure(parts, "id", S.TEMPLATES["drill_trap"])
    assert got(found.where("id = 0 and category = 'structure_missing_section'"), "suggested", "line_no") == [("[Hook]", 0), ("[Pred-Refren]", 0), ("[Prelaz]", 0), ("[Završetak]", 0)]
    assert got(found.where("id = 0 and category = 'structure_ordering'"), "line_no", "original", "suggested") == [
        (3, "refren at position 2", "Move after position 3 in template order"), (5, "intro at position 3", "Move after position 3 in template order")]
    assert got(found.where("id = 1"), "line_no", "original", "suggested") == [(9, "hook at position 5", "Move after position 4 in template order")]
    assert found.where("not auto_safe").count() == 0
    # A refren stands for the hook where the template has one, and the other way round.
    pop = S.structure(S.sections(draft(spark, "[Strofa]\na\n[Hook]\nb\n[Bridge]\nc"), "id"), "id", S.TEMPLATES["pop"])
    assert pop.where("category = 'structure_ordering'").count() == 0


def test_short_drafts(spark):
    long = "\n".join(f"[{k}]\nx" for k in ("Intro", "Strofa", "Hook", "Strofa", "Hook", "Outro"))
    songs = S.sections(draft(spark, long, long, "[Strofa]\nx"), "id")
    common = S.common_sequences(songs, "id")
    assert [(r.n, len(r.sequence)) for r in common.orderBy(F.desc("n")).collect()] == [(2, 6), (1, 1)]
    few = S.structure(S.sections(draft(spark, "[Strofa]\nx"), "id"), "id", [], common)
    assert got(few, "category", "original", "suggested") == [("structure_count_mismatch", "1 sections", "~4 sections (cohort average)")]


@pytest.mark.parametrize("counts,pattern", [([8, 8, 9, 8], "uniform"), ([12, 6, 12, 6], "alternating"), ([12, 6, 12], "free"), ([4, 6, 8, 10, 12], "accelerating"), ([12, 10, 8, 6, 3], "decelerating"), ([3, 12, 5, 5, 14, 2], "free"), ([4, 6, 5, 7, 9], "accelerating"), ([4, 6, 5, 10], "alternating"), ([5], "uniform")])
def test_flow_shapes(spark, counts, pattern):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(counts)], "id int, at int, x int")
    assert S.flow_shape(df, ["id"], "at", "x").first().pattern == pattern


def test_flow(spark):
    line = lambda n: " ".join(["la"] * n)
    text = lambda *ns: "[Strofa]\n" + "\n".join(map(line, ns))
    lines = S.lyric_lines(draft(spark, text(12, 12, 12), text(8, 8), text(5, 5, 5), text(12, 6, 12, 6), text(9)))
    varied = spark.createDataFrame([("strofa", x) for x in (5, 8, 11)], "kind string, syllables int")
    found = S.flow(lines, "id", varied)
    assert got(found.where("category = 'flow_syllable_count'"), "id", "original", "suggested") == [
        (0, "12.00 syllables/line", "8.00 syllables/line (split)"), (2, "5.00 syllables/line", "8.00 syllables/line (merge)")]
    assert got(found.where("category = 'flow_pattern_mismatch'"), "id", "line_no", "original", "suggested") == [(0, 2, "uniform", "alternating or varied"), (2, 2, "uniform", "alternating or varied")]
    even = spark.createDataFrame([("strofa", 9)] * 3, "kind string, syllables int")
    assert got(S.flow(lines, "id", even).where("category = 'flow_pattern_mismatch'"), "id", "original", "suggested") == [(3, "alternating", "uniform")]
    # A type that the cohort lacks is held against all of it.
    other = spark.createDataFrame([("refren", 20)], "kind string, syllables int")
    assert {r.id for r in S.flow(lines, "id", other).where("suggested like '%(merge)'").collect()} == {0, 1, 2, 3}


def skeletons(df):
    return S.lyric_lines(df).withColumn("skel", T.skeleton(T.normalize(F.col("line"))))


def test_rhyme_suggestions(spark):
    lines = skeletons(draft(spark, "[Verse]\n" + AABB, "[Verse]\n" + ABAB, "[Verse]\n" + AAB))
    counted = spark.createDataFrame([("plamen", 10), ("stanes", 9), ("sama", 30), ("ranjen", 9)], "form string, n int")
    words = S.rhyme_words(counted, "form", "n")
    assert got(S.isolated_lines(lines, "id", words), "id", "line_no", "original", "suggested", "auto_safe") == [(2, 4, "sama", "plamen", False)]
    assert got(S.isolated_lines(lines, "id", words.limit(0)), "suggested") == [("(word with vowel skeleton 'ae')",)]
    schemes = R.scheme(lines, S.matched(lines, "id").drop("first"), "id")
    assert {r.id: r.letters for r in schemes.collect()} == {0: "AABB", 1: "ABAB", 2: "AAB"}
    assert got(S.scheme_upgrades(schemes, "id"), "id", "original", "suggested") == [(0, "AABB", "ABAB with internal rhymes")]
    metrics = {r.id: r for r in S.draft_metrics(lines, "id").collect()}
    assert metrics[2].isolated_lines == 1 and metrics[0].rhyme_scheme == "AABB" and metrics[0].word_count == 25 and metrics[0].rhyme_factor > 0
    songs = spark.createDataFrame([(0.5,), (0.58,)], "rhyme_factor double")
    low = S.low_density(S.draft_metrics(lines, "id"), "id", songs, 0.9)
    wanted = {i for i, r in metrics.items() if r.rhyme_factor < 0.54}
    assert {r.id for r in low.collect()} == wanted and all(r.suggested == "RF=0.5400 (cohort median)" for r in low.collect())
    assert {r.suggested for r in S.low_density(S.draft_metrics(lines, "id"), "id", songs.limit(0), 0.999).collect()} == {"RF=0.9990 (cohort median)"}


def test_pairs_side_by_side(spark):
    rows = [([1, 1, 2, 2], True), ([1, 2, 1, 2], False), ([1, 1, 1, 1], False), ([3, 1, 1, 2, 2], False), ([3, 4, 1, 1, 2, 2], True), ([1, 1, 2], False), ([], False)]
    df = spark.createDataFrame(rows, "codes array<int>, wanted boolean")
    assert df.where(S.paired("codes") != F.col("wanted")).count() == 0


def test_nearest_group(spark):
    """Against every pair: the nearest line of a group, of two as near the group that begins first."""
    import random

    draw, rows = random.Random(4), []
    for doc in range(40):
        rows += [(doc, k + 1, draw.choice(["aa", "ee", "oi", "x", "ua", "iu", "uo", "ei"])) for k in range(draw.randrange(1, 14))]
    df = spark.createDataFrame(rows, "id int, ordinal int, skel string")
    found = {(r.id, r.ordinal): (r.suffix, r.distance) for r in S.nearest_group(df, S.matched(df, "id"), "id").collect()}
    wanted = {}
    for doc in range(40):
        mine = [r for r in rows if r[0] == doc]
        groups = {}
        for _, k, s in mine:
            if len(s) >= 2:
                groups.setdefault(s[-2:], []).append(k)
        groups = {s: ks for s, ks in groups.items() if len(ks) > 1}
        for _, k, s in mine:
            if groups and not any(k in ks for ks in groups.values()):
                d, _, suffix = min((min(abs(x - k) for x in ks), ks[0], s2) for s2, ks in groups.items())
                wanted[doc, k] = (suffix, d)
    assert found == wanted and wanted


def test_run(spark, corpus, terms):
    marks = draft(spark, NISI, "[Strofa]\nulica koridi")
    lines = S.lyric_lines(marks)
    parts = {"vocabulary": S.vocabulary(lines, "id", corpus, F.lit(True)), "slang": S.slang(lines, "id", corpus, terms), "structure": S.structure(S.sections(marks, "id"), "id", S.TEMPLATES["pop"])}
    ordered, counts = S.run(parts, ["slang", "structure", "vocabulary", "unknown"], "id")
    mine = [tuple(r) for r in ordered.where("id = 1").orderBy("place").select("line_no", "direction").collect()]
    assert mine == sorted(mine) and {d for _, d in mine} == {"slang", "structure", "vocabulary"}
    stats = {r.category: r.n for r in counts.where("id = 1").collect()}
    assert stats["total"] == len(mine) and stats["auto_safe"] == ordered.where("id = 1 and auto_safe").count() and stats["structure_missing_section"] == 4
    only, _ = S.run(parts, ["slang"], "id")
    assert {r.direction for r in only.collect()} == {"slang"}
    whole = S.report(S.draft_metrics(skeletons(marks), "id"), counts, spark.createDataFrame([(0.5,)], "avg_ttr double"), "id").collect()
    assert {r.id: r.stats["total"] for r in whole} == {r.id: r.n for r in counts.where("category = 'total'").collect()} and all(r.avg_ttr == 0.5 for r in whole)
    with pytest.raises(ValueError):
        S.run(parts, ["unknown"], "id")
