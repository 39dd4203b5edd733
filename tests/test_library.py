"""Searches, cohorts, categories and summaries on small cases."""

from pyspark.sql import functions as F

from cadenza.operators import library as L


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search_and_facets(spark):
    df = spark.createDataFrame([(1, "Night Drive", "Ana", "pop", 90, ["sad", "slow"]), (2, "drive", None, "rap", 120, []), (3, None, "DRIVER", "pop", 140, None), (4, "x", "y", None, None, ["slow"])], "id int, title string, artist string, genre string, tempo int, tags array<string>")
    names = ("title", "artist")
    assert ids(L.search(df)) == [1, 2, 3, 4]
    assert ids(L.search(df, "DRIVE", names)) == [1, 2, 3] and ids(L.search(df, "drive")) == []
    assert ids(L.search(df, "drive", names, {"genre": "pop"})) == [1, 3]
    assert ids(L.search(df, ranges={"tempo": (90, 120)})) == [1, 2]
    assert ids(L.search(df, tags=["slow", "loud"])) == [1, 4]
    assert ids(L.search(df, "100%", names)) == []
    assert sorted((r.facet, r.value) for r in L.facets(df, ["genre", "tags"]).collect()) == [("genre", "pop"), ("genre", "rap"), ("tags", "sad"), ("tags", "slow")]
    got = L.page(df, [F.desc("id")], 1, 2).collect()
    assert [(r.id, r.total) for r in got] == [(3, 4), (2, 4)]
    assert L.page(df, [F.desc("id")], 9, 2).count() == 0


def test_cohorts(spark):
    rows = [(1, "Ana", "featured", ""), (2, "DJ ana & Ivo", "solo", ""), (3, "DJ ana & Ivo", "duo", ""), (4, "Ivo & Ana", "solo", ""), (5, "Else", "solo", "Box"), (6, "Else", "duo", "box"), (7, None, "solo", "box"), (8, "Else", None, "box")]
    df = spark.createDataFrame(rows, "id int, primary string, role string, folder string")
    got = {r.id: r.cohort for r in L.cohorts(df, "primary", "role", "folder", {"Ivo": "b", "Ana": "a"}, {"box": "c"}).collect()}
    # The order of the known artists decides, not that of the names.
    assert got == {1: "a", 2: "b", 3: None, 4: "b", 5: "c", 6: None, 7: "c", 8: None}
    assert {r.cohort for r in L.cohorts(df, "primary", "role", "folder", {}, {}).collect()} == {None}


def test_category_and_description(spark):
    df = spark.createDataFrame([(1, [" Ana X", "ivo"]), (2, ["ANA"]), (3, ["Eva", "Ivo"]), (4, []), (5, None), (6, ["ana", "ivo", "eva"])], "id int, names array<string>")
    variants = {"ana": ["ana"], "ivo": ["ivo", "ivica"], "eva": ["eva"]}
    labels = {("ana", "ivo", "eva"): "trio", ("ana", "ivo"): "duo", ("ana",): "solo"}
    got = {r.id: r.c for r in df.select("id", L.category(F.col("names"), variants, labels, "other").alias("c")).collect()}
    assert got == {1: "duo", 2: "solo", 3: "other", 4: "other", 5: "other", 6: "trio"}
    two = spark.createDataFrame([(1, "x" * 21, "d"), (2, "x" * 20, "d"), (3, None, None)], "id int, plays string, d string")
    assert [r.s for r in two.orderBy("id").select(L.description(F.col("plays"), F.col("d")).alias("s")).collect()] == ["x" * 21, "d", ""]


def test_overlap(spark):
    words = spark.createDataFrame([("one", 5), ("two", 3), ("three", 3), ("rest", 9)], "w string, n long")
    lexicon = spark.createDataFrame([("One", 0.6), ("three", 0.51), ("two", 2.0), ("rest", 0.5), ("absent", -3.0)], "form string, d double")
    got = {r.side: (r.forms, r.percent, r.top) for r in L.overlap(words, "w", "n", lexicon, "form", "d", k=2).collect()}
    assert got == {"a": (3, 55.0, ["one", "three"]), "b": (0, 0.0, [])}
    assert {(r.forms, r.percent) for r in L.overlap(words.limit(0), "w", "n", lexicon, "form", "d").collect()} == {(0, 0.0)}


def test_texts(spark):
    text = "b a\na the b\n\n b a\n  \nb a\na the b\nlast"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n\t\n")], "id int, text string")
    out = L.texts(df, "id", "text", ["the"], 2, 2)
    got = {r.id: r for r in out.collect()}
    one = got[1]
    assert (one.lines, one.words, one.unique_words, one.ttr, one.english) == (6, 13, 4, 0.308, 0.154)
    assert (one.avg_line_chars, one.max_line_chars, one.avg_line_words) == (4.67, 7, 2.17)
    assert [(s.word, s.n) for s in one.top_words] == [("b", 5), ("a", 5)]
    assert [(s.line, s.n) for s in one.hook_lines] == [("b a", 2), ("a the b", 2)]
    assert all((got[k].lines, got[k].words, got[k].ttr, got[k].top_words, got[k].hook_lines) == (0, 0, 0.0, [], []) for k in (2, 3, 4))
    assert L.whole(out).collect()[0].asDict() == {"songs": 4, "total_lines": 6, "total_words": 13, "avg_ttr": 0.077, "avg_english": 0.039}
    none = L.whole(L.texts(df.limit(0), "id", "text")).collect()[0]
    assert (none.songs, none.total_words, none.avg_ttr) == (0, 0, None)


def test_summaries(spark):
    df = spark.createDataFrame([("a", "completed", None, 90.0, 1), ("b", "failed", "x" * 200, 0.0, 2), ("c", "failed", None, None, 3), (None, "failed", "e", 70.0, 0)], "slug string, status string, error string, bpm double, k int")
    assert [(r.measure, r.least, r.most, r.n) for r in L.spans(df, ["bpm"]).collect()] == [("bpm", 70.0, 90.0, 2)]
    assert {r.name: r.n for r in L.frequent(df, "slug").collect()} == {"a": 1, "b": 1, "c": 1, "Unknown": 1}
    assert [(r.name, r.n) for r in L.frequent(df, "status", 1).collect()] == [("failed", 3)]
    assert [(r.slug, len(r.error)) for r in L.failures(df, "status", "failed", "slug", "error", [F.asc("k")], 2).collect()] == [(None, 1), ("b", 120)]
    items = spark.createDataFrame([("a", 5), ("a", 7), ("z", 1)], "slug string, ms long")
    assert {r.slug: (r["items"], r.total) for r in L.contents(df.select("slug"), items, "slug", "ms").collect()} == {"a": (2, 12), "b": (0, 0), "c": (0, 0), None: (0, 0)}
    got = {(r.table, r.column): (r.n, r.nulls) for r in L.audit({"t": df.select("slug", "bpm"), "none": items.limit(0)}).collect()}
    assert got == {("t", "slug"): (4, 1), ("t", "bpm"): (4, 1), ("none", "slug"): (0, 0), ("none", "ms"): (0, 0)}
