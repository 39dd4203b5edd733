"""Case tables, brute-force properties, files and streams."""

import json
import math
import random
import re
import struct
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.operators import catalogue as K
from cadenza.operators import corpus as C
from cadenza.operators import drafts as D
from cadenza.operators import intervals as I
from cadenza.operators import rhyme as R
from cadenza.sources import readers, writers
from cadenza.streaming import ingest


def column(spark, values, kind, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


def test_text_cases(spark):
    assert column(spark, ["Љубав ЖИВОТ", "Čaša đaka", None, ""], "string", T.normalize) == ["ljubav zivot", "casa djaka", None, ""]
    assert column(spark, ["čudo kô da1", ""], "string", T.words) == [["čudo", "kô", "da1"], []]
    assert column(spark, ["prst", "more", "krv rat", None], "string", T.syllables) == [1, 2, 2, None]
    assert column(spark, ["prst u more"], "string", T.skeleton) == ["ruoe"]
    assert column(spark, ["Љубав", "x"], "string", T.script) == ["cyrillic", "latin"]
    assert column(spark, ["a - b - c [id9].mp3", "b - c.wav", "c.mp3"], "string", lambda x: F.to_json(T.file_parts(x))) == ['{"date":"a","artist":"b","title":"c","id":"id9"}', '{"artist":"b","title":"c"}', '{"title":"c"}']
    assert column(spark, ["http://x/y/z?q=1", "none"], "string", T.clip_id) == ["z", None]
    assert column(spark, ["x\n[Verse]\ny", "x"], "string", T.from_first_label) == ["[Verse]\ny", "x"]
    assert column(spark, ["C", "F#m", "Bb", "H"], "string", T.pitch) == [0, 6, 10, None]
    assert column(spark, ["a-solo", "a"], "string", lambda x: T.role_of(x)[0]) == ["solo", None]


@pytest.mark.parametrize("label,wanted", [
    ("Strofa 2: Jala & Buba", ("strofa", 2, ["Jala", "Buba"])), ("Buba:Refren", ("refren", None, ["Buba"])), ("Refrain/Refren: X", ("refren", None, ["X"])),
    ("Refren - Jala", ("refren", None, ["Jala"])), ("Refren:", ("refren", None, [])), ("2. Strofa", ("strofa", 2, [])), ("Tekst pesme \"x\"", ("tekst", None, [])),
    ("Instrumentalna pauza", ("instrumental", None, [])), ("", ("other", None, [])), (None, ("other", None, [])), ("Zzz", ("other", None, [])), ("Pre-Chorus 3", ("prerefren", 3, [])), ("Predrefren: X", ("prerefren", None, ["X"])), ("Post-Refern: X", ("postrefren", None, ["X"])), ("Vers", ("strofa", None, [])), ("Prvi", ("strofa", None, [])), ("Završetak", ("outro", None, [])), ("Strofa 1/Couplet 1: X", ("strofa", 1, ["X"])),
])
def test_labels(spark, label, wanted):
    r = column(spark, [label], "string", T.section_label)[0]
    assert (r["type"], r["number"], r["performers"]) == wanted


def songs(spark, n=40, seed=1):
    rng = random.Random(seed)
    rows = [(s, k + 1, "".join(rng.choice("aeior") for _ in range(rng.randrange(9)))) for s in range(n) for k in range(rng.randrange(1, 14))]
    return rows, spark.createDataFrame(rows, "song long, ordinal int, skel string")


def by_rule(skels, least=2):
    out, free = {}, set(range(len(skels)))
    for n in range(max(map(len, skels)), least - 1, -1):
        for suffix in {skels[k][-n:] for k in free if len(skels[k]) >= n}:
            same = [k for k in free if len(skels[k]) >= n and skels[k].endswith(suffix)]
            if len(same) > 1:
                out |= {k: (n, suffix) for k in same}
        free -= set(out)
    return out


def test_rhymes(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows, df = songs(spark)
    wanted = set()
    for s in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == s)
        wanted |= {(s, mine[k][1], *v) for k, v in by_rule([m[2] for m in mine]).items()}
    assert {tuple(r) for r in R.assigned(df, "song").collect()} == wanted
    inner = {(s, k, skel[a : a + m]) for s, k, skel in rows for m in range(2, len(skel) // 2 + 1) for a in range(len(skel) - m + 1) if sum(skel[b : b + m] == skel[a : a + m] for b in range(len(skel) - m + 1)) > 1}
    assert {tuple(r)[:3] for r in R.internal(df, "song").collect()} == inner
    shapes = {r.song: r.letters for r in R.scheme(df, R.assigned(df, "song"), "song").collect()}
    assert set(shapes) == {r[0] for r in rows} and all(v == "free" or v for v in shapes.values())
    few = spark.createDataFrame([(1, k + 1, s) for k, s in enumerate(["aa", "ee", "oaa", "i"])], "song long, ordinal int, skel string")
    assert R.scheme(few, R.assigned(few, "song"), "song").first().letters == "ABAC"


def test_fuzzy_pairs_are_those_of_a_cross_join(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))) for _ in range(80)})

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    left, right = (spark.createDataFrame([(w,) for w in words], f"{c} string") for c in "ab")
    assert {tuple(r) for r in C.fuzzy_pairs(left, right, "a", "b").collect()} == {(a, b) for a in words for b in words if near(a, b)}


def test_divergence(spark):
    def jsd(p, q, **how):
        df = spark.createDataFrame(list(zip(p, q)), "p double, q double")
        return C.divergence(df, **how).first()[0]

    assert jsd([1.0, 1.0], [2.0, 2.0]) == 0 and jsd([1.0, 0.0], [0.0, 1.0]) == 1 and jsd([0.0, 0.0], [0.0, 1.0]) == 0
    assert jsd([3.0, 1.0], [1.0, 2.0]) == jsd([1.0, 2.0], [3.0, 1.0])
    assert abs(jsd([1.0, 0.0], [0.0, 1.0], base=math.e, rooted=True) - math.sqrt(math.log(2))) < 1e-6


def test_merged_intervals_are_disjoint(spark):
    rng = random.Random(3)
    rows = [(k % 5, a := rng.random() * 100, a + rng.random() * 5, rng.random()) for k in range(300)]
    got = I.merged(spark.createDataFrame(rows, "t long, s double, e double, v double"), ["t"], "s", "e", "v", 0.0).orderBy("t", "start").collect()
    assert all(a.t != b.t or a.end < b.start for a, b in zip(got, got[1:])) and sum(r.parts for r in got) == 300


def test_folds_by_brute_force(spark):
    rows = [(1, 0.0, 1.0, 1.0), (1, 0.5, 3.0, 2.0), (1, 2.0, 2.5, 1.0), (1, 4.0, 5.0, 1.0)]
    got = I.survivors(spark.createDataFrame(rows, "t long, s double, e double, v double"), ["t"], "s", "e", "v").orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0.5, 3.0), (4.0, 5.0)]
    values = [0, 5, 1, 9, 2, 8, 0, 7, 0]
    got = I.peaks(spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(values)], "t long, k int, v double"), ["t"], "k", "v", 3.0, 3).orderBy("place").collect()
    assert [r.place for r in got] == [4, 8]


def test_nearest_and_ranges(spark):
    rng = random.Random(4)
    points = [(k % 3, k, rng.randrange(100) / 2) for k in range(60)]
    marks = [(t, rng.randrange(50) * 1.0) for t in range(2) for _ in range(8)]
    p, m = spark.createDataFrame(points, "t long, id long, x double"), spark.createDataFrame(marks, "t long, b double").distinct()
    for r in I.nearest(p, m, ["t"], "x", "b").collect():
        mine = sorted({b for t, b in marks if t == r.t})
        assert r.nearest == (min(mine, key=lambda b: (abs(b - r.x), b)) if mine else None)
    spans = spark.createDataFrame([(t, b, b + 7) for t, b in marks], "t long, s double, e double")
    got = sorted((r.id, r.s) for r in I.within(p, spans, ["t"], "x", "s", "e", 3.0).collect())
    assert got == sorted((i, b) for t, i, x in points for u, b in marks if t == u and b <= x < b + 7)


def test_song_files(spark, tmp_path):
    song = {"title": "Dandara*", "artist": "A", "url": "u", "language": "sr", "raw_lyrics": "x", "clean_lyrics": "x", "sections": [{"label": "Strofa", "content": "a\nb"}]}
    for cat, name, body in (("one-solo", "s.json", song), ("two-duo", "s.json", {**song, "title": "dandara"}), ("two-duo", "bad.json", None), ("two-duo", "_skip.json", song)):
        (tmp_path / cat).mkdir(exist_ok=True)
        (tmp_path / cat / name).write_text(json.dumps(body) if body else "{broken")
    df = readers.songs(spark, str(tmp_path))
    assert sorted((r.category, r.is_bad) for r in df.collect()) == [("one-solo", False), ("two-duo", False), ("two-duo", True)]
    kept, log = readers.unified_index(df)
    assert [r.category for r in kept.collect()] == ["one-solo"] and log.count() == 1
    index = spark.createDataFrame([(1, "t", "Right", ["F"], "one-solo", "u", "ok", "one-solo/s.json")], readers.INDEX)
    assert {r.category: r.primary_artist for r in readers.with_index(df.where("not is_bad"), index).collect()} == {"one-solo": "Right", "two-duo": "A"}


def test_other_files(spark, tmp_path):
    lrc = spark.createDataFrame([("[00:12.5] hello",), ("[ar:someone]",), ("[01:02] x",)], "value string")
    assert sorted((r.second, r.line) for r in readers.timed_lyrics(lrc).collect()) == [(12.5, "hello"), (62.0, "x")]
    (tmp_path / "c.csv").write_text("artist,url\nA,u\nB,u,extra\n")
    rows = readers.candidates(spark, str(tmp_path / "c.csv"), "artist string, url string").cache()
    assert [r.artist for r in rows.where("_corrupt_record is not null").collect()] == ["B"]
    media = tmp_path / "m"
    media.mkdir()
    t = np.arange(8000) / 8000
    with wave.open(str(media / "a.wav"), "wb") as w:
        w.setparams((1, 2, 8000, 0, "NONE", ""))
        x = 0.4 * np.sin(2 * np.pi * 440 * t) + 0.2 * np.sin(2 * np.pi * 523.25 * t)
        w.writeframes(b"".join(struct.pack("<h", int(v * 32767)) for v in x))
    (media / "B.mp3").write_bytes(b"not audio")
    assert [r.path.rsplit("/", 1)[1] for r in readers.media_inventory(spark, str(media), ["mp3", "wav"]).collect()] == ["a.wav", "B.mp3"]
    files = spark.read.format("binaryFile").load(str(media))
    frames = readers.wav_frames(files)
    assert frames.count() == 8000 // 512
    key = readers.key_of(frames, ["path"]).first()
    assert (key.pitch, key.mode) == (9, "minor")
    done = {r.path[-5:]: r for r in readers.each_file(files, lambda path, content: {"n": 1 / (content[:4] == b"RIFF")}, "n double").collect()}
    assert done["a.wav"].error is None and done["B.mp3"].error.startswith("ZeroDivisionError")
    old = readers.manifest(spark, str(media))
    before = spark.createDataFrame(old.collect(), old.schema)
    (media / "B.mp3").write_bytes(b"changed")
    (media / "c.mp3").write_bytes(b"new")
    assert {r.path[-5:]: r.verdict for r in readers.compared(before, readers.manifest(spark, str(media))).collect()} == {"a.wav": "ok", "B.mp3": "changed", "c.mp3": "added"}
    page = spark.createDataFrame([(1, '<head><meta property="og:title" content="T &amp; U"></head><body><div>[A]<br> x </div><script>no</script><p>y</p></body>'), (2, None)], "page_id long, html string")
    assert {r.page_id: (r.title, r.text) for r in readers.pages(page).collect()}[1] in {("T & U", "[A]\nx\ny"), ("", "[A]\nx\ny")}
    bounds = spark.read.schema("track_id long, sections array<struct<label:string,start:string,end:string>>, structure struct<sections:array<struct<label:string,start:string,end:string>>>").json(spark.sparkContext.parallelize(['{"track_id":1,"structure":{"sections":[{"label":"b","start":"5","end":"9"},{"label":"x","start":"3","end":"2"},{"label":"a","start":"1","end":"z"}]}}']))
    assert [r.label for r in readers.boundaries(bounds).collect()] == ["b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "x y", "la"), ("B", None, None)], "artist string, title string, lyrics string")
    writers.corpus_text(df, "artist", "title", "lyrics", str(tmp_path / "t"))
    assert "# A - x y" in [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    writers.markdown(df, ["artist", "title"], str(tmp_path / "md"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "md")).collect()) == ["| A | x y |", "| B |  |"]
    writers.catalogue(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == df.columns
    many = spark.createDataFrame([("A", f"t {k}", f"la {k}") for k in range(300)], "artist string, title string, lyrics string")
    writers.songs(many, "artist", "title", "lyrics", str(tmp_path / "songs"), files=4)
    assert len(list((tmp_path / "songs" / "json").glob("part-*"))) <= 4
    assert [r.lyrics for r in spark.read.json(str(tmp_path / "songs" / "json")).where("slug = 'a-t-7'").collect()] == ["la 7"]
    assert [r.text for r in spark.read.parquet(str(tmp_path / "songs" / "text")).where("slug = 'a-t-7'").collect()] == ["# A - t 7\nla 7\n"]
    writers.tables({"songs": df}, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db/songs")).count() == 2


def test_extracts_datasets_and_liked(spark):
    rows = [("u/1?x", "a.json", "old"), ("u/1?x", "b.json", "new"), ("u/2", "a.json", "only")]
    got = readers.last_extract(spark.createDataFrame(rows, "url string, file string, lyrics string"), "url", "file").collect()
    assert sorted((r.clip_id, r.lyrics) for r in got) == [("1", "new"), ("2", "only")]
    songs_ = spark.createDataFrame([([("A", "Љубав\r\nx "), ("B", None)],)], "songs array<struct<title:string,lyrics:string>>")
    assert [(r.title, r.lyrics_latin) for r in readers.dataset(songs_).collect()] == [("A", "Ljubav\nx"), ("B", None)]
    rows = [(1, "b", "Z", True, ("p", None), "rock"), (2, "b", "a", True, (None, "t"), "pop"), (3, None, "x", True, ("q", "r"), None), (4, "a", "x", False, ("q", "r"), None)]
    df = spark.createDataFrame(rows, "id int, handle string, title string, is_liked boolean, metadata struct<prompt:string,tags:string>, display_tags string")
    assert [(r.id, r.prompt, r.tags) for r in writers.liked(df).collect()] == [(3, "q", "r"), (2, None, "t"), (1, "p", "rock")]
    assert column(spark, ["Ana Ivić: Pesma [id9].mp3", "x" * 80, ""], "string", T.safe_slug) == ["ana-ivic-pesma[id9].mp3", "x" * 50, ""]
    assert column(spark, ["C:\\A\\b.WAV", None], "string", T.path_key) == ["c:/a/b.wav", None]
    marks = spark.createDataFrame([(1, "cafe\u0301 s\u030c", 7), (2, "plain", 8), (3, None, 9)], "id int, text string, n int")
    assert sorted(map(tuple, C.composed(marks, "text").collect())) == [(1, "café š", 7), (2, "plain", 8), (3, None, 9)]


def test_annotate_only_new_rows(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id int").write.parquet(str(tmp_path / "known"))
    spark.createDataFrame([(k, "x") for k in range(1, 6)], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = ingest.annotate_new(spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "known")), "id")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4, 5]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    rows = pd.DataFrame({"id": range(20), "ts": pd.date_range("2024-01-01", periods=20, freq="min")})
    schema = "id long, ts timestamp"

    def add(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))

    add(rows[:10], "a")
    run = lambda: ingest.ingest(spark, schema, str(src), lambda d: d.withColumn("x", F.col("id") * 2), str(out), str(tmp_path / "cp")).awaitTermination(120)
    run()
    add(rows[5:], "b")
    run()
    assert spark.read.parquet(str(out)).count() == 25  # every file once, whatever it holds
    stream = spark.readStream.schema(schema).parquet(str(src))
    for name, df, mode in (("once", ingest.unseen(stream, "id", "ts"), "append"), ("counted", ingest.counters(stream, "id"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == 20
    assert spark.table("counted").where("n = 2").count() == 5
    status = spark.createDataFrame([("a", "failed", 1), ("a", "completed", 2), ("b", "failed", 1)], "source string, status string, finished int")
    assert [r.source for r in ingest.pending(spark.createDataFrame([("a",), ("b",), ("c",)], "source string"), status).orderBy("source").collect()] == ["b", "c"]


def test_sql_surface(spark):
    from cadenza.functions import udfs

    udfs.register(spark)
    r = spark.sql("SELECT vowel_skeleton('prst u more') AS a, count_syllables('prst u more') AS b, count_syllables(CAST(NULL AS STRING)) AS c").first()
    assert (r.a, r.b, r.c) == ("ruoe", 4, None)
    assert {tuple(x) for x in spark.sql("SELECT * FROM internal_rhymes('aeoaeo', 2)").collect()} == {("ae", 2), ("eo", 2), ("aeo", 2)}


def test_cohort_stats_count_every_document(spark, sf_dir):
    import __spark_entry__ as entry

    found = entry.queries()["e3_cohort_stats_whole"](spark, sf_dir).collect()
    there = spark.read.parquet(f"{sf_dir}/documents.parquet").where(r"text rlike '[^\\s]'").groupBy("source", "lang").count().collect()
    assert {(r.source, r.lang): r.songs for r in found} == {(r.source, r.lang): r["count"] for r in there}


def test_draft_and_library_labels(spark):
    assert column(spark, ["Verse 2", "PRE", "Female and Male", "vocal chops", "zzz", None], "string", T.library_label) == ["strofa", "prerefren", "strofa", "strofa", "other", "other"]
    assert column(spark, ["Male - Verse", "Male calls - Female answers", "Female", "Ana - Songs", "Verse", "", None], "string", T.canonical_label) == ["Strofa: Male", "Call-Response: Male & Female", "Refren: Female", None, None, None, None]
    lines = spark.createDataFrame([(1, 1, "[Male -Verse]"), (1, 2, "[Female]"), (1, 3, "a line -x"), (1, 4, "[Verse 1]")], "doc int, no int, line string")
    found = {(r.line_no, r.category, r.severity, r.original, r.suggested, r.auto_safe) for r in D.label_issues(lines, "doc", "no", "line").collect()}
    assert found == {(1, "label", "low", "[Male -Verse]", "[Male - Verse]", True), (1, "label_form", "suggest", "[Male - Verse]", "[Strofa: Male]", False), (2, "label_form", "flag", "[Female]", "[Refren: Female]", False)}


def test_scheme_check(spark):
    df = spark.createDataFrame([(1, [1, 1, 2, 2]), (2, [1, 2, 1, 2, 3]), (3, [])], "k int, scheme array<int>")
    assert {r.k: (r.match, r.broken) for r in D.scheme_check(df, "k", "scheme", "AABB").collect()} == {1: (1.0, []), 2: (0.4, [2, 3, 5]), 3: (1.0, [])}
    assert all(r.match == 1 and not r.broken for r in D.scheme_check(df, "k", "scheme", "").collect())


def test_collab_types(spark):
    rows = [("a-b-trio", []), ("a-duo", ["x"]), ("a-solo", ["x"]), ("a-solo", []), (None, None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, f array<string>")
    assert [r.t for r in df.orderBy("k").select(T.collab_type(F.col("c"), F.col("f")).alias("t")).collect()] == ["trio", "duo", "featured", "solo", "solo"]


def test_collabs(spark):
    rows = [(1, "x-trio", None, "A"), (2, "x-DUO", None, "A"), (3, "x-featured", [], "B"), (4, "solo", ["Ana B"], "C"), (5, "solo", None, "A"), (6, None, [], "D")]
    df = spark.createDataFrame(rows, "id int, category string, featured array<string>, artist string")
    assert sorted((r.id, r.collab_type) for r in K.collabs(df, "category", "featured").collect()) == [(1, "trio"), (2, "solo"), (3, "featured"), (4, "featured"), (6, "solo")]
    assert sorted(r.id for r in K.collabs(df, "category", "featured", F.lit("A"), "artist").collect()) == [1, 2, 4]


def test_attribution_of_sections_without_lines(spark):
    sections = spark.createDataFrame([(1, "a"), (2, "b")], "section int, type string")
    lines = spark.createDataFrame([(1, 3), (1, 4), (1, None)], "section int, syllable_count int")
    assert sorted(map(tuple, K.attribution(sections, lines, ["section"]).collect())) == [(1, "a", 3, 3.5), (2, "b", 0, 0.0)]


def test_chosen_files(spark):
    df = spark.createDataFrame([("b.mp3",), ("a Beat.mp3",), ("c beat.mp3",), (None,), ("d.mp3",)], "name string")
    assert [tuple(r) for r in K.chosen_files(df, "name", [("x", "BEAT"), ("y", "none")]).collect()] == [("x", "a Beat.mp3")]
    assert sorted(r.file for r in K.chosen_files(df.where("name is not null"), "name", [("y", "none")]).collect()) == ["a Beat.mp3", "b.mp3", "c beat.mp3"]
    assert K.chosen_files(df.limit(0), "name", [("y", "none")]).count() == 0


def test_recovery(spark):
    whole = ["t_voice_analysis.json", "recipe.md", "stems/a.wav", "stems/b.wav"]
    rows = [("full", p) for p in whole] + [("few", p) for p in whole[:3]] + [("deep", "x/" + p) for p in whole] + [("seen", p) for p in whole] + [("lost", p) for p in whole]
    tracks = K.completeness(spark.createDataFrame(rows, "slug string, path string"), "slug", "path")
    assert {r.slug: r.is_complete for r in tracks.collect()} == {"full": True, "few": False, "deep": False, "seen": True, "lost": True}
    sources = spark.createDataFrame([(s, f"in/{s}") for s in ("full", "few", "deep", "seen")], "slug string, source string")
    status = spark.createDataFrame([("in/seen", "completed"), ("in/full", "failed")], "source string, status string")
    got = {r.slug: r.outcome for r in K.recovered(tracks, sources, status, "slug", "source").collect()}
    assert got == {"full": "recovered", "few": "incomplete", "deep": "incomplete", "seen": "known", "lost": "no match"}


def test_library_scan(spark, tmp_path):
    for name, body in (("2024/a_metadata.json", {"id": "1", "title": "T"}), ("2024/x/b_metadata.json", {"clip_id": "2", "id": "", "title": ""}), ("c_metadata.json", {}), ("other.json", {"id": "9"}), ("bad_metadata.json", None)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body) if body is not None else "{broken")
    assert sorted(map(tuple, readers.library(spark, str(tmp_path)).collect())) == [("1", "2024", "T"), ("2", "2024/x", "Untitled"), ("c_metadata", "", "Untitled")]


def test_normalize_touches_plain_text_alike(spark):
    assert column(spark, ["ABC đŠ", "Plain Text", "Njegoš", "Њ", "É", "", None], "string", T.normalize) == ["abc djs", "plain text", "njegos", "nj", "é", "", None]
    assert all(ord(c) > 127 for pair in (T.CYRILLIC_TWO, T.CYRILLIC, T.FOLD_TWO) for k in pair for c in k) and all(ord(c) > 127 for c in T.FOLD[0])


def test_song_metrics_by_hand(spark):
    lines = C.lines(spark.createDataFrame([(1, "the cat\nThe Cat\n\ndog"), (2, "..."), (3, None)], "id int, text string"), "text", ["id"])
    got = {r.id: r for r in C.song_metrics(lines, ["id"], ["the"]).collect()}
    assert set(got) == {1, 2}
    assert (got[1].total_words, got[1].unique_words, got[1].line_count, got[1].hook_repetition_max, got[1].hook_repetition_ratio, got[1].english_loanword_rate) == (5, 3, 3, 2, 0.3333, 0.4)
    assert (got[2].total_words, got[2].unique_words, got[2].ttr, got[2].line_count) == (0, 0, 0.0, 1)


def test_rhyme_profile_by_its_parts(spark):
    rows, df = songs(spark, n=25, seed=7)
    df = df.unionAll(spark.createDataFrame([(900, 1, ""), (901, 1, None)], df.schema))
    found = R.assigned(df.where("skel is not null"), "song")
    both = R.song_metrics(df, found, "song").join(R.factor(df, found, "song"), "song")
    assert sorted(map(tuple, R.profile(df, found, "song").collect())) == sorted(map(tuple, both.collect()))
    letters, hits = {}, {}
    for s, _, skel in rows:
        letters[s] = letters.get(s, 0) + len(skel)
    for r in found.collect():
        hits[r.song] = hits.get(r.song, 0) + r.match_length
    for r in R.profile(df, found, "song").where("song < 900").collect():
        assert abs(r.rhyme_factor - (hits.get(r.song, 0) / letters[r.song] if letters[r.song] else 0)) < 1e-4


def test_steps_that_queries_share(spark, sf_dir):
    import __spark_entry__ as entry

    def plan(name, part=None):
        return entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    # A dictionary goes to the texts, not the words to it; texts are dealt once by their key, before they are cut.
    assert "SortMergeJoin" not in plan("t5_phonetic") and "Exchange hashpartitioning(doc_id" not in plan("t5_phonetic")
    assert plan("t6_diacritics").count("Exchange hashpartitioning") == 1
    lines = spark.createDataFrame([(1, 1, "Šta the šta"), (1, 2, "the")], "id int, no int, line string")
    words = spark.createDataFrame([("the", "de"), ("the", "d"), ("sta", "x"), ("šta", "y")], "spelling string, word string")
    got = sorted((r.line_no, r.original, r.suggested) for r in D.phonetic_issues(lines, "id", "no", "line", words).collect())
    assert got == [(1, "the", "d"), (1, "the", "de"), (1, "šta", "y"), (1, "šta", "y"), (2, "the", "d"), (2, "the", "de")]


def test_corpus_is_cut_once_for_suggestions(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.queries()["t13_slang"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("documents.parquet") == 1, plan.count("documents.parquet")


def test_skeletons_of_lines_at_once(spark):
    from cadenza.functions import text as T
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "Rarr a\n  \n r\nerr\nљубав Ђ\n"), (2, None), (3, "")], "id int, text string")
    each = C.lines(df, "text", ["id"]).select("id", "ordinal", T.skeleton(F.col("line_norm")).alias("skel"))
    assert sorted(map(tuple, C.skeletons(df, "text", ["id"]).collect())) == sorted(map(tuple, each.collect())) == [(1, 1, "ara"), (1, 2, "r"), (1, 3, "er"), (1, 4, "ua")]
    assert "regexp_replace" not in C.skeletons(df, "text", ["id"]).where("length(skel) >= 2")._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_repeated_parts_of_many_lines_at_once():
    rng = random.Random(3)
    skels = ["".join(rng.choice("aeiour") for _ in range(rng.choice([0, 3, 9, 40]))) for _ in range(200)] + ["ab" * 20, "a" * 9]
    for n, longest in ((2, None), (2, 3), (3, None)):
        wanted = set()
        for k, x in enumerate(skels):
            for m in range(n, min(len(x) // 2, longest or 99) + 1):
                parts = [x[i : i + m] for i in range(len(x) - m + 1)]
                wanted |= {(k, p, parts.count(p)) for p in parts if parts.count(p) > 1}
        found = list(zip(*R.repeated_parts(skels, n, longest)))
        assert set(found) == wanted and len(found) == len(wanted)
    assert R.blocks([3, 3, 9, 1, 1], 6) == [(0, 2), (2, 3), (3, 5)] and R.blocks([], 6) == []


def test_repeated_parts_leave_python_in_small_batches(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    class Lines:
        schema = spark.createDataFrame([], "song long, ordinal int, skel string").schema
        where = select = lambda self, *_: self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    R.internal(lines := Lines(), "song")
    turns = [(7, 1, "aeiou" * 1200)]
    columns = [pa.array(x, kind) for x, kind in zip(zip(*turns), (pa.int64(), pa.int32(), pa.string()))]
    sent = list(lines.run([pa.record_batch(columns, ["song", "ordinal", "skel"])]))
    assert max(b.nbytes for b in sent) <= 4_100_000  # of 22.5 MB of parts
    made = [sum((r["_high"] * (r["_high"] + 1) - r["_low"] * (r["_low"] + 1)) // 2 for r in runs) for b in sent for runs in b.column(3).to_pylist()]
    assert max(made) <= 2 * R.BYTES and sum(made) == 5 * (3000 * 3001 // 2 - 1)
    parts = R.internal(spark.createDataFrame(turns, Lines.schema), "song").agg(F.count("*"), F.countDistinct("part"), F.sum(F.length("part")))
    assert tuple(parts.first()) == (5 * 2999, 5 * 2999, sum(made))

    rng, skels = random.Random(4), ["aé𝄞o" * 20, "ie" * 30 + "o" + "ie" * 30, "", "\n\n\n\n"]
    skels += ["".join(rng.choice("ae\n") for _ in range(60)) * rng.choice([1, 2]) for _ in range(20)]
    wanted = {(k, p, n) for k, x in enumerate(skels) for m in range(2, len(x) // 2 + 1) for p in {x[i : i + m] for i in range(len(x) - m + 1)} if (n := sum(x.startswith(p, i) for i in range(len(x)))) > 1}
    for some, rows, size in ((skels, 100_000, 1_000_000), (skels[1:], 3, 200), (skels, 1, 1)):
        monkeypatch.setattr(R, "ROWS", rows)
        monkeypatch.setattr(R, "BYTES", size)
        found = list(zip(*R.repeated_parts(some, 2)))
        assert {(k + len(skels) - len(some), *x) for k, *x in found} == {x for x in wanted if x[0] >= len(skels) - len(some)} and len(set(found)) == len(found)
    monkeypatch.undo()
    df = spark.createDataFrame([(k, 1, x) for k, x in enumerate(skels)], Lines.schema)
    assert sorted((r.song, r.part, r.times) for r in R.internal(df, "song").collect()) == sorted(wanted)


def test_terms_of_topics_are_counted_once(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.queries()["m3_topic_terms"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Generate explode") <= 1 and plan.count("ReusedExchange") >= 2


def test_terms_are_cut_in_parts_of_bounded_text(spark, monkeypatch):
    from cadenza.operators import retrieval

    monkeypatch.setattr(C, "DEALT", 50)
    rows = [(k, "one two one two " * 4) for k in range(40)]
    df = spark.createDataFrame([*rows, (3, "one"), (41, None)], "k int, text string")
    assert C.dealt(df, "k", "text").rdd.getNumPartitions() == 52  # 2,563 characters
    assert C.dealt(df.limit(0), "k", "text").rdd.getNumPartitions() == 1
    got = {(r.k, r.term): r.tf for r in retrieval.ngrams(df, "k", "text").collect()}
    assert got[3, "one"] == 9 and got[5, "one two"] == 8 and got[5, "two one"] == 7 and len(got) == 160


def test_pairs_are_made_in_parts_of_bounded_size(spark, monkeypatch):
    from cadenza.plans import library

    rows = [(o, s) for o in range(40) for s in (1, 2, 2 + o % 3)]
    df = spark.createDataFrame([*rows, (None, 1), (None, 2), (50, None), (50, 1)], "l_orderkey long, l_suppkey long")
    monkeypatch.setattr(library, "_JOINED", 5)
    asked, real = [], C.in_parts
    monkeypatch.setattr(C, "in_parts", lambda *a: asked.append(real(*a).rdd.getNumPartitions()) or real(*a))
    got = sorted(map(tuple, library._edges(type("Tables", (), {"lineitem": df})).collect()))
    assert asked == [25]  # 124 rows in parts of 5
    assert got == [("supplier1", "supplier2", 40), ("supplier1", "supplier3", 13), ("supplier1", "supplier4", 13), ("supplier2", "supplier3", 13), ("supplier2", "supplier4", 13)]


def test_slang_takes_words_in_order(spark):
    text = "-- The cat, (sat) on Öl!\n\nthe cat; sat dot \n...\nbig cats"
    slang = spark.createDataFrame([("zap", 2.0), ("dot", 1.0), ("wow", 2.0)], "form string, distinctiveness double")
    lines = C.lines(C.dealt(spark.createDataFrame([(1, text), (2, "zap dot"), (3, "a cat"), (4, None)], "k int, text string"), "k", "text"), "text", ["k"])
    found = D.injected(lines, "k", slang, 0.5)
    got = sorted(map(tuple, found.collect()))
    # 11 words, half of them less the one that is slang: 4 places, in order; a longer word takes a shorter one.
    assert got == [(1, 1, "-- Zap zap, (zap) on Öl!", 3), (1, 2, "zap cat; sat dot", 1), (1, 3, "...", 0), (1, 4, "big cats", 0), (2, 1, "zap dot", 0), (3, 1, "a zap", 1)]
    assert not re.search(r"hashpartitioning\(k#\d+, \d+\), ENSURE", found._jdf.queryExecution().executedPlan().toString())  # texts are shuffled, not their words


def test_python_gets_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages = spark.createDataFrame([(1, "<title>x</title>y"), (2, None)], "page_id int, html string")
    marked = spark.createDataFrame([("e\u0301",), (None,)], "t string")
    for make in (lambda: readers.pages(pages), lambda: readers.song_pages(pages, "page_id"), lambda: C.composed(marked, "t")):
        before = spark.conf.get(name)
        try:
            spark.conf.set(name, "10000")
            rows = make().collect()
            assert len(rows) == 2 and int(spark.conf.get(name)) <= 500
        finally:
            spark.conf.set(name, before)
