"""Track documents, replaced tables, backups, detectors, collaborations, fingerprints and themes on small cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cadenza.operators import audio as A
from cadenza.operators import catalogue as K
from cadenza.operators import collab as B
from cadenza.operators import fingerprint as P
from cadenza.operators import themes as M
from cadenza.sources import readers, tracks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_catalogue_of_tracks(spark, tmp_path):
    full = {"bpm": 92.0, "key": "A", "mode": "minor", "duration_seconds": 180.5, "analysis_backend": "x", "chord_progression": [{"name": c} for c in "ABCDEFG"] + [{}], "instruments": [{"label": "bass"}, {"label": None}, {"label": "kick"}]}
    voice = {"effects_detected": [{"effect": "reverb", "confidence": 0.9}, {"effect": "eq", "confidence": 0.3}, {"effect": "delay", "confidence": 0.31}, {"effect": "x"}]}
    rows = [
        ("a", "completed", write(tmp_path / "a" / "a_analysis.json", json.dumps(full, indent=1)), write(tmp_path / "a" / "a_voice.json", json.dumps(voice))),
        ("b", "completed", write(tmp_path / "b" / "b_analysis.json", "{broken"), str(tmp_path / "b" / "missing.json")),
        ("c", "completed", None, None), ("d", "skipped_long", None, None), ("e", "failed", None, None),
    ]
    status = spark.createDataFrame(rows, "slug string, status string, analysis_json string, voice_json string")
    analysis = tracks.documents(spark, f"{tmp_path}/*/*_analysis.json", tracks.ANALYSIS)
    found = {r.slug: r for r in tracks.catalogue(status, analysis, tracks.documents(spark, f"{tmp_path}/*/*_voice.json", tracks.VOICE)).collect()}
    assert set(found) == {"a", "b", "c"}
    a = found["a"]
    assert (a.bpm, a.key, a.mode, a.backend, a.top_chords, a.top_instruments, a.top_effects) == (92.0, "A", "minor", "x", "A; B; C; D; E; F", "bass; kick", "reverb; delay")
    assert all((found[s].bpm, found[s].key, found[s].top_chords, found[s].top_effects) == (None, "", "", "") for s in "bc")
    assert [r.slug for r in tracks.skipped(status).collect()] == ["d"]


def test_upsert(spark):
    existing = spark.createDataFrame([("full", "words", "old"), ("blank", " ", "old"), ("null", None, "old"), ("alone", "", "old")], "id string, prompt string, title string")
    incoming = spark.createDataFrame([("full", "new", "n", 1), ("blank", "", "n", 2), ("blank", "late", "n2", 3), ("blank", "later", "n3", 4), ("null", "x", "n", 5), ("new", "", "n", 6), ("new", "", "n2", 7)], "id string, prompt string, title string, at int")
    merged, acted = tracks.upserted(existing, incoming, "id", "at", "prompt")
    assert {r["at"]: r.action for r in acted.collect()} == {1: "skipped", 2: "updated", 3: "updated", 4: "skipped", 5: "updated", 6: "saved", 7: "updated"}
    assert {r.id: (r.prompt, r.title) for r in merged.collect()} == {"full": ("words", "old"), "blank": ("late", "n2"), "null": ("x", "n"), "alone": ("", "old"), "new": ("", "n2")}
    none, _ = tracks.upserted(existing, incoming.limit(0), "id", "at", "prompt")
    assert none.count() == 4


def test_replaced_tables(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    assert tracks.current(spark, root) is None
    tracks.replace(spark.range(3), root)
    first = tracks.current(spark, root)
    tracks.replace(first.where("id > 0").unionAll(spark.range(10, 12)), root)
    assert sorted(r.id for r in tracks.current(spark, root).collect()) == [1, 2, 10, 11]
    assert first.count() == 3  # a reader of the old version is not disturbed
    assert [n for n in os.listdir(tmp_path / "table") if n == "_current"] == ["_current"]


def test_backups(spark, tmp_path):
    for k in range(20):
        write(tmp_path / "files" / f"{k}.txt", f"content {k}")
    root = f"{tmp_path}/files"
    manifest = spark.createDataFrame(readers.manifest(spark, root).select("path", "sha256").collect())
    assert {r.verdict for r in tracks.verified(spark, manifest, root, 10).collect()} == {"ok"} and tracks.verified(spark, manifest, root, 10).count() == 10
    assert [r.path for r in tracks.sampled(manifest, 5, 1).collect()] == [r.path for r in tracks.sampled(manifest.repartition(3), 5, 1).collect()]
    chosen = sorted(r.path for r in tracks.sampled(manifest, 10, 7).collect())
    os.remove(chosen[0].removeprefix("file:"))
    write(tmp_path / "files" / chosen[1].split("/")[-1], "other")
    verdicts = {r.path: r.verdict for r in tracks.verified(spark, manifest, root, 10, 7).collect()}
    assert sorted(verdicts) == chosen and verdicts[chosen[0]] == "missing" and verdicts[chosen[1]] == "changed" and list(verdicts.values()).count("ok") == 8
    rows = [("a", "2026-01-10T00:00:00", 5, True), ("a", "2026-01-01T00:00:00", 4, True), ("b", "2026-01-01T00:00:00", 1, True), ("c", "2026-01-12T00:00:00", 1, False), ("d", "never", 1, True), ("e", None, 0, None)]
    df = spark.createDataFrame(rows, "target string, created string, file_count int, verified boolean")
    state = {r.target: r for r in tracks.backup_state(df, F.lit("2026-01-12T12:00:00").cast("timestamp")).collect()}
    assert {t: r.ok for t, r in state.items()} == {"a": True, "b": False, "c": False, "d": False, "e": False}
    assert state["a"].file_count == 5 and state["b"].reason == "backup is 11d old or unverified" and state["d"].reason == "invalid timestamp" and state["c"].age_days == 0


def test_detectors(spark):
    frames = spark.createDataFrame([(k % 2, k, float(k)) for k in range(10)], "track int, at int, rms double")
    run = [("Pitch shift", lambda f: {"confidence": 0.2}), ("EQ/Filtering", lambda f: 1 / 0), ("Reverb", lambda f: {"effect": "reverb", "confidence": 0.2, "params": {"first": f["rms"].iloc[0]}, "evidence": ["tail"]}), ("Delay", lambda f: {"confidence": f["rms"].max() / 10})]
    found = A.detected(frames, ["track"], "at", run)
    mine = sorted((tuple(r) for r in A.ranked(found, ["track"]).where("track = 1").collect()), key=lambda r: r[-1])
    assert [(r[2], r[3]) for r in mine] == [("delay", 0.9), ("pitch_shift", 0.2), ("reverb", 0.2), ("eq_filtering", 0.0)]
    assert mine[2][4] == {"first": 1.0} and mine[3][5] == ["Error during analysis: division by zero"]
    whole = {r.track: r for r in A.summary(frames, found.where("track = 1"), ["track"], {"rms": 1}).collect()}
    assert (whole[1].rms, whole[1].top_effects, len(whole[1].effects)) == (5.0, "delay", 4) and (whole[0].effects, whole[0].top_effects) == ([], "")


def test_collaborations(spark):
    rows = [(1, "x", ["Ana", "IVO"]), (2, "x", ["ANA M"]), (3, "x-solo", None), (4, "x", ["Mia"])]
    df = spark.createDataFrame(rows, "id int, category string, featured array<string>")
    assert sorted(r.id for r in K.collabs(df, "category", "featured", F.lit("Ana")).collect()) == [1, 2]
    songs = spark.createDataFrame([("a", "x-solo", 8.0, 0.5), ("a", "X-DUO", 9.0, 0.0), ("a", "x-featured", 11.0, 0.0), ("b", "x-solo", 7.0, 0.4), ("c", None, 1.0, 1.0)], "artist string, category string, avg_syllables_per_line double, ttr double")
    got = {r.artist: r for r in B.comparison(songs, "artist", "category", {"avg_syllables_per_line": 2, "ttr": 4}).collect()}
    assert (got["a"].solo_songs, got["a"].collab_songs, got["a"].delta_avg_syllables_per_line, got["a"].delta_ttr) == (1, 2, 2.0, None)
    assert got["b"].delta_avg_syllables_per_line is None and got["c"].solo_songs == 0
    assert [(r.artist, r.solo_songs, r.collab_songs, r.avg_syllables_per_line) for r in B.summary(songs, "artist", "category").collect()] == [("a", 1, 2, 9.33)]


def test_network_rules(spark):
    rows = [("t1", "Buba", ["Jala", "Buba", ""], "corona", "featured", "Corona"), ("t2", "Jala", None, "jala-buba-duo", "duo", "jala"), ("t3", "X", None, "a-b-c-trio", "trio", None), ("t4", "Solo", ["Guest"], "solo-solo", "solo", "solo"), ("t5", "Y", ["Z"], "y", "duo", None), ("t6", "Y", ["Z"], None, "featured", None)]
    df = spark.createDataFrame(rows, "title string, artist string, featured array<string>, category string, role string, target string")
    edges = B.edges(df, "title", "artist", "featured", "category", "role", "target")
    weighted = {(r.a, r.b): r.weight for r in B.pairs(edges).collect()}
    assert weighted == {("buba", "corona"): 1, ("buba", "jala"): 2, ("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("guest", "solo"): 1}
    one = B.overview(edges).first()
    assert (one.artists, one.edges, one.songs, one.density) == (8, 6, 4, round(100 * 6 / 28, 4))
    degree = {r.node: (r.degree, r.centrality) for r in B.centrality(B.pairs(edges)).collect()}
    assert degree["buba"] == (2, 1.0) and degree["corona"] == (1, 0.5)
    assert (B.top_pairs(B.pairs(edges), 1).first().a, B.overview(edges.limit(0)).first().density) == ("buba", 0.0)


def test_fingerprints(spark):
    songs = spark.createDataFrame([(k, "c", "a" if k < 4 else "b", 0.1 * k, 0.2, 0.5, "AABB" if k % 2 else "free", 0.3, 0.6, 8.0) for k in range(1, 6)], "song int, cohort string, artist string, rhyme_factor double, pct_multis double, internal_rate double, scheme string, hook_repetition_ratio double, ttr double, avg_syllables_per_line double")
    parts = spark.createDataFrame([(k, s, "refren" if s else "strofa", 4) for k in range(1, 6) for s in range(2)], "song int, section int, kind string, n_lines int")
    got = {r.artist: r for r in P.fingerprints(songs, parts, "song", "cohort", "artist").collect()}
    assert (got["a"].rhyme_factor_q1, got["a"].rhyme_factor_median, got["a"].rhyme_factor_q3, got["a"].songs) == (0.15, 0.2, 0.25, 3)
    assert got[None].songs == 5 and got[None].rhyme_factor_median == 0.3 and got["b"].refren_share == 0.5
    assert got["a"].profile == "Lean rhyme style (RF=0.20) with 20.0% multis. Hook-heavy structure (50% refren, 2.0 sections/song). Lexically diverse (TTR=0.60, 8.0 syllables/line)."
    # Inclusive quartiles of 1, 2, 3 .. as the statistics module gives them.
    four = songs.limit(4).withColumn("rhyme_factor", F.col("song").cast("double"))
    four = P.rhyme_craft(four.withColumn("artist", F.lit("a")), "cohort", "artist").where("artist is not null").first()
    assert (four.rhyme_factor_q1, four.rhyme_factor_median, four.rhyme_factor_q3) == (1.75, 2.5, 3.25)
    topics = spark.createDataFrame([(1, "x")] * 3 + [(1, "y")] + [(2, c) for c in "zuvwq"], "song int, label string")
    top = [(r.label, r.n, r["share"]) for r in P.top_topics(topics, songs, "song", "cohort", "artist").where("artist is null").orderBy("rank").collect()]
    assert top == [("x", 3, 0.4286), ("q", 1, 0.1429), ("u", 1, 0.1429), ("v", 1, 0.1429), ("w", 1, 0.1429)]
    pairs = spark.createDataFrame([(1, p) for p in ["aa"] * 6 + ["ee"] * 5 + ["oo"] * 4 + ["ii"] * 3 + ["uu"] * 2 + ["ai"]] + [(2, "ai")] * 2, "song int, suffix string")
    got = {r.suffix: r.n for r in P.vowel_pairs(pairs, "song", "suffix", songs, "cohort", "artist").where("artist = 'a'").collect()}
    assert got == {"aa": 6, "ee": 5, "oo": 4, "ii": 3, "uu": 2, "ai": 2}  # the first song's sixth ending does not count
    forms = spark.createDataFrame([(1, "i", "CCONJ"), (1, "grad", "NOUN"), (1, "grad", "NOUN"), (2, None, "NOUN"), (2, "x", None)], "song int, form string, upos string")
    assert [(r.form, r.n) for r in P.top_forms(forms, songs, "song", "cohort", "artist").where("artist = 'a'").collect()] == [("grad", 2)]


def test_themes(spark):
    import numpy as np

    draw = np.random.default_rng(0)
    rows = [(k, [float(v) for v in draw.normal(scale=0.1, size=3) + np.eye(3)[k % 3] * 5]) for k in range(90)] + [(90, [50.0, 50.0, 50.0]), (91, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    centres = M.fit(df.where("id < 90"), "id", "v", 3)
    found = {r.id: r for r in M.assigned(df, "id", "v", centres).collect()}
    assert len(centres.vectors) == 3 and len({(k % 3, found[k].topic) for k in range(90)}) == 3 and found[90].topic == -1 and 91 not in found
    assert all(found[k].probability > 0.99 for k in range(90))
    assert len(M.fit(df.where("id < 90 and (id % 3 > 0 or id < 9)"), "id", "v", 3).vectors) == 2  # three members are no topic
    members = M.assigned(df, "id", "v", centres)
    terms = spark.createDataFrame([(k, w, 1) for k in range(90) for w in ("common", f"own{k % 3}")], "id int, term string, tf int")
    table = {r.topic: r for r in M.table(members, M.class_terms(terms, members, "id"), "id").collect()}
    for t, r in table.items():
        first = next(k for k in range(3) if found[k].topic == t)
        assert (r.size, r.exemplar, r.label, r.top_terms) == (30, first, f"{t}_own{first}_common", [f"own{first}", "common"])
    drafts = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, -1)], "draft int, topic int")
    cohort = spark.createDataFrame([(0,), (1,), (1,), (2,), (-1,)], "topic int")
    got = {(r.draft, r.topic): (r.input_pct, r.cohort_pct, r.verdict, r.place) for r in M.compared(drafts, cohort, "draft").collect()}
    assert got[1, 0] == (0.6667, 0.25, "over", 1) and got[1, 1] == (0.0, 0.5, "under", 1) and got[1, 2] == (0.3333, 0.25, "over", 2)
    assert {r.draft: r.jsd for r in M.divergences(drafts, cohort, "draft").collect()}[2] == 0.0


def test_no_cohort_themes(spark):
    drafts = spark.createDataFrame([(1, 0)], "draft int, topic int")
    assert M.compared(drafts, drafts.select("topic").limit(0), "draft").count() == 1
    with pytest.raises(Exception):
        M.assigned(spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), "id", "v", M.Centres([], [])).collect()


def test_spectral_means_on_a_half(spark):
    values = [(1, 9.12), (1, 2.18), (2, 2.18), (2, 9.12), (3, float("nan")), (3, 1.0), (4, None), (5, 1e30), (5, 3e30)]
    frames = spark.createDataFrame(values, "track int, x double")
    got = {r.track: r.x for r in A.spectral_profile(frames, ["track"], {"x": 1}).collect()}
    assert (got[1], got[2], got[4], got[5]) == (5.7, 5.7, None, 2e30) and got[3] != got[3]  # 5.65, which doubles add up to less
