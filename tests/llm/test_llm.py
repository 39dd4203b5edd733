"""The operators against brute force, exact round trips and held-out data, and on odd inputs."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm import common, crc, jaccard, licenses, lm, media, merges, ngrams, packing, queries, records, secrets, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE, WORDS, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
LONG = " ".join(f"word{k % 997}x{k % 13}" for k in range(30_000))
ODD = [None, "", " ", "\n\n", "one", "a b", "a\t\n\nb", "  x\n\n y  ", "\x1cfoo bar\xa0\xa0 z", "Ünï côdé ́x", "日本語 テキスト", "don't 'S  tab\there", "same text twice here " * 4, "same text twice here " * 4, LONG]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a null id, repeated rows, and columns whose names clash with those the operators use."""
    rows = [(k, t, k, "x", 1, b"") for k, t in enumerate(ODD)] + [(None, "no id here", 0, "x", 1, b""), (12, ODD[12], 0, "y", 2, b"")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, key string, node long, ids binary")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_crc():
    items = [b"123456789", b"", b"\0", os.urandom(64), os.urandom(1000)]
    assert crc.crc32c_many(items)[0] == 0xE3069283

    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ 0x82F63B78 * (c & 1)
        return c ^ 0xFFFFFFFF

    assert crc.crc32c_many(items).tolist() == [slow(x) for x in items]


@pytest.mark.parametrize("path,words", [(BYTE, False), (WORDS, True)])
def test_chunks(path, words, docs):
    rows = [t or "" for t in ODD] + ["\u3000a\u2003b", "x\u0085y\u1680z", "<|endoftext|> x", "ÉCOLE Straße, ÀÉ.", " "] + [t for _, t in texts(docs)[:50]]
    for cap in (100, 1_000_000):
        e = tokens.ChunkEncoder(path, words, cap)
        wanted = [[*x.ids, 7] for x in e.tokenizer.encode_batch(rows, add_special_tokens=False)]
        for _ in range(2):  # the second time from the table
            ids, sizes = e.encode(pa.array(rows), [7])
            assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted
        assert e.table.n <= cap


def twins(n=2048):
    """Two texts of equal length that polynomial hashes modulo 2**64 cannot tell apart."""
    t = "".join("ab"[bin(k).count("1") & 1] for k in range(n))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("path,words", [(BYTE, False), (WORDS, True)])
def test_chunks_that_simple_hashes_confuse(path, words, spark):
    rows = ["zzzzzzzz" + t for t in twins()] + list(twins())
    e = tokens.ChunkEncoder(path, words)
    wanted = [x.ids for x in e.tokenizer.encode_batch(rows, add_special_tokens=False)]
    ids, sizes = e.encode(pa.array(rows))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted
    found = {r.doc_id: r.ids_crc32 for r in packing.pack(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), path, 0, 1 << 20).collect()} if not words else {}
    assert not words or found == {}
    assert words or len(set(found.values())) >= 3


def test_clashing_keys_are_noticed(monkeypatch):
    """With a first hash of 4 bits the second one tells; a table that meets a clash starts anew with other keys."""
    real, calls = common.span_hashes, []

    def weak(data, starts, ends, key=common.KEY):
        calls.append(key)
        found = real(data, starts, ends, key)
        return found & np.uint64(15) if len(calls) in (1, 5) else found

    monkeypatch.setattr(common, "span_hashes", weak)
    rows = ["one two three four five six seven eight nine ten " * 3, "eleven twelve thirteen one fourteen"]
    e = tokens.ChunkEncoder(BYTE, False)
    for text in rows:
        ids, _ = e.encode(pa.array([text]))
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(set(calls)) > 2


def test_word_hashes():
    rows = [t or "" for t in ODD] + ["a b  c", "A\tb\x0bc", "x" * 300_000 + " b"]
    hashes, sizes = common.hashed_words(pa.array(rows).slice(1))
    words = [w for t in rows[1:] for w in WORD.findall(t.translate(FOLD))]
    assert sizes.tolist() == [len(WORD.findall(t)) for t in rows[1:]] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    for pair in (twins(), twins(32), [f"{'x' * 8 * k}{c}{'y' * 8 * m}" for c in "ab" for k in range(9) for m in range(9)]):
        for key in (common.KEY, 1):
            assert len(set(common.hashed_words(pa.array(list(pair)), key=key)[0].tolist())) == len(set(pair))
    assert not set(common.hashed_words(pa.array(rows), key=5)[0].tolist()) & set(hashes.tolist())


def test_texts_that_simple_hashes_confuse(spark):
    rows = [(1, twins()[0]), (2, twins()[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect())) == [(1, 1, 1), (2, 1, 2)]
    assert jaccard.one_of_each(df).count() == 2
    held = next(i for i in range(100) if lm.part_of(i) == lm.HELD_OUT)
    other = next(i for i in range(100) if lm.part_of(i) == lm.TRAIN)
    df = spark.createDataFrame([(held, rows[0][1]), (other, rows[1][1])], "doc_id long, text string")
    assert {r.doc_id: r.n_known for r in lm.score(df).collect()} == {held: 1, other: 2}


def test_totals_of_more_than_32_bits():
    keys = [np.array([1, 5], np.uint64), np.array([5], np.uint64), np.array([5, 9], np.uint64)]
    counts = [common.pack(np.array(x, np.uint32)) for x in ([7, 1 << 31], [1 << 31], [1 << 31, 4])]
    every, mains, types, n, n_main = lm._totals(keys, counts, [lm.TRAIN, lm.DELETED, lm.TRAIN])
    assert [x.tolist() for x in every] == [[7, 3 << 31], [3 << 31], [3 << 31, 4]] and mains[1].tolist() == [1 << 32]
    assert (types, n, n_main) == (3, 3 * (1 << 31) + 11, (1 << 32) + 11)
    for x in every:
        assert lm.unpacked(lm.packed(x)).tolist() == x.tolist()


def test_records(odd, none, docs):
    for df in (odd, docs):
        found = sorted(records.digests(records.write_records(df, WORDS, 2)).collect(), key=lambda r: (r.shard, r.record))
        rows = sorted(texts(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        assert [r.doc_id for r in found] == [i for i, _ in rows]
        start = 0
        for r, e in zip(found, Tokenizer.from_file(WORDS).encode_batch([t for _, t in rows], add_special_tokens=False)):
            ids = np.array([*e.ids, 2], "<u4")
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert records.digests(records.write_records(none, WORDS, 2)).count() == 0


def test_records_one_by_one_and_damage(docs):
    index = records.write_records(docs, WORDS, 2)
    some = records.read_records(index.where("record % 7 = 3")).collect()
    whole = {(r.shard, r.record): r for r in records.read_shards(index).collect()}
    assert some and all(whole[r.shard, r.record] == r for r in some)
    raw = records.frames([b"abc"])[0]
    assert records.checked([raw]) == [b"abc"]
    for k in range(len(raw)):
        with pytest.raises(ValueError):
            records.checked([raw[:k] + bytes([raw[k] ^ 1]) + raw[k + 1 :]])


def test_packing(odd, none, docs):
    assert packing.pack(none, BYTE).count() == 0
    for df in (odd, docs):
        found = packing.pack(df, BYTE, 0, 64).collect()
        stream = Counter()
        for r in found:
            assert r.offset + r.length <= 64 and r.length > 0
            stream.update(range(r.sequence_id * 64 + r.offset, r.sequence_id * 64 + r.offset + r.length))
        assert set(stream.values()) == {1} and set(stream) == set(range(len(stream)))
        wanted = Counter((i, len(x) + 1) for (i, _), x in zip(texts(df), Tokenizer.from_file(BYTE).encode_batch([t for _, t in texts(df)], add_special_tokens=False)))
        assert Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == wanted
        whole = {i: [*x.ids, 0] for (i, t), x in zip(texts(df), Tokenizer.from_file(BYTE).encode_batch([t for _, t in texts(df)], add_special_tokens=False))} if df is docs else {}
        ends = {}
        for r in sorted(found, key=lambda r: (r.doc_id or 0, r.start)) if df is docs else ():
            assert r.start == ends.get(r.doc_id, 0)
            ends[r.doc_id] = r.start + r.length
            assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert ends == {i: len(x) for i, x in whole.items()}
        assert sum(r.length for r in found) == sum(n * c for (_, n), c in wanted.items())


def test_language_model(odd, none, docs):
    assert lm.score(none).count() == 0
    for df in (odd, docs):
        found = lm.score(df, block_chars=20_000).collect()
        words = [(i, WORD.findall(t.translate(FOLD)) + [None]) for i, t in texts(df)]
        train = Counter()
        for i, w in words:
            if lm.part_of(i) != lm.HELD_OUT:
                train.update(w)
        n, v = sum(train.values()), len(train)
        wanted = Counter((i, len(w), sum(train[x] > 0 for x in w), round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in words)
        assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == wanted
        assert {r.train_tokens for r in found} == {n} and all(r.score <= 0 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than one-gram on unseen text


def test_language_model_scores(docs):
    """The score by definition, with weights learned on every single deleted token instead of a histogram."""
    words = [(i, WORD.findall(t.translate(FOLD)) + [None]) for i, t in texts(docs)]
    parts = {i: lm.part_of(i) for i, _ in words}

    def counts(kinds):
        one, two = Counter(), Counter()
        for i, w in words:
            if parts[i] in kinds:
                one.update(w)
                two.update(zip(["<s>", *w[:-1]], w))
        return one, two, Counter({**one, "<s>": one[None]})

    one, two, before = counts({lm.TRAIN})
    n, types = sum(one.values()), len(counts({lm.TRAIN, lm.DELETED})[0])
    rows = [{"b": int(lm.context_class(np.array([before[v]]))[0]), "n": 1, "s2": two[v, x] / max(1, before[v]), "s1": one[x] / n} for i, w in words if parts[i] == lm.DELETED for v, x in zip(["<s>", *w[:-1]], w)]
    weights = lm.learn(rows, 1 / (types + 1))
    one, two, before = counts({lm.TRAIN, lm.DELETED})
    n = sum(one.values())
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    for i, w in words:
        total = 0.0
        for v, x in zip(["<s>", *w[:-1]], w):
            part = weights[int(lm.context_class(np.array([before[v]]))[0])]
            total += math.log10(part[0] * two[v, x] / max(1, before[v]) + part[1] * one[x] / n + part[2] / (types + 1))
        assert abs(got[i] - total) <= 0.01 * abs(total) + 0.01, (i, got[i], total)


def test_language_model_weights_sum_to_one():
    weights = lm.learn([{"b": 1, "n": 5, "s2": 4.0, "s1": 0.5}, {"b": 2, "n": 50, "s2": 0.0, "s1": 10.0}], 0.01)
    assert np.allclose(weights.sum(axis=1), 1) and weights[1, 0] > weights[2, 0]


def base(text):
    words = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        dups += line in seen and bool(WORD.search(line))
        seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(k, k + 8))
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dups, len(covered)


def test_quality(odd, none, docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ngrams.fit(docs, ngrams.trusted_ids(labels, "quality"))
    assert ngrams.quality(none, model).count() == 0 and ngrams.resample(none, model).count() == 0
    for df in (odd, docs):
        rows = dict(texts(df))
        for r in ngrams.quality(df, model).collect():
            b = base(rows[r.doc_id])
            assert tuple(r)[1:6] == b
            assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and not (r.kept and r.base_failed)
        passed = ngrams.passing(df, model)
        assert passed.columns == df.columns
        assert Counter(r.doc_id for r in passed.collect()) == Counter(r.doc_id for r in ngrams.quality(df, model).where("kept").collect())


def test_quality_on_held_out_labels(spark):
    larger = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    judged = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    model = ngrams.fit(documents, ngrams.trusted_ids(labels.where("doc_id % 3 > 0"), "quality"))
    kept = defaultdict(list)
    for r in ngrams.quality(documents, model).where("not base_failed").collect():
        kept[judged.get(r.doc_id)].append(r.kept)
    assert sum(kept[1]) >= 0.98 * len(kept[1]) and sum(kept[0]) <= 0.2 * len(kept[0])


def test_counts_are_those_of_all_documents(docs):
    assert ngrams.counts(docs, [0, 1], 10).agg({"raw": "sum"}).first()[0] == sum(max(0, 2 * len(WORD.findall(t)) - 1) for _, t in texts(docs))


def test_resampling(odd, docs, spark, sf_dir):
    model = ngrams.fit(docs, ngrams.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"))
    rows = dict(texts(docs))
    # The models by brute force: both multinomials over hashed cells, and the weight of each whole text.
    cells = {i: ngrams.cells(pa.array([t]), model.bits)[0].tolist() for i, t in rows.items()}
    good = set(ngrams.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"))
    raw, target = Counter(), Counter()
    for i, c in cells.items():
        raw.update(c)
        target.update(c if i in good else [])
    share = sum(target.values()) / sum(raw.values())
    weight = lambda c: math.log((target[c] + 20 * share) / ((raw[c] + 20) * share))
    for k in (0, 1, 17, 10_000, None):
        found = ngrams.resample(docs, model, k).collect()
        best = sorted((r.key for r in found), reverse=True)[: sum(r.log_ratio >= ngrams.FLOOR for r in found) if k is None else k]
        assert sorted((r.key for r in found if r.kept), reverse=True) == best
        assert ngrams.resampled(docs, model, k).count() == len(best)
    for r in found:
        assert r.n_grams == len(cells[r.doc_id]) and math.isclose(r.log_weight, sum(map(weight, cells[r.doc_id])), abs_tol=1e-6)
        assert math.isclose(r.log_ratio, r.log_weight / (r.n_grams + 20))
    noise = {r.doc_id: r.g for r in docs.select("doc_id", ngrams.gumbel(0, "doc_id", "text").alias("g")).collect()}
    assert all(math.isclose(r.key, 50 * r.log_ratio + noise[r.doc_id]) for r in found)
    plain = ngrams.resample(docs, model, share=0.5, effective=None).collect()
    assert all(math.isclose(r.key, r.log_weight + noise[r.doc_id]) for r in plain) and sum(r.kept for r in plain) == round(len(plain) / 2)
    assert ngrams.resample(odd, model).count() == odd.count()
    assert ngrams.resample(odd, ngrams.fit(odd, [])).where("log_weight <> 0").count() == 0
    clash = docs.withColumnRenamed("source", "importance").withColumnRenamed("lang", "own")
    assert {tuple(r) for r in ngrams.resampled(clash, model, k=99).collect()} < {tuple(r) for r in clash.collect()}


def test_draws_follow_the_weights(spark):
    """Over many seeds, documents are drawn first in proportion to their weights, and second among those left."""
    weights = {0: 1.0, 1: 2.0, 2: 4.0, 3: 0.5}
    df = spark.createDataFrame([(i, str(i), math.log(w)) for i, w in weights.items()], "doc_id long, text string, w double")
    keys = [(F.col("w") + ngrams.gumbel(seed, "doc_id", "text")).alias(f"k{seed}") for seed in range(800)]
    drawn = df.select(*keys).toPandas().to_numpy().argsort(axis=0)[::-1]
    whole = sum(weights.values())
    for i, w in weights.items():
        second = sum(v / whole * w / (whole - v) for j, v in weights.items() if j != i)
        for row, p in ((drawn[0], w / whole), (drawn[1], second)):
            assert abs((row == i).mean() - p) < 4 * math.sqrt(p * (1 - p) / 800)


def test_second_stage_rejects_junk(spark, tmp_path):
    """Labelled rows held out of the fit: junk goes, be it common or among few in what the rules kept, and clean documents stay."""
    larger = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    os.symlink(f"{larger}/documents.parquet", tmp_path / "documents.parquet")
    labels.where("doc_id % 3 > 0").write.parquet(str(tmp_path / "labels.parquet"))
    judged = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    junk = documents.where(documents.doc_id.isin([i for i, q in judged.items() if q == 0]))
    ruled = corpus_pipeline.quality_rules(spark, documents, str(tmp_path))
    for given in (documents, ruled.unionByName(junk)):
        kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, given, str(tmp_path)).collect()}
        there = {r.doc_id for r in given.select("doc_id").collect()}
        bad, good = ([i for i in there if judged.get(i) == q] for q in (0, 1))
        assert len(bad) >= 10 and sum(i in kept for i in bad) <= 0.05 * len(bad)
        assert len(good) >= 100 and sum(i in kept for i in good) >= 0.98 * len(good)


def test_kth_largest(spark):
    values = [random.Random(1).choice([0.5, 1.5, 1.5 + 1e-12, -3.0, 7.25]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 50, 150, 299, 300):
        assert ngrams.kth_largest(df, "x", k, bins=4) == sorted(values, reverse=True)[k - 1]
    assert ngrams.kth_largest(df, "x", 301) is None


@pytest.mark.parametrize("lacing", media.LACINGS)
def test_matroska(lacing):
    for n in (1, 2, 9, 300):
        payload = os.urandom(64 * n)
        data = media.mux(payload, lacing)
        s = media.parse(data)
        assert b"".join(data[p[3] : p[3] + p[4]] for p in s.packets) == payload
        assert [p[2] for p in s.packets] == [8_000_000 * k for k in range(n)]
        assert [c[2] + 0 for c in s.cues] and all(data[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in s.cues)
    for frames in ([b"a" * 300, b"b" * 5, b"c" * 700, b""], [b"x"] * 3):
        if lacing not in ("none", "fixed"):
            raw = media.lace(frames, lacing)
            sizes, at = media._sizes(raw, 0, len(raw), lacing)
            assert sizes == [len(f) for f in frames] and raw[at:] == b"".join(frames)


def test_matroska_unknown_sizes_and_damage(spark):
    whole = media.mux(b"\x01" * 64 * 20)
    cluster = whole.index(b"\x1f\x43\xb6\x75")
    _, body, width = media._vint(whole, cluster + 4)
    unknown = whole[: cluster + 4] + bytes([0xFF >> width - 1]) + b"\xff" * (width - 1) + whole[body:]
    assert [p[4] for p in media.parse(unknown).packets] == [64] * 20
    df = spark.createDataFrame([(1, whole), (2, whole[:70]), (3, None)], "doc_id long, media binary")
    found = media.packets(df).collect()
    assert sum(r.doc_id == 1 for r in found) == 20 and [r.error is not None for r in found if r.doc_id == 2] == [True] and not [r for r in found if r.doc_id == 3]


def test_media_features(odd, none):
    assert media.features(media.store(none)).count() == 0
    rows = dict(texts(odd))
    for r in media.features(media.store(odd)).collect():
        raw = rows[r.doc_id].encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
    stored = {r.doc_id: bytes(r.media) for r in media.store(odd).collect()}
    again = {r.doc_id: r for r in media.features(media.store(odd)).collect()}
    assert all((r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest()) for i, r in again.items())
    by = defaultdict(set)
    for i, r in again.items():
        by[rows[i]].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values()) and len({f for x in by.values() for _, f in x}) > 5


def test_merge_replay(odd, none):
    import tiktoken

    ranks = merges.load_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    rows = [t or "" for t in ODD] + ["a" * 50, "🙂🙂 🙂", *("".join(rng.choice("abcdehilnorstu éñçжд語 ") for _ in range(200)) for _ in range(100))]
    e = merges.MergeEncoder(RANKS, public_tokenizers.PATTERN, cap=50)
    assert [x.tolist() for x in e.encode(rows)] == [encoding.encode_ordinary(t) for t in rows]
    assert [merges.encode_alone(w.encode(), ranks) for w in ("hello", "zażółć")] == [encoding.encode_ordinary(w) for w in ("hello", "zażółć")]
    ids = merges.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.text).decode() for r in merges.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    for r in merges.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect():
        whole = encoding.encode_ordinary(dict(texts(odd))[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(whole), hashlib.sha256(np.array(whole, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(dict(texts(odd))[r.doc_id].encode()).hexdigest()
    assert back == dict(texts(odd)) and merges.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_replay_of_ranks_that_come_up_late():
    """A merge that brings up a pair of lower rank: the word is replayed by the definition."""
    ranks = {bytes([k]): k for k in range(256)} | {b"bc": 256, b"xa": 300, b"abc": 255 + 10, b"ab": 400}
    for word in (b"abc", b"xabc", b"abcabc", b"aabc"):
        assert merges.replay([word], ranks)[0] == merges.encode_alone(word, ranks)


def test_licenses(odd, none, docs, sf_dir):
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).where("size(licenses) > 0").count() == 0
    assert licenses.scan(docs, {}).where("size(licenses) > 0").count() == 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    wanted = dict(con.execute(f"SELECT doc_id, licenses FROM ({licenses.oracle()})").fetchall())
    assert {r.doc_id: ",".join(r.licenses) for r in licenses.scan(docs).collect()} == wanted and any(wanted.values())


def test_licenses_inside_edited_text(spark):
    notice = licenses.TEMPLATES["GPL-notice"].split()
    edited = [*notice[:20], "(changed)", *notice[21:]]
    rows = [(1, "some words before " + " ".join(notice) + " and after"), (2, " ".join(edited)), (3, " ".join(notice[:20])), (4, " ".join(reversed(notice)))]
    found = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: ["GPL-notice"], 2: ["GPL-notice"], 3: [], 4: []}


SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] if len(m[2]) >= 6 else []
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark, odd, none):
    rng = random.Random(5)
    words = ["the", "stone", "Of", "12", "river,", "and", "(so)", "x=1"]
    rows = []
    for k in range(300):
        w = [rng.choice(words) for _ in range(40)]
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        w[rng.randrange(40)] = rng.choice([f'token = "{key}"', f"password: {key[:12]}", "AKIA" + key[:16].upper(), f"é TOKEN={key[:5]}", "api_key: " + key])
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = secrets.fit(df)
    assert secrets.digests(none, field).count() == 0
    for source in (df, odd):
        by_id = dict(texts(source))
        for r in secrets.digests(source, field).collect():
            wanted = spans(by_id[r.doc_id])
            assert [(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",") if s and not s.startswith("crf")] == wanted
    # A secret that no pattern knows is found by its shape and neighbours.
    new = 'token is "' + "G7xK2mPq9RtZ4vW8yB3nD6fH" + '" and more'
    tagged = secrets.scan(spark.createDataFrame([(1, "the river and " + new)], "doc_id long, text string"), field).first().spans
    assert len(tagged) <= 1  # at most that one
    clean = secrets.redact(spark.createDataFrame([(1, f"a token = {SECRET} b", 7), (2, None, 8)], "doc_id long, text string, x int"), field).orderBy("doc_id").collect()
    assert SECRET not in clean[0].text and clean[0].text.startswith("a [SECRET]") and clean[1].text is None and clean[0].x == 7
    assert secrets.digests(odd, secrets.fit(none)).where("spans like '%crf%'").count() == 0


def test_field_adds_what_patterns_miss(spark):
    rng = random.Random(5)
    words = ["the", "stone", "Of", "12", "river,", "and", "(so)", "x=1"]
    rows = []
    for k in range(300):
        w = [rng.choice(words) for _ in range(40)]
        w[rng.randrange(40)] = 'token = "' + "".join(rng.choice("0123456789abcdefGHKXYZ") for _ in range(40)) + '"'
        rows.append((k, " ".join(w)))
    field = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    new = "G7xK2mPq9RtZ4vW8yB3nD6fHk1Ls5TqW0eRuYiOp"
    partly = "ZKXYGH" + SECRET[:24] + "XYZKGH9Z"
    texts = [f'the river token is "{x}" and the stone of 12' for x in (new, partly)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df, field).collect():
        text, secret = texts[r.doc_id], (new, partly)[r.doc_id]
        covered = {k for s in r.spans for k in range(s.start, s.end)}
        assert covered == set(range(text.index(secret), text.index(secret) + len(secret))) and "crf" in {s.kind for s in r.spans}
    assert [r.text for r in secrets.redact(df, field).orderBy("doc_id").collect()] == ['the river token is "[SECRET]" and the stone of 12'] * 2


def test_field_finds_secrets_of_kinds_that_no_pattern_knows():
    """Recall on planted secrets that no pattern matches, and no span in documents without any."""
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    hinted = [t for t in rows if "AKIA" in t or any(k in t.lower() for k in secrets.KEYWORDS)]
    windows = [w for t in hinted for w in secrets.windows(t)]
    tagger = secrets.Tagger(secrets.train(*(np.array([w[k] for w in windows]) for k in range(3))))
    clean = [t for t in rows if len(t) > 500 and not spans(t)][:1500]
    assert sum(bool(tagger.spans(t)) for t in clean) <= 0.002 * len(clean)
    rng = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    kinds = (lambda: "ghp_" + draw(36), lambda: "sk-" + draw(40), lambda: "eyJ" + draw(30) + "." + draw(60) + "." + draw(40), lambda: f'token is "{draw(24)}"', lambda: "the key was " + draw(32), lambda: "password is " + draw(7).lower() + draw(4) + "7")
    for kind in kinds:
        found = 0
        for _ in range(60):
            text, planted = rng.choice(clean), kind()
            at = text.index(" ", rng.randrange(len(text) - 250))
            text, secret = f"{text[:at]} {planted}{text[at:]}", planted.split(" ")[-1].strip('"')
            a = text.index(secret)
            assert not any(x <= a < y for _, x, y in spans(text))
            found += any(x <= a and y >= a + len(secret) for _, x, y in tagger.spans(text))
        assert found >= 0.8 * 60, planted


def test_viterbi_by_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(50):
        field = secrets.Field(np.zeros((4, secrets.N_SHAPE, 3)), np.zeros((secrets.N_FILE, 3)), rng.normal(size=(3, 3)))
        scores = rng.normal(size=(6, 3)) * 4
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(scores[k, t] for k, t in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:])))
        assert secrets.decode(scores, field).tolist() == list(best)


def linked(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(FOLD))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same) or rows[a][0] == rows[b][0]:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), None if i is None else least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("n,percent,run,frequent", [(3, 90, 2, None), (5, 80, 2, 0), (2, 80, 2, 4), (3, 80, 3, 0)])
def test_jaccard(spark, odd, n, percent, run, frequent):
    rng = random.Random(n)
    rows = []
    for family in range(12):
        first = [f"w{rng.randrange(60)}" for _ in range(rng.choice([8, 20, 60]))]
        for _ in range(12):
            w = list(first)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"v{rng.randrange(500)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.join(df, n, percent, run, frequent).collect())) == linked(rows, n, percent)
    if n == 3:
        assert Counter(map(tuple, jaccard.join(odd, n, percent).collect())) == linked(texts(odd), n, percent)


def test_jaccard_of_large_groups(spark, monkeypatch):
    """Groups too large to be compared in full: turns, longer combinations and the last comparison."""
    monkeypatch.setattr(jaccard, "PAIRS", 0)
    monkeypatch.setattr(jaccard, "GROUP", 2)
    monkeypatch.setattr(jaccard, "SALT", 7)
    rng = random.Random(9)
    first = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(first)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(500)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.join(df, 3, 80).collect())) == linked(rows, 3, 80)


def test_jaccard_shuffles_keys_once(spark):
    index = spark.createDataFrame([(1, 10, [7, 8]), (2, 11, [7, 9]), (3, 10, [7, 8]), (4, None, []), (5, 12, [6])], "doc_id int, node long, keys array<long>")
    found = jaccard.met(index)
    assert sorted(map(tuple, found.select("key", "node", "leader", "rows").collect())) == [(7, 10, 10, 3), (7, 11, 10, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate") == 1  # the keys of all documents are dealt out once


def test_jaccard_keeps_one_of_each(odd, none):
    assert jaccard.join(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    nameless = [(None, ""), (None, ""), (None, None), (None, "a b c"), (None, "a b c"), (3, ""), (3, "")]
    kept = jaccard.one_of_each(odd.sparkSession.createDataFrame(nameless, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text or "") for r in kept) == {(None, ""): 3, (None, "a b c"): 1, (3, ""): 1}
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id >= 12").collect()) == [12, 14]


def test_jaccard_of_one_id_with_several_texts(spark):
    a, b = ("alpha " + " ".join(f"a{k}" for k in range(30)), "beta " + " ".join(f"b{k}" for k in range(30)))
    for x, y in ((a, b), (b, a)):
        rows = [(5, x), (5, y), (3, y), (7, "other words of a text that stays alone")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(map(tuple, jaccard.join(df).collect())) == linked(rows, 3, 90)
        assert sorted(map(tuple, jaccard.one_of_each(df).collect())) == [(3, y), (5, x), rows[3]]


def test_pipeline(spark, sf_dir, docs):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = common.written(stage(spark, found, sf_dir), "stage")
        assert found.columns == docs.columns, name
    rows = texts(found)
    good = {i for i, t in texts(docs) if base(t)[0] >= 20 and 100 * base(t)[4] <= 30 * base(t)[0]}
    assert {i for i, _ in rows} <= good and not any(spans(t) for _, t in rows)
    groups = linked(rows, 5, 80)
    assert all(i == c for i, _, c in groups)
    direct = {tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect()}
    assert {i for i, *_ in direct} == {i for i, _ in rows}


def test_pipeline_stages_on_odd_input(spark, sf_dir, odd, none):
    """Null ids, empty and very long texts, repeated rows and clashing columns, and no rows, through every stage."""
    clash = odd.withColumnRenamed("key", "own").withColumnRenamed("node", "part")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (clash, none):
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns and out.count() <= df.count(), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, clash, sf_dir)
    assert pieces.where("start = 0").count() == clash.count() and corpus_pipeline.STAGES[-1][1](spark, none, sf_dir).count() == 0
    bare = odd.select("doc_id", "text")
    assert corpus_pipeline.secret_scan(spark, bare, sf_dir).columns == bare.columns


def test_field_trains_on_one_text_of_each_id(spark):
    rows = [(1, f"the password = hunter{k}abc and more") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = secrets.fit(df)
    assert all(np.array_equal(getattr(one, c), getattr(secrets.fit(df.repartition(5)), c)) for c in ("shape", "file", "step"))


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k != "pipeline") == list(range(1, 14))
