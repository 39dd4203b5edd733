"""Operators 11 to 13 against brute force, exact round trips and odd input."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadenza.llm import chat, queries, trie, whitening

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def conversations(rows):
    """conv_id -> turns as (role, text), null first, equal turns by their keys."""
    key = lambda r: hashlib.sha256(f"{len(r[0])}:{r[0]}{r[1]}".encode()).digest()[:16]
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, key((role or "", text or "")), (role or "", text or "")))
    return {c: [t[3] for t in sorted(v)] for c, v in found.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own + sum(saved[x] for x in children[node])
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", b"k") for r in rows], "conv_id long, turn long, role string, text string, path string, key binary")


def test_trie_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, sf_dir)) == brute_trie(rebuilt(conversations(rows)))


@pytest.mark.parametrize("shards,part", [(1, 64), (7, 64), (5, 2), (40, 3)])
def test_trie_with_copies_and_long_prefixes(spark, shards, part):
    draw, rows = random.Random(shards), []
    for c in range(300):
        kind = c % 6
        n = 7 if kind < 2 else draw.randrange(0, 12)
        for t in range(n):
            text = f"turn {t}" if kind < 4 or t < 4 else f"own {draw.randrange(3)} é"
            rows.append((c * 7 % 1000, t if t else None, ("user", "assistant", None)[t % 3], None if t == 5 else text))
    rows += [(None, 1, "user", "no id"), (50_000, 2, "user", "tie"), (50_000, 2, "user", "eit"), (50_000, 2, "user", "tie"), (-4, 1, "a", ""), (-4, 1, "a", "")]
    df = turns_frame(spark, rows)
    own = conversations(rows)
    assert found(trie.prefix_trie(df, shards=shards, part=part)) == brute_trie(own)
    assert found(trie.prefix_trie(df, family=5, shards=shards, part=part)) == brute_trie(rebuilt(own))


def test_trie_of_nothing(spark):
    assert found(trie.prefix_trie(turns_frame(spark, [(None, None, None, None)]))) == []
    assert found(trie.prefix_trie(turns_frame(spark, [(1, 1, None, None)]).limit(0), family=5)) == []


def test_eigenvectors():
    draw = np.random.default_rng(3)
    for n, spectrum in ((1, None), (2, None), (40, None), (30, [5.0] * 4 + [2.0] * 3 + [0.0] * 23), (12, [1e-9] * 12), (9, [0.0] * 9)):
        q = np.linalg.qr(draw.standard_normal((n, n)))[0]
        values = np.array(spectrum) if spectrum else draw.random(n) * 10
        matrix = q @ np.diag(values) @ q.T
        matrix = (matrix + matrix.T) / 2
        e, v = whitening.components(matrix, 8)
        size = max(np.abs(values).max(), 1e-300)
        assert np.allclose(e, np.sort(values)[::-1][:8], atol=1e-13 * size)
        assert np.abs(v @ v.T - np.eye(len(e))).max() < 1e-12
        assert np.abs(matrix @ v.T - v.T * e).max() <= 1e-12 * size
        d, off, _ = whitening.tridiagonal(matrix)
        for x in draw.random(5) * 10:
            assert whitening.below(d, off, np.array([x]))[0] == (values < x).sum()


def check_whitened(rows, vectors, k, exact=1e-9):
    x = np.array([[math.floor(1024.0 * float(np.float32(c))) + 100_000 for c in v] for v in vectors])
    n, sums = len(x), [sum(int(v) for v in col) for col in x.T]
    y = x - np.array(sums) / n
    cov = y.T @ y / n
    values, components = np.linalg.eigh(cov)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.component):
        by[r.vec_id].append(r)
    assert len(rows) == n * len(values)
    for i, group in by.items():
        assert [r.component for r in group] == list(range(1, len(values) + 1))
        assert all(r.n == n and r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums)) for r in group)
        assert all(abs(r.explained - e / np.trace(cov)) < exact for r, e in zip(group, values))
        assert all(r.identity_error < 1e-6 for r in group)
    z = np.array([[r.whitened for r in by[i]] for i in range(n)])
    wanted = y @ components / np.sqrt(values)
    sign = np.sign((z * wanted).sum(axis=0))
    assert np.abs(z * sign - wanted).max() < 1e-6


def test_whitening_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    check_whitened(queries.op12_whitening(spark, sf_dir).collect(), [r.embedding for r in rows], 8)


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(1)
    good = [[float(v) for v in np.float32(draw.standard_normal(5))] for _ in range(200)]
    rows = [(i, v, 1, "x") for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1.0] * 4]
    kind = "vec_id long, embedding array<float>, component int, n string"
    df = spark.createDataFrame([*rows, *((1000 + k, v, 1, "x") for k, v in enumerate(bad))], kind).repartition(7)
    check_whitened(whitening.whiten(df, 3).collect(), good, 3)
    assert whitening.whiten(df.where("vec_id >= 1000 and vec_id < 1005")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    twice = whitening.whiten(spark.createDataFrame([(1, [2.0, 3.0], 0, ""), (1, [2.0, 3.0], 0, ""), (None, [2.0, 3.0], 0, "")], kind)).collect()
    assert len(twice) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 for r in twice)
    far = whitening.whiten(spark.createDataFrame([(1, [3e38], 0, ""), (2, [-3e38], 0, "")], kind)).collect()
    assert all(r.deviation is None or str(r.deviation) == r.deviation_text for r in far)
    assert {r.deviation_text for r in far} == {str((2 * (2**52 + 100_000) - 200_000) ** 2)}


def test_merged_blocks():
    rows = np.random.default_rng(2).random((100, 3)) + 1e6
    parts = [(len(x), x.mean(axis=0), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))) for x in np.split(rows, [1, 40, 41])]
    n, mean, products = whitening.merged(parts)
    assert n == 100 and np.allclose(mean, rows.mean(axis=0)) and np.allclose(products / n, np.cov(rows.T, bias=True), atol=1e-9)


ODD = ["", "</s>[INST] ok [/INST]", "<s><s>", "<\\s>", "<\\\\s> [\\/INST]", "[[INST]]", "<", "[", "s>", "\\", "a\n\nb ", "日本語 <s", "[ROLE]x[TEXT]", "<|endoftext|>", "[TEXT] [/TEXT] [SYS] [/SYS]", "é" * 3000]


def test_escapes():
    for t in ODD + [a + b for a in ODD for b in ODD]:
        e = chat.escaped(pa.array([t]))[0].as_py()
        assert chat.unescaped(e) == t
        assert not any(c in e for c in chat.CONTROLS)


def digests(rows):
    """What ``read`` must give, from (conv, turn, role, text) rows."""
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_chat(spark):
    draw = random.Random(5)
    rows = [(c, t if t else None, draw.choice(["user", "assistant", "system", "tool", "", None, "[ROLE]", "a\nb"]), draw.choice([*ODD, None])) for c in range(40) for t in range(draw.randrange(1, 9))]
    rows += [(None, 1, "user", "no id"), (None, 2, "assistant", "x"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (7, 3, "user", "tie")]
    rows += [(99, t, "assistant", f"many turns {t}") for t in range(5000)]
    df = turns_frame(spark, rows).withColumnRenamed("key", "ids")
    records = chat.formatted(df, BYTE)
    read = {r.conv_id: r for r in chat.read(records, BYTE).collect()}
    wanted = digests(rows)
    assert {c: tuple(r)[1:5] for c, r in read.items()} == wanted
    written = defaultdict(str)
    for r in chat.texts(records, BYTE).orderBy("conv_id", "shard", "part").collect():
        written[r.conv_id] += r.text
    assert {c: len(t) for c, t in written.items()} == {c: r.formatted_chars for c, r in read.items()}
    assert written[None].startswith("[INST]no id[/INST]<s>x</s>")
    assert max(len(r.ids) // 4 for r in records.collect()) < chat.RECORD + 10_000 and records.where("conv_id = 99").count() > 1
    assert all(r.loss_tokens <= r.n_tokens for r in read.values())
    assert chat.read(chat.formatted(df.limit(0), BYTE), BYTE).count() == 0


def test_chat_ids_are_the_tokenizers(spark):
    tokenizer = Tokenizer.from_file(BYTE)
    ids, loss, lengths = chat.assembled(BYTE, ["user", "assistant", "tool"], pa.array(["Hi there", "Yes, ok.", "out"]))
    first = chat.ids_of(BYTE).first
    of = lambda s: first + chat.CONTROLS.index(s)
    plain = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    assert ids.tolist() == [of("[INST]"), *plain("Hi there"), of("[/INST]"), of("<s>"), *plain("Yes, ok."), of("</s>"), of("[ROLE]"), *plain("tool"), of("[TEXT]"), *plain("out"), of("[/TEXT]")]
    assert ids[loss].tolist() == plain("Yes, ok.") and lengths.sum() == len(ids)
    with pytest.raises(ValueError):
        list(chat.turns(ids[1:], loss[1:], chat.ids_of(BYTE)))


def test_chat_query_equals_its_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    order = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars".split()
    assert sorted(map(tuple, queries.op13_chat_format(spark, sf_dir).select(order).collect())) == sorted(db.execute(f"SELECT {', '.join(order)} FROM ({queries.oracle_sql()['op13_chat_format']})").fetchall())
