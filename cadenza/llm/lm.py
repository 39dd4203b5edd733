"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

    p(w | v) = l2[b] c(vw)/c(v) + l1[b] c(w)/N + l0[b] / (V + 1),    b = log2 class of c(v)

The weights of each context-frequency class b are learned by expectation-maximisation on the counts of a part
of the training documents that is deleted from the estimates while the weights are learned.  Scores then use
the counts of all training documents.

How counts meet texts: texts are cut into blocks of whole documents, kept in a written table with word ids
local to the block.  A block asks once for each of its distinct words and bigrams, whatever their frequency,
so a hot n-gram costs one entry a block.  Requests travel as packed arrays to hash buckets, where they are
summed in 64 bits; the totals travel back in the order in which they were asked.  Buckets hold an even share of the
distinct n-grams and grow in number with the shuffle partitions.  A bucket tells words apart by 48 bits of
their hashes and bigrams by 40, besides the bits that chose the bucket; hashes are keyed, by a key that each run draws.

The text is folded A-Z to a-z; words are what is between white space (space, U+0009 to U+000D); each document
ends in an end token and is preceded by a start context.  Null and empty texts are the end token alone; null
ids train.  Repeated rows count and are scored for each row.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN, DELETED, HELD_OUT = 0, 1, 2
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CLASSES, STEPS = 40, 2  # context classes; steps of the estimates' histogram per factor of 2


def part_of(doc_id: object, folds: int = 7, held: int = 2, deleted: int = 3) -> int:
    """TRAIN, DELETED (trains, but first teaches the weights) or HELD_OUT, by crc32 of the id as text."""
    r = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds
    return HELD_OUT if r == held else DELETED if r == deleted else TRAIN


def blocks(df: DataFrame, id_col: str, text_col: str, block_chars: int, key: int = common.KEY) -> DataFrame:
    """Written table, one row a block of documents of one part: block, part, ids, sizes, hashes (distinct), words (index of each)."""
    schema = f"block long, part int, ids array<{common.id_type(df, id_col)}>, sizes binary, hashes binary, words binary"
    arrow = common.arrow_of(schema)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for ids, rows in common.row_batches(batches, block_chars):
            parts = np.array([part_of(i) for i in ids.to_pylist()])
            for part in (TRAIN, DELETED, HELD_OUT):
                at = np.flatnonzero(parts == part)
                if not len(at):
                    continue
                hashes, sizes = common.hashed_words(rows.take(pa.array(at)), key=key)
                distinct, words = np.unique(hashes, return_inverse=True)
                yield common.batch_of(arrow, [[block], [part], [ids.take(pa.array(at)).to_pylist()], [common.pack(sizes.astype(np.uint32))], [distinct.tobytes()], [common.pack(words.astype(np.uint32))]])
                block += 1

    return common.written(common.texts(df, id_col, text_col).mapInArrow(run, schema), "lm-blocks", compression="zstd")


class Block:
    """The tokens of a block: ``tokens`` and their ``contexts`` are places in ``types`` (distinct hashes; START is last)."""

    def __init__(self, sizes: bytes, hashes: bytes, words: bytes, buckets: int):
        self.sizes = common.unpack(sizes, np.uint32).astype(np.int64)
        known = np.frombuffer(hashes, np.uint64)
        n = int(self.sizes.sum())
        local = common.unpack(words, np.uint32).astype(np.int64)
        self.types = np.concatenate([known, [END, START]])
        end, start = len(known), len(known) + 1
        self.lengths = self.sizes + 1
        last = np.cumsum(self.lengths) - 1
        self.tokens = np.full(n + len(last), end)
        inner = np.ones(len(self.tokens), bool)
        inner[last] = False
        self.tokens[inner] = local
        self.contexts = np.concatenate([[start], self.tokens[:-1]])
        self.contexts[last[:-1] + 1] = start
        pair = self.contexts * len(self.types) + self.tokens
        pairs, self.pair_of, self.pair_n = np.unique(pair, return_inverse=True, return_counts=True)
        hashed = common.fmix(common.fmix(self.types[pairs // len(self.types)]) + self.types[pairs % len(self.types)])
        self.words_by = _Asked(common.fmix(self.types[:-1]), np.bincount(self.tokens, minlength=start)[:start], buckets, 48)
        self.pairs_by = _Asked(hashed, self.pair_n, buckets, 40)


class _Asked:
    """Distinct keys of ``bits`` bits in the order in which they are asked: by bucket, then ascending."""

    def __init__(self, hashes: np.ndarray, n: np.ndarray, buckets: int, bits: int):
        whole = (hashes % np.uint64(buckets)) << np.uint64(bits) | (hashes // np.uint64(buckets)) & np.uint64((1 << bits) - 1)
        self.order = np.argsort(whole)
        whole = whole[self.order]
        self.cuts = np.searchsorted(whole >> np.uint64(bits), np.arange(buckets + 1, dtype=np.uint64))
        self.n = n[self.order].astype(np.uint32)
        self.keys = whole & np.uint64((1 << bits) - 1)

    def spread(self, answers: np.ndarray) -> np.ndarray:
        """Answers in the order asked, put back where the keys came from."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = answers
        return out


REQUEST = "bucket int, block long, part int, words binary, word_n binary, pairs binary, pair_n binary"
REPLY = "block long, part int, bucket int, word_all binary, word_main binary, pair_all binary, pair_main binary, n_types long, n_all long, n_main long"


def requests(table: DataFrame, buckets: int) -> DataFrame:
    """What each block asks of each bucket; held-out blocks ask with counts of 0."""
    arrow = common.arrow_of(REQUEST)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["sizes"], row["hashes"], row["words"], buckets)
                w, p = b.words_by, b.pairs_by
                some = 0 if row["part"] == HELD_OUT else 1
                out: list[list] = [[] for _ in arrow]
                for k in range(buckets):
                    i, j, m, n = w.cuts[k], w.cuts[k + 1], p.cuts[k], p.cuts[k + 1]
                    if i == j and m == n:
                        continue
                    for column, v in zip(out, (k, row["block"], row["part"], common.steps(w.keys[i:j]), common.pack(w.n[i:j] * np.uint32(some)), common.steps(p.keys[m:n]), common.pack(p.n[m:n] * np.uint32(some)))):
                        column.append(v)
                yield common.batch_of(arrow, out)

    return table.select("block", "part", "sizes", "hashes", "words").mapInArrow(run, REQUEST)


def packed(x: np.ndarray) -> bytes:
    """Counts, of 4 bytes each where they fit, behind a byte that says so."""
    wide = bool(x.max(initial=0) >= 1 << 32)
    return bytes([wide]) + common.pack(x.astype(np.uint64 if wide else np.uint32))


def unpacked(raw: bytes) -> np.ndarray:
    return common.unpack(raw[1:], np.uint64 if raw[0] else np.uint32).astype(np.int64)


def _totals(keys: list[np.ndarray], counts: list[bytes], parts: list[int]) -> tuple[list, list, int, int, int]:
    sizes = np.array([len(k) for k in keys])
    flat = np.concatenate(keys)
    n = np.concatenate([common.unpack(c, np.uint32) for c in counts]).astype(np.float64)
    main = n * np.repeat(np.array(parts) == TRAIN, sizes)
    _, at = np.unique(flat, return_inverse=True)
    every, mains = np.bincount(at, n), np.bincount(at, main)
    cuts = np.cumsum(sizes)[:-1]
    answers = [[x.astype(np.int64) for x in np.split(total[at], cuts)] for total in (every, mains)]
    return *answers, int((every > 0).sum()), int(n.sum()), int(main.sum())


def replies(asked: DataFrame) -> DataFrame:
    """Written table of the totals; rows of block -1 hold a bucket's number of word types and tokens."""
    arrow = common.arrow_of(REPLY)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pydict()
        word_all, word_main, types, n_all, n_main = _totals([common.unsteps(w) for w in rows["words"]], rows["word_n"], rows["part"])
        pair_all, pair_main, *_ = _totals([common.unsteps(p) for p in rows["pairs"]], rows["pair_n"], rows["part"])
        deleted = [p == DELETED for p in rows["part"]]
        bucket = rows["bucket"][0]
        every = lambda answers: [*map(packed, answers), b""]
        some = lambda answers: [*(packed(x) if d else b"" for x, d in zip(answers, deleted)), b""]
        out = [[*rows["block"], -1], [*rows["part"], -1], [bucket] * (len(deleted) + 1), every(word_all), some(word_main), every(pair_all), some(pair_main)]
        none = [0] * len(deleted)
        return pa.Table.from_batches([common.batch_of(arrow, [*out, [*none, types], [*none, n_all], [*none, n_main]])])

    return common.written(asked.groupBy("bucket").applyInArrow(run, REPLY), "lm-totals", compression="zstd")


def answered(table: DataFrame, totals: DataFrame) -> DataFrame:
    """Blocks with their replies, ordered by bucket inside ``got``."""
    got = totals.where("block >= 0").groupBy("block", "part").agg(F.collect_list(F.struct("bucket", "word_all", "word_main", "pair_all", "pair_main")).alias("got"))
    return table.join(got.drop("part"), "block")


def _counts(row: dict, buckets: int, which: str) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """(block, c(w) of each token, c(v) of each context, c(vw)); START counts as often as END."""
    b = Block(row["sizes"], row["hashes"], row["words"], buckets)
    got = sorted(row["got"], key=lambda r: r["bucket"])
    flat = lambda name: np.concatenate([unpacked(r[f"{name}_{which}"]) for r in got])
    words = b.words_by.spread(flat("word"))
    words = np.append(words, words[-1])
    pairs = b.pairs_by.spread(flat("pair"))
    return b, words[b.tokens], words[b.contexts], pairs[b.pair_of]


def context_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(CLASSES - 1, np.ceil(np.log2(n + 1.0)).astype(np.int64))


def histogram(deleted: DataFrame, buckets: int, n_main: int) -> DataFrame:
    """context class and classes of both estimates, with counts and sums: what the weights are learned from.

    The number of rows is bounded by the classes: the estimates are binned by powers of 2**(1/STEPS).
    """
    schema = "b int, q2 int, q1 int, n long, s2 double, s1 double"
    arrow = common.arrow_of(schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, c1, cv, c2 = _counts(row, buckets, "main")
                f2, f1 = c2 / np.maximum(cv, 1), c1 / max(1, n_main)
                q2, q1 = (np.where(f > 0, np.clip(np.floor(-STEPS * np.log2(np.maximum(f, 1e-18))), 0, 98), 99).astype(np.int64) for f in (f2, f1))
                cell, at = np.unique((context_class(cv) * 100 + q2) * 100 + q1, return_inverse=True)
                yield common.batch_of(arrow, [cell // 10_000, cell // 100 % 100, cell % 100, np.bincount(at), np.bincount(at, f2), np.bincount(at, f1)])

    return deleted.mapInArrow(run, schema).groupBy("b", "q2", "q1").agg(*(F.sum(c).alias(c) for c in ("n", "s2", "s1")))


def learn(rows: list, uniform: float, rounds: int = 30) -> np.ndarray:
    """[class, (bigram, unigram, uniform)] by expectation-maximisation; classes without data share the pooled weights."""
    weights = np.full((CLASSES, 3), 1 / 3)
    b = np.array([r["b"] for r in rows], np.int64)
    n = np.array([r["n"] for r in rows], float)
    f = np.array([(r["s2"] / r["n"], r["s1"] / r["n"], uniform) for r in rows]).reshape(-1, 3)
    pooled = np.full(3, 1 / 3)
    for _ in range(rounds):
        share = weights[b] * f
        share *= (n / share.sum(axis=1))[:, None]
        mass = np.stack([np.bincount(b, share[:, k], CLASSES) for k in range(3)], axis=1)
        every = mass.sum(axis=0)
        pooled = every / every.sum() if every.sum() else pooled
        seen = mass.sum(axis=1) > 0
        weights[seen] = mass[seen] / mass[seen].sum(axis=1, keepdims=True)
        weights[~seen] = pooled
    # An estimate of 1 for "uniform" keeps every probability above 0; a context never seen has no bigram part.
    weights = 0.999 * weights + 0.001 * np.array([0, 0, 1])
    weights[0] = [0, weights[0, 1] / (weights[0, 1] + weights[0, 2]), weights[0, 2] / (weights[0, 1] + weights[0, 2])]
    return weights


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the whole text)."""
    spark = df.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = blocks(df, id_col, text_col, block_chars, int.from_bytes(os.urandom(8), "little"))
    totals = replies(requests(table, buckets))
    types, n, n_main = (int(x or 0) for x in totals.where("block = -1").agg(F.sum("n_types"), F.sum("n_all"), F.sum("n_main")).first())
    deleted = F.col("part") == DELETED
    found = histogram(answered(table.where(deleted), totals.where(deleted)), buckets, n_main).collect()
    weights = learn(found, 1 / (types + 1))
    schema = f"doc_id {common.id_type(df, id_col)}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = common.arrow_of(schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b, c1, cv, c2 = _counts(row, buckets, "all")
                part = weights[context_class(cv)]
                p = part[:, 0] * c2 / np.maximum(cv, 1) + part[:, 1] * c1 / max(1, n) + part[:, 2] / (types + 1)
                first = np.cumsum(b.lengths) - b.lengths
                sums = [np.add.reduceat(x, first) for x in ((c1 > 0).astype(np.int64), np.log10((c1 + 1) / (n + types + 1)), np.log10(p))]
                m = len(first)
                yield common.batch_of(arrow, [row["ids"], [row["part"] == HELD_OUT] * m, b.lengths, sums[0], [n] * m, sums[1], sums[2]])

    return answered(table, totals).mapInArrow(run, schema)
