"""Hashed n-gram multinomials of trusted and raw text: importance resampling and quality rules.

Both models count the hashed word 1- and 2-grams of whole texts in ``2**bits`` cells.  A task keeps one dense
array and sends each cell it met once, so what is shuffled and what the driver gets is bounded by the cells,
not by the corpus.  Raw counts cover every document; trusted counts cover the trusted ids (at most
``max_trusted`` of them, by hash order), which is the bound of the labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: How much per n-gram a sample's least text may be unlike the target, for the default size of the sample.  Set from
#: labelled rows held out of the fit (a third of sf0.1, by id): 189 of 195 of quality 0 are below it, none of the
#: 1,154 of quality 1 is.
FLOOR = -0.1


def cells(rows: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of each word 1- and 2-gram of the texts, ASCII case folded."""
    hashes, sizes = common.hashed_words(rows)
    inside, owner = common.gram_owner(sizes, 2)
    grams = np.concatenate([hashes, common.chain(hashes, 2)[inside]])
    return (grams >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([np.repeat(np.arange(len(sizes)), sizes), owner])


@dataclass(frozen=True)
class RatioModel:
    """``weights[cell]``: log of the cell's probability in trusted text over that in raw text."""

    bits: int
    weights: np.ndarray

    def score(self, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the weights of each text's n-grams, number of them)."""
        found, owner = cells(rows, self.bits)
        return np.bincount(owner, self.weights[found], len(rows)), np.bincount(owner, minlength=len(rows))


def trusted_ids(labels: DataFrame, label_col: str, id_col: str = "doc_id", max_trusted: int = 20_000) -> list:
    """Ids with label 1, at most ``max_trusted`` of them: those whose hashes are lowest."""
    ids = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64(id_col), id_col).limit(max_trusted).collect()]


def counts(df: DataFrame, trusted: list, bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """cell, trusted, raw: occurrences over all documents."""
    known = df.sparkSession.sparkContext.broadcast(frozenset(trusted))

    def run(batches):
        both = np.zeros((2, 1 << bits), np.int64)
        for ids, rows in common.row_batches(batches):
            found, owner = cells(rows, bits)
            both[1] += np.bincount(found, minlength=1 << bits)
            good = np.fromiter((doc in known.value for doc in ids.to_pylist()), bool, len(ids))
            both[0] += np.bincount(found[good[owner]], minlength=1 << bits)
        hit = np.flatnonzero(both[1])
        for k in range(0, len(hit), 8192):
            part = hit[k : k + 8192]
            yield pa.RecordBatch.from_pydict({"cell": part, "trusted": both[0, part], "raw": both[1, part]})

    each = common.texts(df, id_col, text_col).mapInArrow(run, "cell long, trusted long, raw long")
    return each.groupBy("cell").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


def fit(df: DataFrame, trusted: list, bits: int = 16, prior: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> RatioModel:
    """Both multinomials; at most ``2**bits`` rows come to the driver.

    Each cell gets ``prior`` occurrences more, shared between the models as all text is, so that a cell met a
    few times says little.
    Without trusted documents every weight is 0.  Documents without an id are raw text only.
    """
    found = counts(df, trusted, bits, id_col, text_col).toPandas()
    both = np.zeros((2, 1 << bits))
    both[0, found["cell"]], both[1, found["cell"]] = found["trusted"], found["raw"]
    if not both[0].any():
        return RatioModel(bits, np.zeros(1 << bits))
    share = both[0].sum() / both[1].sum()
    return RatioModel(bits, np.log((both[0] + prior * share) / ((both[1] + prior) * share)))


def importance(df: DataFrame, model: RatioModel, shrink: float, text_col: str) -> Column:
    """text -> struct(log_weight, n_grams, log_ratio): the weight of the whole text, and per n-gram, shrunk for short texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("log_weight double, n_grams long, log_ratio double")
    def weigh(text: pa.Array) -> pa.Array:
        parts = [(np.empty(0), np.empty(0, np.int64))]
        _, offsets = common.string_bytes(text)
        parts += [shared.value.score(text.slice(i, j - i)) for i, j in common.text_blocks(offsets, 1_000_000)]
        total, n = (np.concatenate(x) for x in zip(*parts))
        return pa.StructArray.from_arrays([pa.array(total), pa.array(n), pa.array(total / (n + shrink))], ["log_weight", "n_grams", "log_ratio"])

    return weigh(F.coalesce(F.col(text_col), F.lit("")))


def gumbel(seed: int, *columns: str) -> Column:
    """Gumbel noise that is a function of the seed and the columns, so that any retry draws the same sample."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.col(c) for c in columns)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value of a column: counts over narrowing ranges, at most ``bins`` rows to the driver each.

    None if there are fewer than k values; k < 1 gives infinity.
    """
    if k < 1:
        return float("inf")
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k:
        return None
    left = k  # of the values in [low, high]
    while low < high:
        width = (high - low) / bins
        cell = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        held = df.where(F.col(column).between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b"))
        for r in sorted(held.collect(), key=lambda r: -r["cell"]):
            if left <= r["n"]:
                break
            left -= r["n"]
        if (low, high) == (r["a"], r["b"]):
            return high if left == 1 else low  # neighbouring numbers
        low, high = r["a"], r["b"]
    return low


def tempered(weight: Column, effective: float | None) -> Column:
    """Of a struct from ``importance``: the log weight to sample by."""
    return weight["log_weight"] if effective is None else effective * weight["log_ratio"]


def resample(df: DataFrame, model: RatioModel, k: int | None = None, share: float | None = None, floor: float = FLOOR, effective: float | None = 50.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Importance resampling without replacement: the k documents of largest ``key`` have ``kept`` true.

    The importance weight of a text is p_target(text) / p_raw(text) under the two multinomials.  The n-grams of a
    text are far from independent draws, so the weight is tempered to the power effective / (n_grams + 20), as if
    every text had ``effective`` n-grams; None samples by the whole weight.  ``key`` is the log of that plus
    Gumbel noise: the k largest keys are a draw of k documents, one after the other, each with probability in
    proportion to its tempered weight among those left.

    One row per document: doc_id, log_weight (whole), n_grams, log_ratio (log_weight / (n_grams + 20)), key, kept.
    The size of the sample is ``k``, or ``share`` of all rows, or by default the number of documents whose
    log_ratio reaches ``floor``.  Every document is scored; documents that tie at the k-th key (repeated rows)
    share their verdict.  Null and empty texts have no n-grams and a weight of 1.  An empty table gives an empty
    result.
    """
    two = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = two.select("doc_id", "text", importance(two, model, 20.0, "text").alias("w"))
    key = tempered(F.col("w"), effective) + gumbel(seed, "doc_id", "text")
    scored = common.written(weighed.select("doc_id", "w.*", key.alias("key")), "importance")
    return scored.withColumn("kept", _reaches(F.col("key"), _least_key(scored, k, share, floor)))


def resampled(df: DataFrame, model: RatioModel, k: int | None = None, share: float | None = None, floor: float = FLOOR, effective: float | None = 50.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents themselves, with all their columns, that ``resample`` keeps."""
    own = common.fresh(df, "own")
    weighed = df.withColumn(own, importance(df, model, 20.0, text_col))
    key = tempered(F.col(own), effective) + gumbel(seed, id_col, text_col)
    keys = common.written(weighed.select(F.col(f"{own}.log_ratio").alias("log_ratio"), key.alias("key")), "importance")
    return weighed.where(_reaches(key, _least_key(keys, k, share, floor))).select(*df.columns)


def _least_key(scored: DataFrame, k: int | None, share: float | None, floor: float) -> float | None:
    if k is None:
        k = scored.where(F.col("log_ratio") >= floor).count() if share is None else round(share * scored.count())
    return kth_largest(scored, "key", k)


def _reaches(key: Column, least: float | None) -> Column:
    return F.lit(True) if least is None else key >= F.lit(least)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = text.encode().split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, "#*$%&|<>"))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    repeated = 0
    if n >= 9:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
        for k in (1, 2, 4):  # names of 2-, 4- and 8-word windows, exact
            _, ids = np.unique(ids[:-k] * n + ids[k:], return_inverse=True)
        again = np.bincount(ids)[ids] > 1
        if again.any():
            cover = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 8, -1)
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    return n, len(text) - spaces, symbols, dups, repeated


def quality(df: DataFrame, model: RatioModel, threshold: float = -0.15, shrink: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, length-normalised log-likelihood ratio and deterministic verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept.  A
    null or empty text has no words and fails.  Repeated rows get equal rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(ids, rows):
        total, n = shared.value.score(rows)
        base = [base_counts(t) for t in rows.to_pylist()]
        failed = [b[0] < 20 or 100 * b[4] > 30 * b[0] for b in base]
        ratio = total / (n + shrink)
        return [ids, *zip(*base), failed, ratio, [not f and r >= threshold for f, r in zip(failed, ratio.tolist())]]

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = f"doc_id {common.id_type(df, id_col)}, {', '.join(f'{x} long' for x in names)}, base_failed boolean, log_ratio double, kept boolean"
    return common.map_rows(common.texts(df, id_col, text_col), run, schema)


def passing(df: DataFrame, model: RatioModel, threshold: float = -0.15, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that the quality rules keep."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array) -> pa.Array:
        out: list[bool] = []
        _, offsets = common.string_bytes(text)
        for i, j in common.text_blocks(offsets, 1_000_000):
            rows = text.slice(i, j - i)
            total, n = shared.value.score(rows)
            for t, good in zip(rows.to_pylist(), total / (n + 20.0) >= threshold):
                words, *_, repeated = base_counts(t) if good else (0, 0)
                out.append(words >= 20 and 100 * repeated <= 30 * words)
        return pa.array(out, pa.bool_())

    return df.where(kept(F.coalesce(F.col(text_col), F.lit(""))))
