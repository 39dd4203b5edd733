"""Packing by concatenate-and-cut: two-pass prefix sums give global offsets, fixed windows cut the stream.

Pass one encodes every document once and writes its ids with the part (writing task) it lies in and its
offset there.  The token totals of the parts are summed in part order; a document's place in the whole
stream is its part's base plus its offset.  Pass two cuts each document at multiples of ``length``; no row
is shuffled and no token is encoded twice.

Nulls: a null text is an empty document (its end id alone); a null id is kept as it is.  Repeated rows and
ids are packed once for each row.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encoded_parts(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table: doc_id, n_tokens, ids (little-endian, 2 or 4 bytes each), part, part_offset."""
    schema = f"doc_id {common.id_type(df, id_col)}, n_tokens long, ids binary, part int, part_offset long"
    arrow = common.arrow_of(schema)

    def run(batches):
        from pyspark import TaskContext

        part, offset = TaskContext.get().partitionId(), 0
        for ids, rows in common.row_batches(batches):
            found, sizes = tokens.encoder(tokenizer).encode(rows, [end_id])
            before = offset + np.cumsum(sizes) - sizes
            offset += int(sizes.sum())
            yield common.batch_of(arrow, [ids, sizes, tokens.binaries(found, sizes), [part] * len(ids), before])

    return common.written(common.texts(df, id_col, text_col).mapInArrow(run, schema), "packing", compression="zstd")


def bases(parts: DataFrame) -> DataFrame:
    """part, base: tokens in all earlier parts.  One row for each writing task goes through the window."""
    totals = parts.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Sequence ``s`` holds the tokens s*length to (s+1)*length of the stream; only the last is short.
    """
    parts = encoded_parts(df, tokenizer, end_id, id_col, text_col)
    # The bases are one row of two numbers for each writing task, whatever the corpus.
    placed = parts.join(F.broadcast(bases(parts)), "part").select("doc_id", "ids", "n_tokens", (F.col("base") + F.col("part_offset")).alias("at"))
    schema = f"doc_id {common.id_type(df, id_col)}, {PIECES}"
    arrow = common.arrow_of(schema)

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            for doc, raw, n, at in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    piece = ids[start : start + size].tobytes()
                    for column, v in zip(out, (doc, start, size, zlib.crc32(piece), n, sequence, offset, piece)):
                        column.append(v)
                    start += size
            yield common.batch_of(arrow, out)

    return placed.mapInArrow(cut, schema)
