"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A shard is a file of records, each framed as

    length (8 bytes) | masked CRC-32C of the length (4) | payload | masked CRC-32C of the payload (4)

and the payload is: token width in bytes (1), kind of the document id (1: 0 none, 1 integer, 2 text), the id (8 bytes,
signed; text: its length in 4 bytes and UTF-8), token ids.  All numbers are little-endian.  Shards are ranges of ascending document ids in ascending order of the shard
number; the records of a shard ascend too.  The offset index is a Parquet table beside the shards, one row a
record, so a shuffled reader fetches any record with one ranged read and never scans.

Files are written with ``pyarrow.fs`` to the shared folder (local mounts, hdfs, s3, gs).  Every attempt of a
task writes a file of its own name and only the index names the files that count, so lost executors, retries
and speculative attempts leave no wrong records.

Nulls: a null text is empty (its end id alone); null ids come first and stay null.  Rows of one id, or of none, are
ordered by a hash of their texts, so that many of them spread over shards too.  Ids that are not integers are
kept as text.  An empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, crc, tokens

INDEX = "shard int, record long, path string, offset long, size long, n_tokens long"
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = crc.masked(crc.crc32c_many(lengths)), crc.masked(crc.crc32c_many(payloads))
    return [n + h.tobytes() + p + b.tobytes() for n, h, p, b in zip(lengths, heads, payloads, bodies)]


def payload(doc_id: int | str | None, ids: np.ndarray) -> bytes:
    if isinstance(doc_id, str):
        raw = doc_id.encode()
        return struct.pack("<BBI", ids.dtype.itemsize, 2, len(raw)) + raw + ids.tobytes()
    return struct.pack("<BBq", ids.dtype.itemsize, doc_id is not None, doc_id or 0) + ids.tobytes()


def parse(body: bytes) -> tuple[int | str | None, np.ndarray]:
    width, kind = body[0], body[1]
    if kind == 2:
        at = 6 + struct.unpack_from("<I", body, 2)[0]
        return body[6:at].decode(), np.frombuffer(body, f"<u{width}", offset=at)
    return struct.unpack_from("<q", body, 2)[0] if kind else None, np.frombuffer(body, f"<u{width}", offset=10)


def checked(raw: list[bytes]) -> list[bytes]:
    """The payloads of framed records; raises on a record whose length or checksums are wrong."""
    bodies = [x[12:-4] for x in raw]
    lengths = [x[:8] for x in raw]
    heads, tails = crc.masked(crc.crc32c_many(lengths)), crc.masked(crc.crc32c_many(bodies))
    for x, body, h, t in zip(raw, bodies, heads, tails):
        if struct.unpack("<Q", x[:8])[0] != len(body) or x[8:12] != h.tobytes() or x[-4:] != t.tobytes():
            raise ValueError("damaged record")
    return bodies


def _id(df: DataFrame, id_col: str) -> str:
    return "long" if common.id_type(df, id_col) in _INTEGERS else "string"


def write_records(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", words: bool = True) -> DataFrame:
    """Writes the shards and returns their offset index (a written table): shard, record, path, offset, size, n_tokens."""
    spark = df.sparkSession
    folder = common.shared_dir(spark, "records")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = common.texts(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast(_id(df, id_col))).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    arrow = common.arrow_of(INDEX)

    def write(batches):
        from pyspark import TaskContext

        shard, at, record, out = TaskContext.get().partitionId(), 0, 0, None
        path = f"{folder}/data/shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        for ids, rows in common.row_batches(batches, 1_000_000):
            if out is None:
                store, name = _open(path)
                store.create_dir(name.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(name)
            found, lengths = tokens.encoder(tokenizer, words).encode(rows, [end_id])
            framed = frames([payload(i, x) for i, x in zip(ids.to_pylist(), np.split(found, np.cumsum(lengths)[:-1]))])
            out.write(b"".join(framed))
            sizes = np.array([len(x) for x in framed])
            n = len(framed)
            yield common.batch_of(arrow, [[shard] * n, np.arange(record, record + n), [path] * n, at + np.cumsum(sizes) - sizes, sizes, lengths])
            at, record = at + int(sizes.sum()), record + n
        if out is not None:
            out.close()

    index = ordered.mapInArrow(write, INDEX)
    # Parquet's own writer makes the folder, on any file system.
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _records(path: str, records: int):
    """(document ids, token arrays) of a whole shard, block by block, streamed."""
    store, name = _open(path)
    with store.open_input_stream(name, buffer_size=1 << 20) as f:
        for start in range(0, records, 256):
            raw = []
            for _ in range(start, min(start + 256, records)):
                head = f.read(12)
                raw.append(head + f.read(struct.unpack_from("<Q", head)[0] + 4))
            yield start, *zip(*map(parse, checked(raw)))


def _each_shard(index: DataFrame, id_type: str, columns: str, row) -> DataFrame:
    """``row(ids, tokens before) -> values`` of every record: shard, record, doc_id and ``columns``; a task streams whole shards."""
    shards = index.groupBy("shard", "path").agg(F.count("*").alias("records"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"shard int, record long, doc_id {id_type}, {columns}"
    arrow = common.arrow_of(schema)

    def read(batches):
        for batch in batches:
            for shard, path, records in zip(*(c.to_pylist() for c in batch.columns)):
                before = 0
                for start, docs, found in _records(path, records):
                    values = []
                    for x in found:
                        values.append(row(x, before))
                        before += len(x)
                    m = len(docs)
                    yield common.batch_of(arrow, [[shard] * m, np.arange(start, start + m), docs, *zip(*values)])

    return shards.repartition(n).mapInArrow(read, schema)


def read_shards(index: DataFrame, id_type: str = "long") -> DataFrame:
    """Every record of the shards that an index names: shard, record, doc_id, ids (4 bytes each)."""
    return _each_shard(index, id_type, "ids binary", lambda x, before: (x.astype("<u4").tobytes(),))


def read_records(rows: DataFrame, id_type: str = "long") -> DataFrame:
    """The records of any subset of index rows, in any order, by ranged reads: shard, record, doc_id, ids."""
    schema = f"shard int, record long, doc_id {id_type}, ids binary"
    arrow = common.arrow_of(schema)

    def read(batches):
        for batch in batches:
            for shard, record, path, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = _open(path)
                with store.open_input_file(name) as f:
                    doc_id, ids = parse(checked([f.read_at(size, offset)])[0])
                yield common.batch_of(arrow, [[shard], [record], [doc_id], [ids.astype("<u4").tobytes()]])

    return rows.select("shard", "record", "path", "offset", "size").mapInArrow(read, schema)


def digests(index: DataFrame, id_type: str = "long") -> DataFrame:
    """Per record, from the files: doc_id, start (ids before it), n_tokens, ids_crc32, shard, record."""
    read = _each_shard(index, id_type, "n_tokens long, local long, ids_crc32 long", lambda x, before: (len(x), before, zlib.crc32(x.astype("<u4").tobytes())))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # One row of two numbers for each shard, whatever the corpus.
    return read.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "record")
