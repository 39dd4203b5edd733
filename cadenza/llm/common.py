"""Helpers shared by the operators: shared-folder tables, numpy hashing, Arrow row batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space and U+0009 to U+000D.  ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``, else below the session's checkpoint folder.

    Where neither is set, a local master (as in tests) gets a temporary checkpoint folder; a cluster, whose
    machines do not share one, gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cadenza-"))
        root = context._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads, on whatever file system they are."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on, as ``doc_id`` and ``text`` (null text: empty)."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of a sequence of word hashes."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:size]
    for k in range(1, n):
        out = fmix(out) + hashes[k : k + size]
    return fmix(out) if n > 1 else out


def string_bytes(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts laid end to end, the offsets of each text in them), without copies."""
    rows = rows.fill_null("") if rows.null_count else rows
    kind = np.int64 if pa.types.is_large_string(rows.type) else np.int32
    offsets = np.frombuffer(rows.buffers()[1], kind)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    raw = rows.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of marked bytes; a run ends where its text ends."""
    starts, ends = inside.copy(), np.zeros(len(inside) + 1, bool)
    starts[1:] &= ~inside[:-1]
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    starts[cuts] = inside[cuts]
    ends[cuts] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


#: The key of word hashes where results have to be the same in every run.
KEY = 0x9E3779B97F4A7C15
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = KEY) -> np.ndarray:
    """Keyed 64-bit hashes of byte spans: from the key and the length on, 8 bytes at a time are mixed into the state.

    Spans of more than ``LONG_SPAN`` bytes are hashed by xxh3 with the key as its seed.
    """
    import xxhash

    size = ends - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = fmix(lanes[starts] & _LOW[np.minimum(size, 8)] ^ fmix(np.uint64(key) + size.astype(np.uint64)))
    todo, k = np.flatnonzero((size > 8) & (size <= LONG_SPAN)), 8
    while len(todo):
        left = size[todo] - k
        out[todo] = fmix(out[todo] ^ lanes[starts[todo] + k] & _LOW[np.minimum(left, 8)])
        todo, k = todo[left > 8], k + 8
    for at in np.flatnonzero(size > LONG_SPAN).tolist():
        out[at] = xxhash.xxh3_64_intdigest(data[starts[at] : ends[at]], key)
    return out


#: What this worker keeps between batches, by operator family; a worker that changes families drops the others'.
_KEPT: dict[str, dict] = {}


def kept(family: str) -> dict:
    """The family's cache; taking it empties those of all other families, so that a worker holds one at a time."""
    if family not in _KEPT:
        _KEPT.clear()
        _KEPT[family] = {}
    return _KEPT[family]


def text_blocks(offsets: np.ndarray, size: int = 96_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes: work arrays of this size stay in the processor's cache."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, stop
        start = stop


def hashed_words(rows: pa.Array, fold: bool = True, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """(keyed hashes of all words of the texts, one text after the other; words of each text).  ``fold``: A-Z as a-z."""
    whole, offsets = string_bytes(rows)
    hashes, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for i, j in text_blocks(offsets):
        data, cuts = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if fold:
            data = data + ((data - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
        starts, ends = runs_of((data != 32) & ((data - np.uint8(9)) > 4), cuts)
        hashes.append(span_hashes(data, starts, ends, key))
        sizes.append(np.diff(np.searchsorted(starts, cuts)))
    return np.concatenate(hashes), np.concatenate(sizes)


def gram_owner(sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: which of the ``sum - n + 1`` positions start an n-gram inside one text, and whose."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(owner) < n:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
    return inside, owner[: len(owner) - n + 1][inside]


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes: what travels or is written is as large as what it says."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(raw: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed distances."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unsteps(raw: bytes, dtype: type = np.uint64) -> np.ndarray:
    return np.cumsum(unpack(raw, dtype), dtype=dtype)


def row_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 2_000_000) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of at most ``max_bytes`` bytes (or one text) each, so that work arrays stay small.

    What a task's batches took goes back to the system at its end: workers outlive tasks.
    """
    for batch in batches:
        _, offsets = string_bytes(batch.column(1))
        for i, j in text_blocks(offsets, max_bytes):
            yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)
    pa.default_memory_pool().release_unused()


def arrow_of(schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema; call it on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def batch_of(arrow: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)


def lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """An array of lists from their sizes and all values end to end."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values))


def map_rows(df: DataFrame, fn: Callable[[pa.Array, pa.Array], list], schema: str, max_bytes: int = 2_000_000) -> DataFrame:
    """``fn(ids, texts) -> columns`` over row batches of a two-column frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in row_batches(batches, max_bytes):
            yield batch_of(arrow, fn(ids, rows))

    arrow = arrow_of(schema)
    return df.mapInArrow(run, schema)
