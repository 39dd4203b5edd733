"""Whitening of embeddings by the leading components of their covariance.

Entries become integers, ``floor(scale * c) + shift``.  Three passes over the vectors: exact sums per dimension,
centred products, projection; a fourth measures the covariance of what came out.  Each task sends one matrix, whose
rows are summed in groups of at most ``FAN_IN``, level after level, so no group grows with the number of tasks.
Products are centred before multiplying: by the exact mean in the fit, by each block's own mean in the last pass, whose
blocks are then merged by their means.

The driver holds a matrix of the dimensions alone.  It is brought to tridiagonal form by Householder reflections; the
leading eigenvalues are found by bisection on Sturm counts, their vectors by inverse iteration, orthogonalised
against the earlier vectors of their cluster of close eigenvalues, and are turned back by the reflections.

Rows whose vector is null or empty or holds null or non-finite entries are left out, as are those of another
length than most have (of equally many the longer).  Entries beyond 2**52 in size are held at that.  Repeated
rows and ids count and are returned for each row; a null id stays null.  Components whose eigenvalue is nothing
but rounding (constant or dependent dimensions) have no whitened value: it is null, and they are left out of the error.
``deviation`` is null where it does not fit 64 bits; ``deviation_text`` always has it.  An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FAN_IN, BLOCK, LIMIT = 256, 4096, float(1 << 52)


# ---- eigenvectors of a symmetric matrix ----


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, Householder vectors): the matrix is H1 H2 .. T .. H2 H1 with H = I - 2 v v'."""
    a, n, turns = np.array(a, float), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        norm = math.sqrt(v @ v)
        v[0] += math.copysign(norm, v[0])
        size = math.sqrt(v @ v)
        v = v / size if size else v
        turns.append(v)
        if size:
            low = a[k + 1 :, k + 1 :]
            p = low @ v
            w = 2 * (p - (v @ p) * v)
            low -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] = a[k, k + 1 :] = 0
            a[k + 1, k] = a[k, k + 1] = -math.copysign(norm, v[0])
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are less than each x: negative pivots of its factorisation."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, q = np.zeros(len(x), np.int64), np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of the Gershgorin interval."""
    radius = np.r_[np.abs(e), 0] + np.r_[0, np.abs(e)]
    low, high = float((d - radius).min()), float((d + radius).max())
    pad = np.finfo(float).eps * max(abs(low), abs(high), 1e-300) * 4
    lows, highs = np.full(k, low - pad), np.full(k, high + pad)
    wanted = len(d) - 1 - np.arange(k)  # as many are less than it, at most
    while True:
        middle = (lows + highs) / 2
        if np.all((middle <= lows) | (middle >= highs)):
            return middle
        over = below(d, e, middle) > wanted
        highs, lows = np.where(over, middle, highs), np.where(over, lows, middle)


def solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; pivots that vanish are replaced by a rounding error."""
    n = len(d)
    small = np.finfo(float).eps * max(float(np.abs(d).max()), float(np.abs(e).max()) if len(e) else 0.0, 1e-300)
    main, up, far, b = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n, b.tolist()
    for i in range(n - 1):
        low = float(e[i])
        if abs(low) > abs(main[i]):
            main[i], up[i], far[i], main[i + 1], up[i + 1], low = low, main[i + 1], up[i + 1], up[i], 0.0, main[i]
            b[i], b[i + 1] = b[i + 1], b[i]
        if abs(main[i]) < small:
            main[i] = small
        f = low / main[i]
        main[i + 1] -= f * up[i]
        up[i + 1] -= f * far[i]
        b[i + 1] -= f * b[i]
    if abs(main[-1]) < small:
        main[-1] = small
    x = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - up[i] * x[i + 1] - far[i] * x[i + 2]) / main[i]
    return np.array(x[:n])


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """([k] largest eigenvalues falling, [k, dimensions] unit eigenvectors) of a symmetric matrix."""
    n = len(matrix)
    k = min(k, n)
    if not np.any(matrix):
        return np.zeros(k), np.eye(n)[:k]
    d, e, turns = tridiagonal(matrix)
    values = leading(d, e, k)
    size = max(float(np.abs(d).max()), float(np.abs(e).max()) if n > 1 else 0.0, 1e-300)
    draw = np.random.default_rng(0)
    found: list[np.ndarray] = []
    first = 0  # of the present cluster
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            first = j
        x = draw.standard_normal(n)
        for _ in range(6):
            # Equal eigenvalues are told apart by the orthogonalisation alone.
            x = solve(d, e, float(value), x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                for other in found[first:]:
                    x -= (x @ other) * other
            norm = math.sqrt(x @ x)
            x = x / norm if norm else draw.standard_normal(n)
        found.append(x)
    out = np.array(found)
    for v in reversed(turns):
        out[:, n - len(v) :] -= 2 * np.outer(out[:, n - len(v) :] @ v, v)
    # One step of refinement: what the vectors say of the matrix itself.
    out /= np.sqrt((out * out).sum(axis=1))[:, None]
    return np.einsum("ki,ij,kj->k", out, matrix, out), out


# ---- distributed sums ----


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _integers(column: pa.Array, dims: int, scale: float, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * _matrix(column, dims)), -LIMIT, LIMIT).astype(np.int64) + shift


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            yield batch.slice(k, BLOCK)


def usable(vector: str) -> Column:
    """Whether a vector has entries, none of them null or non-finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def exact_sums(rows: DataFrame, vector: str, scale: float, shift: int) -> tuple[int, int, list[int]]:
    """(dimensions, number of vectors, exact sum of each dimension) of the length that most usable vectors have."""
    schema = "dims int, n long, sums array<decimal(38,0)>"
    arrow = common.arrow_of(schema)

    def run(batches):
        import decimal

        exact = decimal.Context(prec=60)
        totals: dict[int, list] = {}
        for batch in _blocks(batches):
            lengths = batch.column(0).value_lengths().to_numpy()
            for dims in np.unique(lengths).tolist():
                some = _integers(batch.column(0).filter(pa.array(lengths == dims)), dims, scale, shift)
                n, sums = totals.get(dims, (0, [0] * dims))
                # Halves, so that a block's sum cannot overflow.
                high, low = some >> 20, some & ((1 << 20) - 1)
                totals[dims] = (n + len(some), [s + (int(h) << 20) + int(v) for s, h, v in zip(sums, high.sum(axis=0), low.sum(axis=0))])
        out = [(dims, n, [exact.create_decimal(s) for s in sums]) for dims, (n, sums) in totals.items()]
        yield common.batch_of(arrow, list(zip(*out)) if out else [[], [], []])

    sent = rows.select(vector).mapInArrow(run, schema)
    each = sent.select("dims", "n", F.posexplode("sums").alias("at", "s")).groupBy("dims", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    lengths = sent.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1)
    found = each.drop("n").join(lengths, "dims").orderBy("at").collect()
    return (found[0].dims, found[0].n, [int(r.s) for r in found]) if found else (0, 0, [])


def _summed(sent: DataFrame, merge) -> list:
    """The rows (at, part, value) of each ``at``, merged in groups of ``FAN_IN`` in the order of their parts."""
    schema = sent.schema
    arrow = common.arrow_of(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))

    def some(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([{"at": rows[0]["at"], "part": rows[0]["part"] // FAN_IN, **merge(rows)}], schema=arrow)

    table = common.written(sent, "whitening")
    parts = (table.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        following = common.written(table.groupBy("at", F.floor(F.col("part") / FAN_IN)).applyInArrow(some, schema), "whitening")
        common.drop(table)
        table, parts = following, -(-parts // FAN_IN)
        if parts == 1:
            out = table.orderBy("at").collect()
            common.drop(table)
            return out


def covariance(rows: DataFrame, vector: str, n: int, sums: list[int], scale: float, shift: int) -> np.ndarray:
    """Of the integer vectors, divisor n, centred by their exact mean before multiplying."""
    schema = "at int, part int, row array<double>"
    arrow = common.arrow_of(schema)
    whole, rest = np.array([s // n for s in sums]), np.array([s % n / n for s in sums])
    dims = len(sums)

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((dims, dims))
        for batch in _blocks(batches):
            y = (_integers(batch.column(0), dims, scale, shift) - whole) - rest
            total += y.T @ y
        yield common.batch_of(arrow, [np.arange(dims), [TaskContext.get().partitionId()] * dims, list(total)])

    found = _summed(rows.select(vector).mapInArrow(run, schema), lambda rows: {"row": np.sum([r["row"] for r in rows], axis=0).tolist()})
    matrix = np.array([r["row"] for r in found]) / n
    return (matrix + matrix.T) / 2


def merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(number, mean, centred products) of all rows of several blocks."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / max(1, n)
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def identity_error(rows: DataFrame, vector: str, whitened, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened(column)``, [rows, k], minus the identity."""
    schema = "at int, part int, n long, mean array<double>, products array<double>"
    arrow = common.arrow_of(schema)

    def run(batches):
        from pyspark import TaskContext

        state = (0, np.zeros(k), np.zeros((k, k)))
        for batch in _blocks(batches):
            z = whitened(batch.column(0))
            mean = z.mean(axis=0)
            state = merged([state, (len(z), mean, (z - mean).T @ (z - mean))])
        yield common.batch_of(arrow, [[0], [TaskContext.get().partitionId()], [state[0]], [state[1].tolist()], [state[2].ravel().tolist()]])

    def merge(rows):
        n, mean, products = merged([(r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)) for r in rows])
        return {"n": n, "mean": mean.tolist(), "products": products.ravel().tolist()}

    r = _summed(rows.select(vector).mapInArrow(run, schema), merge)[0]
    return float(np.abs(np.array(r["products"]).reshape(k, k) / r["n"] - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row, the exact sum of (n x - S)**2."""
    size = max(int(np.abs(x).max(initial=0)), 1)
    reach = n * size + max(abs(s) for s in sums)
    if reach * reach * len(sums) < 1 << 63:
        d = n * x - np.array(sums)
        return (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [int(v) for v in (d * d).sum(axis=1)]


def whiten(df: DataFrame, k: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_text; one row a vector and component."""
    spark = df.sparkSession
    rows = df.where(usable(vector_col)).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    out = f"vec_id {common.id_type(df, id_col)}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
    dims, n, sums = exact_sums(rows, "v", scale, shift)
    if not n:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == dims)
    matrix = covariance(rows, "v", n, sums, scale, shift)
    values, vectors = components(matrix, k)
    k = len(values)
    trace = float(np.trace(matrix))
    real = values > dims * np.finfo(float).eps * max(trace, 1e-300)
    whole, rest = np.array([s // n for s in sums]), np.array([s % n / n for s in sums])
    onto = np.where(real[:, None], vectors / np.sqrt(np.where(real, values, 1.0))[:, None], 0.0).T
    m = int(real.sum())
    explained = [v / trace if trace > 0 else 0.0 for v in np.maximum(values, 0.0).tolist()]
    arrow = common.arrow_of(out)

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - rest) @ onto

    error = identity_error(rows, "v", lambda column: projected(_integers(column, dims, scale, shift))[:, :m], m) if m else 0.0

    def run(batches):
        for batch in _blocks(batches):
            x = _integers(batch.column(1), dims, scale, shift)
            z, apart = projected(x), deviations(x, n, sums)
            rows = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            flat = pa.array(z.ravel(), pa.float64(), mask=np.tile(~real, rows))
            exact = [v for v in apart for _ in range(k)]
            yield common.batch_of(arrow, [ids, np.tile(np.arange(1, k + 1), rows), [n] * len(exact), [v if v < 1 << 63 else None for v in exact], flat, explained * rows, [error] * len(exact), [str(v) for v in exact]])

    return rows.mapInArrow(run, out)
