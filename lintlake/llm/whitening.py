"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become integers x = floor(1024 c) + 100000, so counts and sums are exact. A block of directions on the driver (width of a
vector by a few dozen columns) meets the centred vectors in passes X'(XQ) / n; the vectors stay where they are, and a pass
sends back one block. Between passes:

filter   a Chebyshev polynomial of the covariance, by its three-term recurrence, damps the spectrum below the block and lifts what
         lies above; its degree is held so low that no column drowns in the strongest direction.
ritz     QR of the block, the small projected problem, and the residual of each wanted pair.

This goes on until every wanted residual is below `tolerance` of the largest eigenvalue, or no pass can lower it any more and it is
below 1e-9; else it raises. A block as wide as a vector needs no filter.

Defined results: vectors that are null, or hold null or non-finite entries, take no part; neither do those of another width than
the most frequent one (ties: the narrower), empty ones, and those with an entry of 2^52 or more, whose x has no 64 bits. Rows that
repeat, or have no id, are vectors like any others. Components whose variance is below 1e-12 of the largest have no direction and are
left out, so equal vectors give no rows. An empty table gives an empty result. Only the id and the vector column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import cut

SCALE, SHIFT = 1024, 100_000
LEAST_VARIANCE = 1e-12


def _column(df: DataFrame, name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of packed 4- or 8-byte integers as one matrix of 64-bit integers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data, out = np.frombuffer(column.buffers()[2] or b"", np.uint8), np.empty((len(column), width), np.int64)
    for kind in ("<i4", "<i8"):
        size = width * np.dtype(kind).itemsize
        at = np.flatnonzero(np.diff(offsets) == size)
        if len(at):
            out[at] = data[offsets[at][:, None] + np.arange(size)].view(kind)
    return out


def pack(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the vectors that take part, x as packed integers, and their width."""
    v = _column(vectors, vector_col).cast("array<double>")
    rows = vectors.select(_column(vectors, id_col).alias("id"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**52)))
    most = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.col("count").desc(), "width").first()
    width = most["width"] if most else 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = np.floor(SCALE * c).astype(np.int64) + SHIFT
            narrow = (np.abs(x) < 1 << 31).all()
            rows_of = x.astype("<i4" if narrow else "<i8").view(f"V{width * (4 if narrow else 8)}").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in rows_of], pa.binary())], ["id", "x"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("x", T.BinaryType())])
    return cut(rows.where(F.size("v") == width).mapInArrow(packed, schema)), width


class Fit:
    """Number of vectors and their exact sums, split so that centring needs no large products."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2 for each row, exact."""
        y = x - self.whole
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if largest * largest * x.shape[1] < 1 << 63:
            return ((self.n * y - np.array(self.rest)) ** 2).sum(1).tolist()
        return [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in y.tolist()]


def moments(rows: DataFrame, width: int) -> Fit | None:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], ["at", "high", "low"])

    whole = "decimal(38,0)"
    sums = rows.select("x").mapInArrow(partial, "at long, high long, low long").groupBy("at").agg(F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low")).orderBy("at").collect()
    exact = [int(r["high"]) * (1 << 32) + int(r["low"]) for r in sums]
    return Fit(exact[-1], exact[:-1]) if exact and exact[-1] else None


def summed(rows: DataFrame, width: int, of, size: int) -> np.ndarray:
    """Sum over all rows of of(x), an array of `size` doubles for each batch: one array a task is shuffled by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(matrix(batch.column("x"), width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "value"])

    found = rows.select("x").mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["value"].to_numpy()
    return out


def covariance_times(rows: DataFrame, fit: Fit, q: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times q, and its trace, by one pass over the vectors."""
    width, columns = q.shape

    def of(x: np.ndarray) -> np.ndarray:
        c = fit.centred(x)
        return np.append((c.T @ (c @ q)).ravel(), (c * c).sum())

    out = summed(rows, width, of, width * columns + 1) / fit.n
    return out[:-1].reshape(width, columns), float(out[-1])


def degree(values: np.ndarray, k: int, centre: float, half: float, most: int, spread: float = 1e6) -> int:
    """The largest degree at which the strongest direction grows at most `spread` times as much as the last wanted one."""
    first, last = (np.arccosh(max((values[i] - centre) / half, 1.0)) for i in (0, k - 1))
    return max(1, min(most, int(np.log(spread) / max(first - last, 1e-9))))


def chebyshev(times, q: np.ndarray, vq: np.ndarray, low: float, high: float, m: int) -> np.ndarray:
    """The m-th Chebyshev polynomial of the covariance mapped from [low, high] to [-1, 1], applied to q; vq is its first product.

    Each step is scaled by its largest column, which changes no direction and keeps the numbers in range.
    """
    centre, half = (high + low) / 2, max((high - low) / 2, 1e-300)
    before, now = q, (vq - centre * q) / half
    for _ in range(m - 1):
        before, now = now, 2 * (times(now) - centre * now) / half - before
        size = np.abs(now).max()
        before, now = before / size, now / size
    return now


def eigenpairs(rows: DataFrame, fit: Fit, width: int, k: int, block: int | None = None, most_degree: int = 12, tolerance: float = 1e-13, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of the covariance, falling, their unit vectors as columns, and the trace."""
    k = min(k, width)
    block = min(width, block or 4 * k)
    trace = 0.0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal trace
        out, trace = covariance_times(rows, fit, q)
        return out

    q = np.linalg.qr(np.random.default_rng(7).normal(size=(width, block)))[0]
    low, best, stuck = np.inf, np.inf, 0
    for _ in range(rounds):
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        errors = np.sqrt(((vq - q * values) ** 2).sum(0))
        if values[0] <= 0:
            break
        wanted = values[:k] > LEAST_VARIANCE * values[0]
        worst = errors[:k][wanted].max() / values[0]
        stuck, best = (0, worst) if worst < best / 2 else (stuck + 1, best)
        if worst <= tolerance or (block == width and worst <= 1e-9) or (stuck >= 3 and worst <= 1e-9):
            return values[:k][wanted], q[:, :k][:, wanted], trace
        low = max(0.0, min(low, values[-1] - errors[-1]))
        high = max(values[-1], low + 1e-12 * values[0])
        m = degree(values, k, (high + low) / 2, (high - low) / 2, most_degree)
        q = np.linalg.qr(chebyshev(times, q, vq, low, high, m))[0]
    else:
        raise RuntimeError(f"no certified components after {rounds} rounds: residual {best:.1e} of the largest eigenvalue")
    return np.zeros(0), np.zeros((width, 0)), trace


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row for each vector that takes part and component.

    id has id_col's name and type. deviation is an exact decimal (null beyond 38 digits). identity_error is measured on the whitened values.
    """
    rows, width = pack(vectors, id_col, vector_col)
    fit = moments(rows, width) if width else None
    values, q, trace = eigenpairs(rows, fit, width, k) if fit else (np.zeros(0), np.zeros((0, 0)), 0.0)
    found = len(values)
    scaled, error = q / np.sqrt(values) if found else q, 0.0
    if found:

        def products(x: np.ndarray) -> np.ndarray:
            w = fit.centred(x) @ scaled
            return np.append((w.T @ w).ravel(), w.sum(0))

        out = summed(rows, width, products, found * found + found) / fit.n
        mean = out[found * found :]
        error = float(np.abs(out[: found * found].reshape(found, found) - np.outer(mean, mean) - np.eye(found)).max())
    n, share = fit.n if fit else 0, (values / trace if found else values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            exact = [Decimal(d) if d < 10**38 else None for d in fit.deviations(x)]
            each = np.repeat(np.arange(len(x)), found)
            columns = [
                batch.column("id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n)),
                pa.array(exact, pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array((fit.centred(x) @ scaled).ravel()),
                pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *T._parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").fields])
    names = schema.names
    return (rows if found else rows.limit(0)).mapInArrow(project, schema)
