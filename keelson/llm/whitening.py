"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A subspace a little wider than wanted is multiplied by it in
distributed passes, in which every task adds up X'(X Q) of its centred rows and returns a matrix
as wide as the subspace. A Chebyshev polynomial, by its three-term recurrence, damps the part of
the spectrum that is not wanted; QR and a Rayleigh-Ritz step follow. This is repeated until the
residuals certify the wanted pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from keelson.llm.common import prepare, stored

#: Entries are counted in steps of 1 / SCALE; beyond LARGEST steps they stay there.
SCALE = 64
LARGEST = float(1 << 53)
#: Bytes of rows that are multiplied at a time.
BLOCK_BYTES = 4 << 20
#: Matrices that may come to the driver from one pass; more are first added up by so many tasks.
FAN_IN = 32


@dataclass(frozen=True)
class Settings:
    """Components, width of the subspace, polynomial degree at most, Lanczos steps, turns at most, seed.

    A component is certified when its residual is below ``exact`` times the largest eigenvalue.
    """

    components: int = 16
    width: int = 32
    degree: int = 16
    steps: int = 8
    turns: int = 60
    exact: float = 2e-14
    seed: int = 5


@dataclass(frozen=True)
class Whitening:
    """A certified fit: rows of the fit list, sums per dimension, eigenvalues falling, eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def steps_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, ``x``): the usable vectors as whole steps, 64-bit little-endian.

    A vector is usable if neither it nor an entry is null and all entries are finite. Where the
    lengths differ, the most frequent one counts (of equally frequent ones the longest).
    """
    entries = F.col(vector_col).cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    usable = df.select(F.col(id_col), entries.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    lengths = usable.groupBy(F.size("v").alias("d")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype("<i8").tobytes()
            rows = [whole[k : k + 8 * d] for k in range(0, len(whole), 8 * d)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], [id_col, "x"])

    schema = StructType([df.schema[id_col], StructField("x", BinaryType())])
    return stored(usable.where(F.size("v") == d).mapInArrow(run, schema), "steps")


def _packed(steps: DataFrame) -> DataFrame:
    """(``d``, ``rows``): distinct vectors, many in one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(held[0]) // 8], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["d", "rows"])

        for batch in batches:
            for row in batch.column(0).to_pylist():
                held.append(row)
                size += len(row)
                if size >= BLOCK_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return stored(steps.select("x").distinct().mapInArrow(run, "d int, rows binary"), "distinct-steps")


def _sums(packed: DataFrame) -> tuple[int, list[int], int]:
    """Rows, sums per dimension and the sum of all squares, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, raw in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(raw, "<i8").reshape(-1, d)
                wide = int(np.abs(x).max()) ** 2 * x.size >= 1 << 62
                x = x.astype(object) if wide else x
                values = [len(x), int((x * x).sum()), *map(int, x.sum(axis=0))]
                numbers = pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), numbers], ["i", "v"])

    found = packed.mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()
    sums = [int(r["v"]) for r in sorted(found, key=lambda r: r["i"])]
    return (sums[0], sums[2:], sums[1]) if sums else (0, [], 0)


class Passes:
    """Products of the covariance with narrow matrices, one distributed pass each."""

    def __init__(self, packed: DataFrame, n: int, sums: list[int]) -> None:
        self.packed, self.n = packed, n
        self.mean = np.array([float(Fraction(s, n)) for s in sums])
        self.parts = packed.rdd.getNumPartitions()
        self.made = 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        mean, shape = self.mean, q.shape
        self.made += 1

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for raw in batch.column(1):
                    # centred before it is multiplied
                    x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, shape[0]) - mean
                    total += x.T @ (x @ q)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for raw in batch.column(0):
                    total += np.frombuffer(raw.as_buffer()).reshape(shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        found, parts = self.packed.mapInArrow(multiply, "m binary"), self.parts
        while parts > FAN_IN:
            parts = -(-parts // FAN_IN)
            found = found.repartition(parts).mapInArrow(add, "m binary")
        return sum(np.frombuffer(r[0]).reshape(shape) for r in found.collect()) / self.n


def _lowest(times: Passes, d: int, s: Settings) -> float:
    """A lower bound of the spectrum, from Lanczos steps: the smallest Ritz value less its residual."""
    rng = np.random.default_rng(s.seed + 1)
    basis = [rng.standard_normal(d)]
    basis[0] /= np.linalg.norm(basis[0])
    alpha, beta = [], []
    for _ in range(min(s.steps, d)):
        w = times(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        for _ in range(2):
            for v in basis:
                w = w - (v @ w) * v
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    return max(0.0, float(values[0] - beta[-1] * abs(vectors[-1, 0])))


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values falling, vectors, and the covariance times them."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], q @ turn[:, ::-1], vq @ turn[:, ::-1]


def fit(steps: DataFrame, settings: Settings = Settings()) -> Whitening | None:
    """Principal components of the distinct vectors of ``steps`` (``x``), or None where nothing varies.

    There are as many components as wanted or as dimensions with variance. The eigenvectors' signs
    make their largest entry positive. Only matrices as wide as the subspace and sums per dimension
    come to the driver. Repeated vectors count once; an empty table gives None.
    """
    s = settings
    packed = _packed(steps)
    n, sums, squares = _sums(packed)
    trace = Fraction(n * squares - sum(v * v for v in sums), n * n) if n else Fraction(0)
    if not trace:
        return None
    d, times = len(sums), Passes(packed, n, sums)
    wanted, width = min(s.components, d), min(max(s.width, s.components), d)
    q = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(s.seed).standard_normal((d, width)))[0]
    values, q, vq = _ritz(q, times(q))
    low = _lowest(times, d, s) if width < d else 0.0
    before = math.inf
    for turn in range(s.turns):
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / values[0])
        # below that rounding takes over: stop where a turn no longer helps
        if width == d or residual <= s.exact or (residual < 1e-11 and residual > before / 2):
            break
        before = residual
        high = max(values[-1], low + 1e-3 * (values[0] - low))
        centre, half = (high + low) / 2, (high - low) / 2
        first, last = (max((values[k] - centre) / half, 1 + 1e-9) for k in (0, wanted - 1))
        rise, spread = math.acosh(last), math.acosh(first) - math.acosh(last)
        # damp to a millionth, but keep the columns apart: the largest may not drown the last one
        degree = min(s.degree, math.ceil(14 / max(rise, 1e-3)), max(3, int(25 / max(spread, 1e-3))))
        older, newer = q, (vq - centre * q) / half
        for _ in range(degree - 1):
            older, newer = newer, 2 * (times(newer) - centre * newer) / half - older
            scale = np.abs(newer).max(axis=0)
            older, newer = older / scale, newer / scale
        q = np.linalg.qr(np.linalg.qr(newer)[0])[0]
        values, q, vq = _ritz(q, times(q))
    else:
        raise ArithmeticError(f"not certified after {s.turns} turns: residual {residual:.1e}")
    sized = values[:wanted] > 1e-12 * d * values[0]
    values, vectors = values[:wanted][sized], q[:, :wanted][:, sized]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    matrix = vectors / np.sqrt(values)
    error = float(np.abs(matrix.T @ times(matrix) - np.eye(len(values))).max())
    return Whitening(n, tuple(sums), values, vectors, float(trace), residual, error)


def transform(steps: DataFrame, model: Whitening, id_col: str) -> DataFrame:
    """(id, ``deviation``, ``whitened``) of each row; ``deviation`` is the exact sum of (n x - S)^2, an error beyond 64 bits."""
    mean, matrix, n, sums = model.mean, model.matrix, model.n, np.array(model.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, len(mean))
            most = n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
            narrow = most * most * len(mean) < 1 << 62
            apart = n * x - sums.astype(np.int64) if narrow else n * x.astype(object) - sums
            deviations = pa.array([int(v) for v in (apart * apart).sum(axis=1)], pa.int64())
            white = (x - mean) @ matrix
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], white.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviations, lists], [id_col, "deviation", "whitened"])

    schema = StructType([steps.schema[id_col], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    return steps.select(id_col, "x").mapInArrow(run, schema)


def whiten(df: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of ``df`` and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries become whole steps of 1/64; the fit takes each distinct vector once, ``n`` of them.
    Rows with a null vector, or with a null or non-finite entry, or of another than the most
    frequent length, give nothing. Repeated rows are returned each, a null id stays null. A table
    that is empty or without variance has no components and gives an empty result; other columns
    are not read.
    """
    prepare(df.sparkSession)
    steps = steps_of(df, id_col, vector_col)
    model = fit(steps, settings)
    if model is None:
        shares, rows, n, error = [], steps.limit(0).select(id_col, F.lit(0).cast("long").alias("deviation"), F.array(F.lit(0.0)).alias("whitened")), 0, 0.0
    else:
        shares, rows, n, error = (model.values / model.trace).tolist(), transform(steps, model, id_col), model.n, model.identity_error
    each = rows.select(id_col, "deviation", F.posexplode("whitened").alias("_at", "_value"))
    return each.select(
        id_col, (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("_value").alias("whitened"), F.element_at(F.array(*map(F.lit, shares or [0.0])), F.col("_at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
