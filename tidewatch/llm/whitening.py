"""Whitening of embeddings along the leading eigenvectors of their covariance, by block Jacobi-Davidson.

The covariance is never formed. All that is known of it are products with a few vectors at a time, each a
pass over the stored rows: every task adds up its centred rows times their projections,
and Spark sums a dimension's parts. On the driver live only arrays of dimensions by some
tens of columns, whatever the number of rows:

* a subspace, orthonormal and orthogonal to what is locked, with its product;
* Rayleigh-Ritz in it gives approximate pairs and their residuals;
* leading pairs whose residual is down to rounding are locked, and the rest looks away from them;
* for each other wanted pair, the correction equation, projected off the locked vectors
  and the pair's own, is solved roughly by some steps of MINRES (all pairs' steps share one pass),
  and the corrections widen the subspace; a subspace that is too wide starts again from its best pairs.

Entries become whole numbers first, so sums and deviations are exact.

Rows without a vector or with an entry that is null or not finite are left out, and so
are empty vectors and those of a length other than the most frequent one (the longer of equally
frequent ones). Entries beyond 2^52 in size count as that. Null ids are kept; repeated rows count each. A deviation beyond
a long is null. Directions without variance, among them all of a single row or of equal rows, have no
component, so there may be fewer than asked for. Equal eigenvalues leave their eigenvectors open; any orthonormal ones
are given. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.common import col, list_array, shared_folder

SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**52
COMPONENTS = 32
#: Vectors of a block; a block's bytes are bounded by the second number too.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 4_000_000
#: Steps of the inner solver, and of the outer one.
INNER_STEPS, OUTER_STEPS = 8, 300
#: A residual of so many roundings of the largest eigenvalue is double precision.
ROUNDINGS = 100
#: Widest subspace, in multiples of the wanted pairs.
WIDEST = 3
#: Eigenvalues below this share of the trace are no variance but rounding.
NO_VARIANCE = 1e-13

Product = Callable[[np.ndarray], np.ndarray]


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _valid(vectors: DataFrame, vector: str) -> DataFrame:
    entry_ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & entry_ok)


@dataclass
class Blocks:
    """Stored vectors of one dimension: ``vec_id`` (a list) and ``x`` (bytes of whole numbers, row by row)."""

    rows: DataFrame
    dimension: int
    n: int
    sums: list[int]

    def centred(self) -> Callable[[bytes], np.ndarray]:
        """From a block's bytes to its centred rows, without rounding but for the mean's fraction."""
        quotient, rest = zip(*(divmod(s, self.n) for s in self.sums))
        base, fraction, d = np.array(quotient, np.int64), np.array([r / self.n for r in rest]), self.dimension
        return lambda raw: (np.frombuffer(raw, np.int64).reshape(-1, d) - base) - fraction

    def summed(self, make: Callable[[np.ndarray], np.ndarray], width: int, height: int | None = None) -> np.ndarray:
        """The sum over all blocks of ``make(centred rows)``, an array of ``height`` (the dimension) by ``width``."""
        centred, height = self.centred(), self.dimension if height is None else height

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for raw in batch.column("x"):
                    made = make(centred(raw.as_buffer()))
                    total = made if total is None else total + made
            if total is not None:
                flat = list_array([row.tobytes() for row in np.ascontiguousarray(total)], np.float64, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), flat], names=["at", "part"])

        parts = self.rows.select("x").mapInArrow(run, "at int, part array<double>")
        sums = parts.groupBy("at").agg(F.array(*[F.sum(F.col("part")[j]) for j in range(width)]).alias("total"))
        out = np.zeros((height, width))
        for row in sums.collect():  # as many rows as dimensions
            out[row["at"]] = row["total"]
        return out

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times some columns: one pass over the vectors."""
        made = self.summed(lambda z: z.T @ (z @ columns), columns.shape[1])
        return made / self.n


def blocks(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", folder: str | None = None) -> Blocks | None:
    """The vectors as whole numbers, stored in blocks; None if there are none.

    Blocks are written to ``folder``, a new one below the checkpoint folder by default.
    """
    spark = vectors.sparkSession
    read = vectors.select(col(vec_id).alias("vec_id"), col(vector).cast("array<double>").alias("x"))
    good = _valid(read, "x")
    lengths = good.groupBy(F.size("x").alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return None
    d, id_type = most["size"], to_arrow_type(read.schema["vec_id"].dataType)
    rows_a_block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * d)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows_a_block):
                part = batch.slice(begin, rows_a_block)
                x = whole_numbers(part.column("x").flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
                # halves of the numbers, so that sums of any number of rows stay exact
                high = x >> 32
                sums = [list_array([np.ascontiguousarray(s.sum(axis=0)).tobytes()], np.int64, pa.int64()) for s in (high, x - (high << 32))]
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column("vec_id").cast(id_type))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary()), pa.array([len(x)], pa.int64()), *sums], names=["vec_id", "x", "n", "high", "low"])

    schema = T.StructType([
        T.StructField("vec_id", T.ArrayType(read.schema["vec_id"].dataType)), T.StructField("x", T.BinaryType()), T.StructField("n", T.LongType()),
        T.StructField("high", T.ArrayType(T.LongType())), T.StructField("low", T.ArrayType(T.LongType())),
    ])
    folder = folder or shared_folder(spark, "vector-blocks")
    good.where(F.size("x") == d).mapInArrow(pack, schema).write.parquet(folder)
    stored = spark.read.parquet(folder)
    halves = stored.select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "half")).groupBy("at").agg(
        F.sum(F.col("half.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("half.low").cast("decimal(38,0)")).alias("low")
    )
    sums = [0] * d
    for row in halves.collect():  # as many rows as dimensions
        sums[row["at"]] = (int(row["high"]) << 32) + int(row["low"])
    return Blocks(stored.select("vec_id", "x"), d, stored.agg(F.sum("n")).first()[0], sums)


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``new`` has beyond the others; columns that add only rounding go."""
    for _ in range(3):
        for other in against:
            new = new - other @ (other.T @ new)
        length = np.linalg.norm(new, axis=0)
        new = new[:, length > 0] / length[length > 0]
        left, size, _ = np.linalg.svd(new, full_matrices=False) if new.size else (new, np.zeros(0), None)
        new = left[:, size > 1e-10]
    return new


def minres(product: Product, off: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Some steps of MINRES for (A - shift) t = right, column by column, projected by ``off``; a step is one product.

    Starts from zero; a column that cannot go on keeps its answer.
    """
    beta = np.linalg.norm(right, axis=0)
    tiny = np.finfo(float).tiny
    live = beta > tiny
    v, before = right / np.where(live, beta, 1.0), np.zeros_like(right)
    answer, way, way_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    c, s, c_before, s_before = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    rest, beta_now = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        w = off(product(v) - v * shifts)
        alpha = (v * w).sum(axis=0)
        w = off(w - alpha * v - beta_now * before)
        beta_next = np.linalg.norm(w, axis=0)
        # two earlier rotations, then the one that takes the new entry out
        epsilon, delta = s_before * beta_now, c_before * beta_now
        gamma, delta = c * alpha - s * delta, s * alpha + c * delta
        size = np.hypot(gamma, beta_next)
        ok = live & (size > tiny)
        size = np.where(ok, size, 1.0)
        c_before, s_before, c, s = c, s, np.where(ok, gamma / size, 1.0), np.where(ok, beta_next / size, 0.0)
        step = np.where(ok, (v - epsilon * way_before - delta * way) / size, 0.0)
        answer, rest = answer + step * (c * rest), np.where(ok, -s * rest, rest)
        way_before, way = way, step
        live = ok & (beta_next > 1e-14 * beta)
        before, v, beta_now = v, np.where(live, w / np.where(live, beta_next, 1.0), 0.0), beta_next
    return answer


def eigenpairs(
    product: Product, dimension: int, wanted: int, seed: int = 0, inner: int = INNER_STEPS, roundings: float = ROUNDINGS,
) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues, falling, and unit eigenvectors of a symmetric positive matrix known by its products."""
    wanted = min(wanted, dimension)
    locked, values = np.zeros((dimension, 0)), []
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dimension, min(dimension, wanted + 4))))
    image = product(basis)
    for _ in range(OUTER_STEPS):
        # Rayleigh-Ritz
        inside = basis.T @ image
        theta, turn = np.linalg.eigh((inside + inside.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        left = wanted - len(values)
        residual = image - basis * theta
        # what the locked vectors' rounding brings in is none of this pair's error
        residual -= locked @ (locked.T @ residual)
        small = np.linalg.norm(residual, axis=0) <= roundings * np.finfo(float).eps * max([*values, theta[0], np.finfo(float).tiny])
        done = int(np.argmin(np.append(small[:left], False)))
        if done:
            locked = np.concatenate([locked, basis[:, :done]], axis=1)
            values += theta[:done].tolist()
            basis, image, theta, residual, left = basis[:, done:], image[:, done:], theta[done:], residual[:, done:], left - done
        if not left:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        open_ = np.arange(min(left, basis.shape[1]))
        if basis.shape[1] > max(WIDEST * wanted, left + 2):
            best = min(basis.shape[1], left + wanted // 2 + 1)
            basis, image = basis[:, :best], image[:, :best]
        pairs = basis[:, open_]

        def off(t: np.ndarray, pairs=pairs, locked=locked) -> np.ndarray:
            t = t - locked @ (locked.T @ t)
            return t - pairs * (pairs * t).sum(axis=0)

        corrections = minres(product, off, theta[open_], off(-residual[:, open_]), inner)
        more = _orthonormal(off(corrections), locked, basis)
        if not more.shape[1]:  # nothing new in the corrections: any direction that is missing
            more = _orthonormal(np.random.default_rng(seed + len(values) + 1).standard_normal((dimension, left)), locked, basis)
        if more.shape[1]:
            basis, image = np.concatenate([basis, more], axis=1), np.concatenate([image, product(more)], axis=1)
        else:  # the subspace is whole; products are renewed, as rounding alone is left
            image = product(basis)
    raise ArithmeticError(f"{wanted - len(values)} of {wanted} residuals are above rounding after {OUTER_STEPS} steps")


@dataclass
class Whitening:
    """What whitens: eigenvalues and eigenvectors of components with variance, and the covariance's trace."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.vectors / np.sqrt(self.values))


def fit(vectors: Blocks, components: int = COMPONENTS) -> Whitening:
    """The leading components of the vectors' covariance."""
    trace = float(vectors.summed(lambda z: np.array([[(z * z).sum()]]), 1, 1)[0, 0]) / vectors.n
    if not trace > 0:
        return Whitening(np.zeros(0), np.zeros((vectors.dimension, 0)), trace)
    values, found = eigenpairs(vectors.product, vectors.dimension, components)
    some = values > NO_VARIANCE * trace
    return Whitening(values[some], found[:, some], trace)


def identity_error(vectors: Blocks, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(model.values)
    mean = vectors.summed(lambda z: model.apply(z).sum(axis=0, keepdims=True), k, 1) / vectors.n

    def products(z: np.ndarray) -> np.ndarray:
        w = model.apply(z) - mean
        return w.T @ w

    return float(np.abs(vectors.summed(products, k, k) / vectors.n - np.eye(k)).max())


def _deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    quotient, rest = zip(*(divmod(s, n) for s in sums))
    y = x - np.array(quotient, np.int64)
    largest = (int(np.abs(y).max(initial=0)) + 1) * n
    if largest * largest * x.shape[1] < 1 << 63:
        y = y * n - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    made = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in made]


def whiten(vectors: Blocks, model: Whitening) -> DataFrame:
    """``vec_id``, ``deviation`` and ``whitened`` (an array, a number for each component) of every vector."""
    centred, d, n, sums = vectors.centred(), vectors.dimension, vectors.n, vectors.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column("x")):
                raw = raw.as_buffer()
                made = model.apply(centred(raw))
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id")[i].values, pa.array(_deviations(np.frombuffer(raw, np.int64).reshape(-1, d), sums, n), pa.int64()),
                    list_array([row.tobytes() for row in np.ascontiguousarray(made)], np.float64, pa.float64()),
                ], names=["vec_id", "deviation", "whitened"])

    schema = T.StructType([
        T.StructField("vec_id", vectors.rows.schema["vec_id"].dataType.elementType), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    return vectors.rows.mapInArrow(run, schema)


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """A row for each vector and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    found = blocks(vectors, vec_id, vector)
    names = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    model = fit(found, components) if found else None
    if not found or not len(model.values):
        types = (vectors.schema[vec_id].dataType.simpleString(), "int", "long", "long", "double", "double", "double")
        return vectors.sparkSession.createDataFrame([], ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    shares = F.array(*[F.lit(float(v)) for v in model.values / model.trace])
    rows = whiten(found, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(identity_error(found, model)).alias("identity_error"),
    )
