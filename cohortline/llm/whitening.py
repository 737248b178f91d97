"""Principal components of embeddings by Golub-Kahan-Lanczos bidiagonalisation, and whitened coordinates.

X holds the centred vectors of the fit list, one a row. Each step multiplies X by a right vector v and the transpose of X by the left vector u
that comes of it, in one pass over the fit list; both new vectors are made orthogonal to all earlier ones of their side. Left vectors are as
long as the list, so they are never stored: each is X p for a vector p of as many numbers as a vector has dimensions, and a task makes the
entries of all left vectors for the rows that it holds. What a pass sends back are sums: a few numbers for each dimension and step, added up by
Spark. The driver keeps the right vectors, the p and the bidiagonal matrix, whose singular values and vectors give components and deviations.

The steps end when the components sought have settled to rounding. One chain of steps finds one vector of each eigenvalue, so a second one starts from
a vector orthogonal to the first and runs until it is clear that nothing as large is left. Where eigenvalues are close to each other, there are at most as
many steps as dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable

SCALE = 256
COMPONENTS = 4
#: Vectors in a block of the fit list.
BLOCK = 4096
#: What a singular vector's equation may be off by, as a share of the largest singular value.
SETTLED = 1e-14
#: Directions with a smaller share of the largest deviation have none.
ABSENT = 1e-11
#: Fewest steps of a chain that looks for what the earlier ones have missed.
PROBE = 8
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(df: DataFrame, vector: str, into: str) -> DataFrame:
    """The rows with a whole vector of finite numbers, as floor(256 c) in a column `into`; beyond the range of a long it is the range's end."""
    value = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = F.forall(value, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    floors = F.transform(value, lambda c: F.floor(c * F.lit(float(SCALE))))
    return df.where(F.col(vector).isNotNull() & whole & (F.size(vector) > 0)).withColumn(into, floors)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _blocks(fit: DataFrame, dims: int) -> DataFrame:
    """The vectors of `x` in binary blocks, in the smallest type that holds each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK), dims)
                low, high = int(x.min()), int(x.max())
                kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
                yield pa.record_batch([pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["kind", "data"])

    return durable(fit.mapInArrow(pack, "kind string, data binary"))


def _each(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(data.as_buffer(), dtype=kind).reshape(-1, dims)


def _sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for x in _each(batches, dims):
            n += len(x)
            # No sum of a block leaves a long unless its entries are wider than 32 bits.
            part = x.sum(axis=0, dtype="i8") if x.dtype.itemsize < 8 else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        values = pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))
        yield pa.record_batch([pa.array(range(dims + 1), pa.int32()), values], names=["at", "value"])

    rows = blocks.mapInArrow(add, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()
    found = {r["at"]: int(r["value"]) for r in rows}
    return found[0], [found[i + 1] for i in range(dims)]


def _totals(blocks: DataFrame, mean: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of what `work` makes of each centred block; a task sends one row for each number of it."""
    dims = len(mean)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _each(batches, dims):
            part = work(x - mean)
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype="i4")), pa.array(total)], names=["at", "value"])

    rows = blocks.mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(rows, key=lambda r: r["at"])])


def _columns(vectors: Sequence[np.ndarray], dims: int) -> np.ndarray:
    return np.array(vectors, dtype=float).reshape(len(vectors), dims).T


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def principal(blocks: DataFrame, mean: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right singular vectors as columns) of the centred fit list, `wanted` of them or as many as there are."""
    dims, rng = len(mean), np.random.default_rng(11)
    right: list[np.ndarray] = []
    makers: list[np.ndarray] = []  # p of each left vector
    back: list[np.ndarray] = []  # X^T u of each
    matrix = np.zeros((dims, dims))
    first, beta, largest = 0, 0.0, 0.0
    v = rng.standard_normal(dims)
    v /= np.linalg.norm(v)
    while True:
        k = len(right)
        right.append(v)
        known = _columns(makers, dims)
        p = v - beta * makers[-1] if k else v

        def products(x: np.ndarray, p: np.ndarray = p, known: np.ndarray = known) -> np.ndarray:
            u = x @ p
            return np.concatenate(([u @ u], (u @ x) @ known, u @ x))

        sums = _totals(blocks, mean, products)
        shared = sums[1 : k + 1]
        u_back = sums[k + 1 :] - _columns(back, dims) @ shared
        alpha = np.sqrt(max(sums[0] - shared @ shared, 0.0))
        largest = max(largest, alpha, beta)
        if alpha > ABSENT * largest:
            makers.append((p - known @ shared) / alpha)
            back.append(u_back / alpha)
        else:  # X v lies among the left vectors already there
            alpha = 0.0
            makers.append(np.zeros(dims))
            back.append(np.zeros(dims))
        matrix[k, k] = alpha
        m = k + 1
        basis = _columns(right, dims)
        rest = _orthogonal(back[-1] - alpha * v, basis)
        beta = float(np.linalg.norm(rest)) if alpha else 0.0
        left, values, turned = np.linalg.svd(matrix[:m, :m])
        if m == dims:
            break
        if beta > ABSENT * largest:
            off = beta * np.abs(left[m - 1])
        else:
            beta, off = 0.0, np.zeros(m)
        settled = m >= wanted and (off[:wanted] <= SETTLED * max(values[0], 1e-300)).all()
        if settled and first:
            own_left, own, _ = np.linalg.svd(matrix[first:m, first:m])
            slack = beta * abs(own_left[-1, 0])
            done = m - first >= PROBE and own[0] + slack <= values[wanted - 1]
            if done or (slack <= SETTLED * values[0] and own[0] < values[wanted - 1]):
                break
        if beta == 0.0 or (settled and not first):
            first, beta = m, 0.0
            rest = _orthogonal(rng.standard_normal(dims), basis)
            v = _orthogonal(rest / np.linalg.norm(rest), basis)
            v /= np.linalg.norm(v)
        else:
            matrix[k, m] = beta
            v = rest / beta
    present = int((values[:wanted] > 1e-10 * values[0]).sum()) if values[0] > 0 else 0
    vectors = _columns(right, dims) @ turned.T[:, :present]
    # Of both signs the one that makes the largest entry positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(present)]) if present else 1.0
    return values[:present], vectors * signs


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None] | np.ndarray:
    """Exact sums of (n x - S)^2; None where a long doesn't hold one."""
    dims = len(sums)
    reach = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if dims * reach * reach < 1 << 63:
        off = n * x - np.array(sums, dtype="i8")
        return np.einsum("ij,ij->i", off, off)
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, vector: str = "embedding", keep: Sequence[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """(`keep`..., component, n, deviation, whitened, explained, identity_error) of each row with a vector, for each component.

    Vectors that are missing, empty or hold a missing or non-finite entry are left out, and so are those without the commonest length (of several, the
    greatest). Entries become x = floor(256 c). The components are fitted to each distinct x once (`n` of them), so repeated rows count once but are
    all returned. Directions in which nothing varies are no components: with fewer than two different vectors there is none and no row. `deviation` is exact; it
    is missing where a long can't hold it. Columns that are not kept are ignored, whatever their names; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = integer_vectors(df.select(*keep, F.col(vector).alias("_vector")), "_vector", "_x").select(*keep, "_x")
    names = [f for f in rows.schema.fields if f.name != "_x"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in names], RESULT])
    usual = rows.groupBy(F.size("_x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if usual is None:
        return spark.createDataFrame([], schema)
    dims = usual["dims"]
    rows = rows.where(F.size("_x") == dims)
    blocks = _blocks(rows.select("_x").distinct(), dims)
    n, sums = _sums(blocks, dims)
    mean = np.array([float(s) / n for s in sums])
    values, vectors = principal(blocks, mean, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    variance = float(_totals(blocks, mean, lambda x: np.array([np.einsum("ij,ij->", x, x)]))[0])
    explained = values * values / variance
    turn = vectors / (values / np.sqrt(n))
    count = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        y = x @ turn
        return np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))

    found = _totals(blocks, mean, moments) / n
    centre, second = found[:count], found[count:].reshape(count, count)
    identity_error = float(np.abs(second - np.outer(centre, centre) - np.eye(count)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(batch.num_columns - 1), dims)
            each = pa.array(np.repeat(np.arange(len(x)), count))
            total = len(x) * count
            made = [
                pa.array(np.tile(np.arange(1, count + 1, dtype="i4"), len(x))),
                pa.array(np.full(total, n, dtype="i8")),
                pa.array(_deviations(x, n, sums), pa.int64()).take(each),
                pa.array(((x - mean) @ turn).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(total, identity_error)),
            ]
            kept = [batch.column(i).take(each) for i in range(batch.num_columns - 1)]
            shown = [part.split(" ")[0] for part in RESULT.split(", ")]
            yield pa.record_batch([*kept, *made], names=[*[f.name for f in names], *shown])

    return rows.mapInArrow(project, schema)
