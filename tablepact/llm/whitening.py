"""Whitening of embeddings by spectral divide and conquer with QDWH polar decompositions.

Entries become whole numbers, so sums, products and deviations are exact and do not depend on how
the table is partitioned. The covariance is taken over the distinct vectors: each vector minus the whole number next
to the mean is multiplied exactly, and what the mean is off by is subtracted from the sum as a fraction.
Only dimension-by-dimension numbers reach the driver, whatever the number of rows.

There, the polar factor U of the covariance minus a shift is the sign of that matrix, (U + 1) / 2 projects
on the eigenvectors above the shift, and an orthonormal basis of its range and of the rest splits the covariance into
two blocks. QDWH finds U by a few dynamically weighted Halley steps, each one QR decomposition. Blocks are split on,
the upper ones first, until enough of them are single components. The components are then broadcast
(components x dimensions numbers) and rows are projected where they lie.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped (so are entries of 2**46
and more, which have no 64ths); rows with another number of dimensions than most have (on a tie the smaller number) are dropped as well;
repeated rows each get their rows; null ids stay null; directions without any spread are no components, so a table whose vectors are
all equal, and an empty one, give an empty result; other columns are ignored. Deviations that do not fit a long stop the
job with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import small_batches, stored

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
EPS = float(np.finfo(np.float64).eps)
ROWS = 1 << 12


# ---- spectral divide and conquer

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps."""
    size = np.linalg.norm(a)
    if size == 0:
        return np.eye(len(a))
    x, one = a / size, np.eye(len(a))
    # a lower bound of the least singular value: of a triangular factor, by the norm of its inverse
    r = np.linalg.qr(x, mode="r")
    low = EPS
    if np.abs(np.diag(r)).min() > EPS:
        low = max(EPS, 0.9 / np.linalg.norm(np.linalg.solve(r, one)))
    for _ in range(30):
        square = low * low
        gamma = (4 * (1 - square) / (square * square)) ** (1 / 3)
        root = np.sqrt(1 + gamma)
        p = root + 0.5 * np.sqrt(8 - 4 * gamma + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        s = p + q - 1
        basis, _ = np.linalg.qr(np.vstack([np.sqrt(s) * x, one]))
        upper, lower = basis[:len(a)], basis[len(a):]
        step = (q / s) * x + (p - q / s) / np.sqrt(s) * (upper @ lower.T)
        step = (step + step.T) / 2
        low = min(1.0, low * (p + q * square) / (1 + s * square))
        moved = np.linalg.norm(step - x)
        x = step
        if moved <= EPS ** (1 / 3) * np.linalg.norm(x) * 0.1 and 1 - low <= 10 * EPS:
            break
    return x


def halves(a: np.ndarray, floor: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces of a symmetric matrix, all eigenvalues of the first being larger.

    None where no shift separates them: all eigenvalues are equal as far as doubles tell.
    """
    n = len(a)
    mean, diagonal = np.trace(a) / n, np.diag(a)
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= floor:
        return None
    best = None
    for shift in (float(np.median(diagonal)), mean, mean + 0.37 * spread, mean - 0.37 * spread, mean + 0.11 * spread, mean - 0.11 * spread):
        u = polar_factor(a - shift * np.eye(n))
        projector = (u + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        for _ in range(3):  # a random range is an unlucky one with a probability of next to nothing
            q, _ = np.linalg.qr(projector @ rng.standard_normal((n, k)))
            full, _ = np.linalg.qr(projector @ q, mode="complete")
            rest = np.linalg.norm(full[:, k:].T @ a @ full[:, :k])
            if best is None or rest < best[0]:
                best = rest, full[:, :k], full[:, k:]
        if best[0] <= 10 * floor:
            break
    return None if best is None else best[1:]


def leading_components(v: np.ndarray, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance and their unit eigenvectors (columns), falling; at most ``wanted``."""
    rng = np.random.default_rng(seed)
    floor = EPS * max(np.linalg.norm(v), 1e-300)
    done: list[np.ndarray] = []
    waiting = [np.eye(len(v))]  # the uppermost block last
    while waiting and sum(q.shape[1] for q in done) < wanted:
        q = waiting.pop()
        block = q.T @ v @ q
        split = halves((block + block.T) / 2, floor, rng) if q.shape[1] > 1 else None
        if split is None:
            done.append(q)
        else:
            waiting += [q @ split[1], q @ split[0]]
    q = np.hstack(done) if done else np.zeros((len(v), 0))
    q, _ = np.linalg.qr(q)
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    values, q = values[order][:wanted], q[:, order][:, :wanted]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0) if q.size else q
    real = values > len(v) * EPS * np.trace(v)
    return values[real], q[:, real]


# ---- the table

def whole_numbers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x (long per entry) of the rows that can be used."""
    entry = lambda c: c.cast("double")
    usable = lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float(1 << 46))
    vector = F.col(f"`{vec_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", usable))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(entry(c) * SCALE) + OFFSET).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.filter(F.size("x") == (sizes[0]["d"] if sizes else -1))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(parts: DataFrame) -> list[int]:
    """Sums of the lists of whole numbers (as text) at each position, exact."""
    entry = parts.select(F.posexplode("part").alias("at", "k")).groupBy("at").agg(F.sum(F.col("k").cast("decimal(38,0)")).alias("k"))
    return [int(r["k"]) for r in entry.orderBy("at").collect()]


def _added(df: DataFrame, measure) -> list[int]:
    """Exact sums over all rows of what ``measure`` gives for a matrix of x; tasks send one list each."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in small_batches(batches, "x", 1 << 22, ROWS):
            part = measure(_matrix(batch.column("x")))
            sums = part if sums is None else [a + b for a, b in zip(sums, part)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[str(int(k)) for k in sums]], pa.list_(pa.string()))], names=["part"])

    return _summed(df.select("x").mapInArrow(total, "part array<string>"))


def _exact_products(y: np.ndarray) -> list[int]:
    """The upper triangle of y.T @ y, exact."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 1 << 53:
        full = y.astype(np.float64).T @ y.astype(np.float64)  # whole numbers below 2**53: no rounding
    else:
        full = y.astype(object).T @ y.astype(object)
    return [int(k) for k in full[np.triu_indices(y.shape[1])]]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening; all of it together is a few times dimensions x components numbers."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def middle(self) -> np.ndarray:
        return np.array([round(Fraction(s, self.n)) for s in self.sums], dtype=np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows: differences to the middle are exact, only their fraction of the mean is rounded."""
        off = np.array([float(Fraction(s, self.n) - int(m)) for s, m in zip(self.sums, self.middle)])
        return ((x - self.middle) - off) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n * x - sum) ** 2, exact."""
        middle, rest = self.middle, [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]
        y = x - middle
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * len(rest) < 1 << 63:
            apart = y * self.n - np.array(rest, dtype=np.int64)
            return (apart * apart).sum(axis=1)
        exact = [sum((int(k) * self.n - r) ** 2 for k, r in zip(row, rest)) for row in y.tolist()]
        if max(exact) >= 1 << 63:
            raise OverflowError("a deviation does not fit a long")
        return np.array(exact, dtype=np.int64)


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors x of ``rows``; None where there is none."""
    distinct = stored(rows.groupBy("x").count().select("x"), "whitening-fit")
    totals = _added(distinct, lambda x: [len(x), *x.sum(axis=0, dtype=object)])
    if not totals or len(totals) < 2:
        return None
    n, sums = totals[0], totals[1:]
    middle = np.array([round(Fraction(s, n)) for s in sums], dtype=np.int64)
    products = _added(distinct, lambda x: _exact_products(x - middle))
    rest, d = [s - n * int(m) for s, m in zip(sums, middle)], len(sums)
    v = np.zeros((d, d))
    for i, j, k in zip(*np.triu_indices(d), products):
        v[i, j] = v[j, i] = float(Fraction(n * k - rest[i] * rest[j], n * n))
    values, vectors = leading_components(v, components)
    made = Whitening(n, tuple(sums), values, vectors, float(np.trace(v)))
    if not len(values):
        return made

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, seen = np.zeros(len(values)), np.zeros((len(values), len(values))), 0
        for batch in small_batches(batches, "x", 1 << 22, ROWS):
            w = made.project(_matrix(batch.column("x")))
            first, second, seen = first + w.sum(axis=0), second + w.T @ w, seen + len(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()])], pa.list_(pa.float64()))], names=["part"])

    parts = distinct.mapInArrow(spread, "part array<double>").select(F.posexplode("part").alias("at", "k"))
    measured = np.array([r["k"] for r in parts.groupBy("at").agg(F.sum("k").alias("k")).orderBy("at").collect()]) / n
    mean, square = measured[:len(values)], measured[len(values):].reshape(len(values), -1)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(len(values))).max())
    return Whitening(n, tuple(sums), values, vectors, made.trace, error)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    rows = whole_numbers(df, id_col, vec_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    made = fitted(rows, components)
    if made is None or not len(made.values):
        return rows.sparkSession.createDataFrame([], schema)
    k, shared = len(made.values), rows.sparkSession.sparkContext.broadcast(made)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small_batches(batches, "x", 1 << 20, ROWS):
            x = _matrix(batch.column("x"))
            m, again = len(x), np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, own.n, dtype=np.int64)), pa.array(own.deviations(x)[again]), pa.array(own.project(x).ravel()),
                 pa.array(np.tile(own.values / own.trace, m)), pa.array(np.full(m * k, own.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(project, schema)
