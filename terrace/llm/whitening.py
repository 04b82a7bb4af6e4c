"""Embedding whitening by incremental eigendecomposition.

Every partition of the fit list holds the spectrum (count, mean, eigenvalues, eigenvectors) of the vectors it has seen.
A new vector is a centred rank-one update of it: the new eigenvalues are the roots of the secular equation, one between
each two old ones, after deflation of what the update doesn't touch. Spectra of partitions are combined in the same
way, one update for each eigenpair of the other spectrum and one for the difference of the means, in a tree of groups
of sixteen. The basis found so goes over the fit list once more: a Rayleigh-Ritz step projects the covariance on it,
summed by partitions, and turns the basis into eigenvectors to double precision. What reaches the driver is as large as
one spectrum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import prepare, settle

COMPONENTS = 16
#: Fixed by the task: an entry c becomes floor(SCALE * c) + ORIGIN.
SCALE, ORIGIN = 64, 1_000_000
#: Entries beyond this count as this, so that sums of integers hold.
MOST_ENTRY = 2.0**40
#: Vectors of the fit list that one task takes, at most and (where there are more cores) at least; spectra that one
#: task combines.
MOST_ROWS, LEAST_ROWS, FAN = 65_536, 1_024, 16
_EPS = float(np.finfo(float).eps)
#: Halvings that place a root; the first ones halve its exponent.
HALVINGS = 64


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """``gaps[i, j]`` = root i minus ``d[j]`` for the roots of 1 + rho * sum(z2 / (d - x)) = 0, with ``d`` rising, ``z2``
    and ``rho`` above 0. Root i lies between ``d[i]`` and the next one, and is held as a distance from the nearer of
    both, so gaps keep their relative accuracy."""
    m = len(d)
    width = np.append(np.diff(d), rho * z2.sum())
    to_low = d[None, :] - d[:, None]
    value = 1 + rho * (z2 / (to_low - width[:, None] / 2)).sum(1)
    high = (value < 0) & (np.arange(m) < m - 1)  # the root is nearer to the upper end
    base, sign = np.where(high, np.roll(d, -1), d), np.where(high, -1.0, 1.0)
    delta = d[None, :] - base[:, None]
    # Distances from the base; the function rises with x, so it falls with the distance from an upper end.
    far = np.where(np.arange(m) == m - 1, width, width / 2)
    near = far * 2.0**-200
    for _ in range(HALVINGS):
        t = np.where(far > 4 * near, np.sqrt(near) * np.sqrt(far), (near + far) / 2)
        beyond = (1 + rho * (z2 / (delta - (sign * t)[:, None])).sum(1)) * sign < 0
        near, far = np.where(beyond, t, near), np.where(beyond, far, t)
    return (sign * (near + far) / 2)[:, None] - delta


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (values rising, vectors as columns) of ``vectors diag(values) vectors' + rho v v'``, rho at least 0."""
    z = vectors.T @ v
    size = float(z @ z)
    if rho * size <= 0:
        return values, vectors
    tol = 8 * _EPS * max(float(values[-1]), rho * size)
    # Equal eigenvalues: a reflection inside their space leaves one vector that the update touches.
    edges = np.flatnonzero(np.diff(values) > tol) + 1
    if len(edges) + 1 < len(values):
        vectors = vectors.copy()
        for a, b in zip(np.append(0, edges), np.append(edges, len(values)), strict=True):
            if b - a > 1 and np.any(z[a : b - 1]):
                w, length = z[a:b].copy(), float(np.linalg.norm(z[a:b]))
                w[-1] += np.copysign(length, w[-1])
                w /= np.linalg.norm(w)
                vectors[:, a:b] -= 2 * np.outer(vectors[:, a:b] @ w, w)
                z[a:b] -= 2 * w * (w @ z[a:b])
                z[a : b - 1] = 0
    live = np.flatnonzero(rho * np.abs(z) * np.sqrt(size) > tol)
    if not len(live):
        return values, vectors
    d, zl = values[live], z[live]
    gaps = secular_roots(d, zl * zl, rho)
    # The update whose roots these are exactly: its eigenvectors are orthogonal whatever the roots' error.
    between = np.abs(d[None, :] - d[:, None])
    np.fill_diagonal(between, 1.0)
    zhat = np.copysign(np.exp(0.5 * (np.log(np.abs(gaps)).sum(0) - np.log(between).sum(0))), zl)
    turn = -(zhat[None, :] / gaps).T
    turn /= np.linalg.norm(turn, axis=0)
    values, vectors = values.copy(), vectors.copy()
    values[live] = d + np.diagonal(gaps)
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the centred scatter matrix of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + off / self.n

    def join(self, other: Spectrum) -> None:
        """Take in another spectrum by successive rank-one updates."""
        if not self.n or not other.n:
            if other.n:
                self.__dict__.update(other.__dict__)
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, max(float(value), 0.0))
        n, off = self.n + other.n, other.mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, off, self.n * other.n / n)
        self.mean, self.n = self.mean + off * (other.n / n), n


_STATE = "part bigint, n bigint, sums array<bigint>, mean array<double>, values array<double>, vectors array<double>"
_SUMS = "part bigint, values array<double>"


def _arrays(b: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _per_part(fit: DataFrame, row: Callable[[Iterator[np.ndarray]], dict], dim: int, schema: str) -> DataFrame:
    """One row for each partition of the fit list, from its blocks of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        made = pd.DataFrame([{"part": part} | row(_arrays(b, 0, dim) for b in batches)])
        yield pa.RecordBatch.from_pandas(made, schema=arrow, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return fit.mapInArrow(run, schema)


def _as_one(parts: DataFrame, count: int, combine: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> pd.DataFrame:
    """Rows combined in a tree of groups of ``FAN``; the last one, of fixed size, goes to the driver."""
    while count > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("_group")).applyInPandas(combine, schema)
        count = -(-count // FAN)
    return parts.toPandas()


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    dim = len(rows["mean"].iloc[0])
    whole, sums = Spectrum.none(dim), np.zeros(dim, np.int64)
    for r in rows.itertuples():
        whole.join(Spectrum(r.n, np.array(r.mean), np.array(r.values), np.array(r.vectors).reshape(dim, dim)))
        sums = sums + np.array(r.sums)
    return pd.DataFrame([_state(rows["part"].iloc[0] // FAN, whole, sums)])


def _state(part: int, s: Spectrum, sums: np.ndarray) -> dict:
    return {"part": part, "n": s.n, "sums": sums, "mean": s.mean, "values": s.values, "vectors": s.vectors.ravel()}


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"part": rows["part"].iloc[0] // FAN, "values": np.sum(np.stack(rows.sort_values("part")["values"].to_list()), 0)}])


@dataclass
class Whitener:
    n: int
    sums: np.ndarray  # exact, one per dimension
    values: np.ndarray  # eigenvalues of the covariance, falling
    components: np.ndarray  # as columns
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` with one rounding a step, however large n is."""
        return (x - self.sums // self.n) - (self.sums % self.n) / self.n

    def kept(self) -> np.ndarray:
        """Components up to the sixteenth that the vectors spread in."""
        return np.flatnonzero(self.values[:COMPONENTS] > len(self.values) * _EPS * self.trace)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """One column per component up to the sixteenth; null (NaN) where there is no spread."""
        out = np.full((len(x), min(COMPONENTS, len(self.values))), np.nan)
        k = self.kept()
        out[:, k] = self.centred(x) @ self.components[:, k] / np.sqrt(self.values[k])
        return out

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact; null where it doesn't fit into 64 bits."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums.tolist()), default=0)
        kind = np.int64 if most * most * max(1, len(self.sums)) < 1 << 63 else object
        off = x.astype(kind) * self.n - self.sums.astype(kind)
        return [v if v < 1 << 63 else None for v in (off * off).sum(1).tolist()]


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows whose vector is whole and has entries."""
    e = F.col("embedding").cast("array<double>")
    ok = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(e) > 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).filter(F.col("embedding").isNotNull() & ok)
    return rows.select("vec_id", F.transform(e, lambda c: F.floor(F.greatest(F.least(c, F.lit(MOST_ENTRY)), F.lit(-MOST_ENTRY)) * SCALE) + ORIGIN).alias("x"))


def fit_whitener(xs: DataFrame) -> Whitener | None:
    """Fit on each distinct ``x`` once. All must have one length. None without rows."""
    spark = xs.sparkSession
    prepare(spark)
    distinct = settle(xs.select("x").distinct(), "fit-list")
    n = distinct.count()
    if not n:
        return None
    dim = distinct.select(F.size("x")).first()[0]
    count = max(-(-n // MOST_ROWS), min(-(-n // LEAST_ROWS), spark.sparkContext.defaultParallelism))
    fit = settle(distinct.repartition(count, F.xxhash64("x")), "fit-parts")

    def spectrum(blocks: Iterator[np.ndarray]) -> dict:
        s, sums = Spectrum.none(dim), np.zeros(dim, np.int64)
        for block in blocks:
            sums += block.sum(0)
            for x in (block - ORIGIN).astype(float):
                s.add(x)
        state = _state(0, s, sums)
        state.pop("part")
        return state

    # Rank-one updates are the dear part: written before they are combined. Partitions are those of the reading.
    parts = settle(_per_part(fit, spectrum, dim, _STATE), "spectra")
    one = _as_one(parts, fit.rdd.getNumPartitions(), _joined, _STATE)
    sums = np.array(one["sums"].iloc[0], np.int64)
    basis = np.linalg.qr(np.array(one["vectors"].iloc[0]).reshape(dim, dim))[0]
    made = Whitener(n, sums, np.zeros(dim), basis, 0.0)

    # Rayleigh-Ritz: the covariance in this basis, then its small eigenproblem.
    def projected(blocks: Iterator[np.ndarray]) -> dict:
        h = np.zeros((dim, dim))
        for x in blocks:
            y = made.centred(x) @ basis
            h += y.T @ y
        return {"values": h.ravel()}

    def total(row: Callable) -> np.ndarray:
        return np.array(_as_one(_per_part(fit, row, dim, _SUMS), fit.rdd.getNumPartitions(), _summed, _SUMS)["values"].iloc[0])

    small = total(projected).reshape(dim, dim) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    done = Whitener(n, sums, np.maximum(values[::-1], 0.0), basis @ turn[:, ::-1], float(np.trace(small)))
    keep = done.kept()

    def checked(blocks: Iterator[np.ndarray]) -> dict:
        first, second = np.zeros(len(keep)), np.zeros((len(keep), len(keep)))
        for x in blocks:
            w = done.whitened(x)[:, keep]
            first += w.sum(0)
            second += w.T @ w
        return {"values": np.concatenate([first, second.ravel()])}

    if len(keep):
        sums_of = total(checked) / n
        mean, square = sums_of[: len(keep)], sums_of[len(keep) :].reshape(len(keep), len(keep))
        done.identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(len(keep))).max())
    return done


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per usable vector and component up to 16 (fewer where vectors are shorter).

    Rows whose vector is null or empty, or holds null or non-finite entries, fall away, as do vectors of another length
    than the commonest (of several, the shortest). Entries beyond 2^40 count as 2^40, and a deviation that needs more than
    64 bits is null. Null ids stay; repeated rows give repeated rows but count once in the fit. Components without spread have null ``whitened``; with no spread at all ``explained`` and
    ``identity_error`` are null too. Extra columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, embedding)
    # As many rows as there are lengths.
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], _OUT)
    dim = common["dim"]
    rows = rows.filter(F.size("x") == dim)
    made = fit_whitener(rows)
    top = min(COMPONENTS, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _arrays(b, 1, dim)
            m = len(x) * top
            share = made.values[:top] / made.trace if made.trace > 0 else np.full(top, np.nan)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(x)), top)))
            cols = [ids, pa.array(np.tile(np.arange(1, top + 1), len(x)), pa.int32()), pa.array(np.full(m, made.n))]
            cols += [pa.array([v for v in made.deviation(x) for _ in range(top)], pa.int64())]
            cols += [pa.array(v, pa.float64(), from_pandas=True) for v in (made.whitened(x).ravel(), np.tile(share, len(x)))]
            cols += [pa.array([made.identity_error] * m, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "x").mapInArrow(run, _OUT)
