"""Operator 11: whitening of embeddings, fitted on each distinct vector once or as often as it occurs.

Vectors become whole numbers; equal ones are grouped with their count (a partial aggregate, so copies cost a row a task).
The fit weights are those counts or one. Weighted sums come first; every task then centres its distinct vectors by them and
multiplies them by themselves, and the sums of those products are the covariance, whose eigenvectors are found on the driver
(a matrix of dimensions squared). Each distinct vector is whitened once and joined back to its rows; the few vectors that hold a
large share of all rows (under SHARE of them, whatever the input) are broadcast for that, so that no task gets all their copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotally.llm.common import read, saved

#: Parts of a unit that entries are rounded down to, components returned, and the part of all rows from which on a vector's copies aren't shuffled.
SCALE, COMPONENTS, SHARE = 256, 4, 1000
#: Vectors multiplied at a time; an eigenvalue below this part of the trace counts as none.
STEP, NONE = 8192, 1e-12
LONG = 1 << 63


class Fit(NamedTuple):
    """What whitening needs: n and sums of the fit list, unit eigenvectors (rows) and eigenvalues, largest first, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(vector: Column, scale: int) -> Column:
    """Entries as floor(scale * entry), an array of longs; null if the vector or an entry is null, not finite or beyond a long."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * scale) < float(LONG), F.lit(False)))
    return F.when(vector.isNotNull() & F.coalesce(fine, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def vectors_of(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x of the rows that have whole, finite vectors."""
    return df.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), scale).alias("x")).where("x is not null and size(x) > 0")


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as 64-bit integers where they fit, else as Python's."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums)) if x.size else 0
    kind = np.int64 if most < LONG else object
    return x.astype(kind) * n - np.array(sums, kind)


def weighted_sums(groups: DataFrame) -> tuple[int, list[int]]:
    """Sum of the weights and weighted sums of each dimension, exact. groups: x, weight. Each task sends a row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                x, w = matrix(batch.column(0)), batch.column(1).to_numpy()
                fits = max(abs(int(x.max())), abs(int(x.min()))) * int(w.sum()) < LONG
                part = w @ x if fits else w.astype(object) @ x.astype(object)
                n, total = n + int(w.sum()), part.astype(object) if total is None else total + part.astype(object)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total))), pa.array([str(v) for v in (n, *total)])], ["dimension", "part"])

    parts = groups.select("x", "weight").mapInArrow(run, "dimension long, part string")
    found = dict(parts.groupBy("dimension").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect())  # a row a dimension
    return int(found.pop(-1, 0)), [int(found[i]) for i in sorted(found)]


def covariance(groups: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance of x, divisor n, centred before multiplying. Each task sends a row for each pair of dimensions i <= j."""
    d = len(sums)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for at in range(0, len(batch), STEP):
                part = batch.slice(at, STEP)
                centred = offsets(matrix(part.column(0)), n, sums).astype(float) / n
                total += (centred * part.column(1).to_numpy()[:, None]).T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(upper[0].size)), pa.array(total[upper])], ["place", "part"])

    parts = groups.select("x", "weight").mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("s")).collect()  # dimensions squared
    out = np.zeros((d, d))
    for place, s in parts:
        out[upper[0][place], upper[1][place]] = out[upper[1][place], upper[0][place]] = s / n
    return out


def fitted(groups: DataFrame) -> Fit:
    """Eigenvectors of the covariance of groups (x, weight)."""
    n, sums = weighted_sums(groups)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    values, vectors = np.linalg.eigh(covariance(groups, n, sums))
    return Fit(n, sums, np.ascontiguousarray(vectors.T[::-1]), np.maximum(values[::-1], 0.0), float(np.maximum(values, 0.0).sum()))


def whitened_groups(groups: DataFrame, fit: Fit, components: int) -> DataFrame:
    """groups with deviation and whitened (an array of up to so many components; null where a component has no variance)."""
    k = min(components, len(fit.sums))
    alive = fit.values[:k] > NONE * fit.trace
    project = fit.vectors[:k] / np.sqrt(np.where(alive, fit.values[:k], 1.0))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STEP):
                part = batch.slice(at, STEP)
                y = offsets(matrix(part.column(0)), fit.n, fit.sums)
                far = max(abs(int(y.max())), abs(int(y.min()))) ** 2 * y.shape[1] >= LONG
                squares = (y.astype(object) ** 2 if far else y * y).sum(axis=1)
                white = (y.astype(float) / fit.n) @ project.T
                lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, k, dtype=np.int32), pa.array(white.ravel(), mask=np.tile(~alive, len(white))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([int(s) if s < LONG else None for s in squares], pa.int64()), lists], ["x", "copies", "weight", "deviation", "whitened"])

    return groups.select("x", "copies", "weight").mapInArrow(run, "x array<long>, copies long, weight long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, fit: Fit, components: int) -> float | None:
    """Largest absolute entry of the whitened components' weighted covariance minus the identity; null without a component that varies."""
    alive = [i for i in range(min(components, len(fit.sums))) if fit.values[i] > NONE * fit.trace]
    if not alive:
        return None
    w = [F.col("whitened")[i] for i in alive]
    means = whitened.agg(*(F.sum(c * F.col("weight")) / fit.n for c in w)).first()
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1)]
    found = whitened.agg(*(F.sum((w[i] - means[i]) * (w[j] - means[j]) * F.col("weight")) / fit.n for i, j in pairs)).first()
    return max(abs(found[at] - (i == j)) for at, (i, j) in enumerate(pairs))


def joined_back(rows: DataFrame, groups: DataFrame, share: int) -> DataFrame:
    """rows (vec_id, x) with what groups (x, copies, ...) hold of x. Vectors with over 1/share of all rows, fewer than share in number, are broadcast."""
    total = groups.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") > F.lit(total // share + 1)
    hot = F.broadcast(groups.where(often))
    with_hot = rows.join(hot, "x")
    rest = rows.join(F.broadcast(groups.where(often).select("x")), "x", "left_anti").join(groups.where(~often), "x")
    return with_hot.unionByName(rest)


def whitened(df: DataFrame, scale: int = SCALE, components: int = COMPONENTS, weights: str = "one", share: int = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened, explained (arrays, a component each) and identity_error of every row with a usable vector.

    weights: "one" fits on each distinct vector once, "counts" as often as it occurs. Rows go whose vector is null, empty, or
    holds a null, a NaN, an infinity or an entry that doesn't fit a long; so do those of another length than the most
    frequent one (of equally frequent ones the longest). Null ids stay and repeated rows each give theirs. Eigenvalues of equal size
    share a space in which the components may lie any way. A component without variance has null as whitened value (so have all
    of a single distinct vector, whose explained and identity_error are null too). A deviation beyond a long is null. An empty table gives none.
    """
    if weights not in ("one", "counts"):
        raise ValueError(f"weights are one or counts, not {weights}")
    rows = vectors_of(df, scale, id_col, vector_col)
    found = saved(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("weight", F.col("copies") if weights == "counts" else F.lit(1).cast("long")))
    usual = found.groupBy(F.size("x").alias("length")).agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), F.desc("length")).first()
    same = F.size("x") == F.lit(usual[0] if usual else 0)
    rows, found = rows.where(same), found.where(same)
    fit = fitted(found)
    groups = saved(whitened_groups(found, fit, components)) if fit.n else found.select("x", "copies", "weight", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    error = identity_error(groups, fit, components) if fit.n else None
    explained = F.array(*(F.lit(float(v / fit.trace) if fit.trace else None).cast("double") for v in fit.values[:components]))
    parts = joined_back(rows, groups.drop("weight"), share)
    return parts.select("vec_id", F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    one = whitened(read(spark, sf_dir, "embeddings")).select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return one.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")
