"""Additive boosting of regression trees on the softmax loss, from scratch or from the margins of a model fitted before.

A round adds one tree a class. The trees of a round grow level by level, all classes side by side: a pass over the rows sums
gradient and curvature by (class, node, feature, bin) within each task, Spark adds the tasks' sums up, and the driver picks the
splits. What a task sends and the driver sees is bounded by the model (classes x nodes x features x bins), whatever the
number of rows. Fine-tuning keeps the earlier trees as they are and adds rounds on the new rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotally.functions.folders import checkpointed

#: Rounds after which margins are written down instead of being added up again in every pass; rows handled at a time.
PENDING, STEP = 8, 4096


@dataclass
class Trees:
    """One tree a class, complete to the same depth: [class, node] feature and threshold (larger values go right, missing ones left), [class, leaf] value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, depth: int) -> np.ndarray:
        """[row, class]: the node of this depth that each row reaches, counted from 0."""
        k = np.arange(self.feature.shape[0])
        node = np.zeros((len(x), k.size), np.int64)
        for _ in range(depth):
            right = np.take_along_axis(x, self.feature[k, node], 1) > self.threshold[k, node]
            node = 2 * node + 1 + right
        return node - (2**depth - 1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.arange(self.value.shape[0]), self.leaves(x, self.value.shape[1].bit_length() - 1)]


@dataclass
class Boosted:
    """A fitted model. losses: mean weighted loss of the training rows before each of the last fit's rounds."""

    features: list[str]
    classes: int
    rounds: list[Trees] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        for trees in self.rounds:
            out += trees.margins(x)
        return out


def _vector(features: list[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in features))


def _matrix(column, features: int) -> np.ndarray:
    return np.array(column, dtype=float).reshape(-1, features)


def margins(df: DataFrame, model: Boosted, out: str = "margins") -> DataFrame:
    """df with an array of each class's margin."""
    shared, n = df.sparkSession.sparkContext.broadcast(model), len(model.features)  # the trees

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.margins(_matrix(x.tolist(), n))), dtype=object)

    return df.withColumn(out, scores(_vector(model.features)))


def classified(df: DataFrame, model: Boosted, out: str = "prediction") -> DataFrame:
    """df with the class of the largest margin, the first of equal ones."""
    m = F.col("__margins")
    return margins(df, model, "__margins").withColumn(out, (F.array_position(m, F.array_max(m)) - 1).cast("int")).drop("__margins")


def log_loss(df: DataFrame, model: Boosted, label: str = "label", weight: str | None = None) -> float:
    """Weighted mean of -log of the softmax share of the true class."""
    top, m = F.array_max("__m"), F.col("__m")
    each = top + F.log(F.aggregate(m, F.lit(0.0), lambda s, v: s + F.exp(v - top))) - F.get(m, F.col(label).cast("int"))
    w = F.col(weight) if weight else F.lit(1.0)
    return margins(df.where(F.col(label).isNotNull()), model, "__m").agg(F.sum(each * w) / F.sum(w)).first()[0]


def shares(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _level(rows: DataFrame, pending: list[Trees], grown: Trees, depth: int, shape: tuple[int, ...]) -> tuple[np.ndarray, float, float]:
    """Sums [class, node, feature, bin, (gradient, curvature)] of a level, and weighted loss and weight. rows: b (bins), m (margins), y, w."""
    classes, nodes, features, bins = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, weight = np.zeros((2, classes, nodes, features, bins)), 0.0, 0.0
        for batch in batches:
            for at in range(0, len(batch), STEP):
                part = batch.slice(at, STEP)
                b = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, features).astype(float)
                m = part.column(1).flatten().to_numpy().reshape(-1, classes) + sum((t.margins(b) for t in pending), 0.0)
                y, w = part.column(2).to_numpy(), part.column(3).to_numpy()
                p = shares(m)
                loss -= float((np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)) * w).sum())
                weight += float(w.sum())
                g, h = (p - (y[:, None] == np.arange(classes))) * w[:, None], p * (1 - p) * w[:, None]
                node, place = grown.leaves(b, depth), b.astype(np.int64) + np.arange(features) * bins
                for k in range(classes):
                    where = (node[:, [k]] * (features * bins) + place).ravel()
                    for i, v in enumerate((g, h)):
                        total[i, k] += np.bincount(where, np.repeat(v[:, k], features), nodes * features * bins).reshape(nodes, features, bins)
        flat = total.reshape(2, -1)
        some = np.flatnonzero(flat.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(flat[0, some], loss)), pa.array(np.append(flat[1, some], weight))], ["place", "g", "h"])

    sums = rows.mapInArrow(run, "place long, g double, h double").groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # at most the product of the shape
    own, rest = sums[sums.place < 0], sums[sums.place >= 0]
    total = np.zeros((2, classes * nodes * features * bins))
    total[0, rest.place], total[1, rest.place] = rest.g, rest.h
    return np.moveaxis(total.reshape(2, *shape), 0, -1), float(own.g.sum()), float(own.h.sum())


def _splits(sums: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Best feature and bin [class, node] by gain, the first of equal ones; bin inf where no split gains or leaves enough curvature on both sides."""
    left = sums.cumsum(axis=3)
    whole = left[:, :, :, -1:, :]
    right = whole - left

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + penalty)

    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), worth(left) + worth(right) - worth(whole), 0.0)[:, :, :, :-1]
    flat = np.round(gain, 9).reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=2)
    some = np.take_along_axis(flat, best[..., None], 2)[..., 0] > 0
    return best // gain.shape[3], np.where(some, best % gain.shape[3], np.inf)


def fit(df: DataFrame, features: list[str], classes: int, label: str = "label", weight: str | None = None, rounds: int = 20, depth: int = 4, rate: float = 0.3, penalty: float = 1.0, least: float = 1.0, bins: int = 32, start: Boosted | None = None) -> Boosted:
    """A model of so many more rounds than start (or than nothing), fitted on df.

    With start the rows' margins begin at that model's, so no added round leaves its predictions exactly as they are. Labels are whole
    numbers from 0; rows without one are left out. Missing feature values go left. Splits lie at the quantiles of df's features, at most bins a feature.
    A table without rows adds nothing.
    """
    if start is not None and (start.features != features or start.classes != classes):
        raise ValueError("the model to start from has other features or classes")
    if not 2 <= bins <= 256:
        raise ValueError("from 2 to 256 bins")
    base = start or Boosted(features, classes)
    if not rounds:
        return Boosted(features, classes, list(base.rounds))
    known = df.where(F.col(label).isNotNull())
    quantiles = known.approxQuantile(features, [i / bins for i in range(1, bins)], 1e-3)
    if not any(quantiles):
        return Boosted(features, classes, list(base.rounds))
    cuts = [np.unique(q) for q in quantiles]
    plain = margins(known.select(*features, F.col(label).cast("long").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), base, "m").select(_vector(features).alias("x"), "m", "y", "w")

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), len(cuts))
            b = np.stack([np.where(np.isnan(v), 0, np.searchsorted(c, v)) for v, c in zip(x.T, cuts, strict=True)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in b], pa.binary()), *batch.columns[1:]], ["b", "m", "y", "w"])

    kind = "b binary, m array<double>, y long, w double"
    rows, pending, new, losses = checkpointed(plain.mapInArrow(binned, kind)), [], [], []
    shape = (classes, len(features), max(len(c) for c in cuts) + 1)
    for _ in range(rounds):
        trees = Trees(np.zeros((classes, 2**depth - 1), int), np.full((classes, 2**depth - 1), np.inf), np.zeros((classes, 2**depth)))
        for level in range(depth):
            sums, loss, total = _level(rows, pending, trees, level, (shape[0], 2**level, *shape[1:]))
            if not level:
                losses.append(loss / total)
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            trees.feature[:, at], trees.threshold[:, at] = _splits(sums, penalty, least)
        left = sums.cumsum(axis=3)
        stop = np.minimum(trees.threshold[:, at], shape[2] - 1).astype(int)  # an inf sends all to the left
        part = left[np.arange(classes)[:, None], np.arange(2 ** (depth - 1)), trees.feature[:, at], stop]
        both = np.stack([part, left[:, :, 0, -1] - part], 2).reshape(classes, -1, 2)  # any feature's bins make up the node
        trees.value = -rate * both[..., 0] / (np.maximum(both[..., 1], 0.0) + penalty)
        pending.append(trees)
        real = [[cuts[f][int(t)] if t < len(cuts[f]) else np.inf for f, t in zip(fs, ts, strict=True)] for fs, ts in zip(trees.feature, trees.threshold, strict=True)]
        new.append(Trees(trees.feature, np.array(real), trees.value))
        if len(pending) == PENDING:
            rows, pending = checkpointed(_added(rows, pending, classes, len(features), kind)), []
    return Boosted(features, classes, [*base.rounds, *new], losses)


def _added(rows: DataFrame, pending: list[Trees], classes: int, features: int, kind: str) -> DataFrame:
    """rows with the pending trees' values in their margins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                b = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, features).astype(float)
                m = batch.column(1).flatten().to_numpy().reshape(-1, classes) + sum(t.margins(b) for t in pending)
                lists = pa.ListArray.from_arrays(np.arange(0, m.size + 1, classes, dtype=np.int32), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), batch.column(3)], ["b", "m", "y", "w"])

    return rows.mapInArrow(run, kind)
