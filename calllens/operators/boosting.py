"""Multi-class gradient boosting under the softmax loss.

In every round each class gets a regression tree on the gradient of the loss, grown level
by level from histograms: the features are cut into bins once, tasks add up gradients per
(class, node, feature, bin), and only these sums, whose number the parameters bound, come
to the driver, which picks the splits.  Leaves take a Newton step.  The rows carry their
scores, stored again every few rounds, so no plan grows with the number of trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens.session import spread, stored

#: Rounds whose trees are applied anew in each pass before the scores are stored again.
KEPT_ROUNDS = 4
#: Classes a model may tell apart; more are taken for a label column that holds none.
MOST_CLASSES = 1000
CELLS = "cell bigint, g double, h double, n bigint"


@dataclass
class Tree:
    """A binary tree by position: node ``i`` has the children ``2 i + 1`` and ``2 i + 2``.
    A leaf has the feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node each row stands at after at most ``depth`` steps; a missing value goes
        to the right."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            f = self.feature[at]
            right = ~(x[rows, np.maximum(f, 0)] <= self.threshold[at])
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class BoostedModel:
    features: list[str]
    classes: list[str]
    priors: np.ndarray
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    gains: np.ndarray | None = None
    #: Mean loss over the training rows before each round.
    losses: list[float] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.priors + add_trees(np.zeros((len(x), len(self.classes))), x, self.rounds, self.depth)

    def probabilities(self) -> Column:
        """The class probabilities of a row that has the features."""
        model = self

        @F.pandas_udf("array<double>")
        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for columns in parts:
                yield pd.Series(list(softmax(model.scores(columns.astype("float64").to_numpy()))))

        return score(F.struct(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(self.features)]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` and ``predicted_class``; of equally likely classes the first."""
        names = F.array(*[F.lit(c) for c in self.classes])
        scored = df.withColumn("probability", self.probabilities())
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return scored.withColumn("predicted_class", F.element_at(names, best))

    def importances(self) -> list[tuple[str, float]]:
        """Share of each feature in what the splits gained."""
        total = float(self.gains.sum()) or 1.0
        return [(f, float(g) / total) for f, g in zip(self.features, self.gains)]

    def to_json(self) -> str:
        trees = [[[t.feature.tolist(), t.threshold.tolist(), t.value.tolist()] for t in r] for r in self.rounds]
        return json.dumps({
            "features": self.features, "classes": self.classes, "priors": self.priors.tolist(), "depth": self.depth,
            "gains": self.gains.tolist(), "losses": self.losses, "rounds": trees,
        })

    @classmethod
    def from_json(cls, text: str) -> BoostedModel:
        held = json.loads(text)
        rounds = [[Tree(np.array(f), np.array(t), np.array(v)) for f, t, v in r] for r in held["rounds"]]
        return cls(held["features"], held["classes"], np.array(held["priors"]), held["depth"], rounds, np.array(held["gains"]), held["losses"])


def add_trees(scores: np.ndarray, x: np.ndarray, rounds: list[list[Tree]], depth: int) -> np.ndarray:
    for trees in rounds:
        for k, tree in enumerate(trees):
            scores[:, k] += tree.value[tree.nodes(x, depth)]
    return scores


def cut_points(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Values up to which rows go left: quantiles of each feature, ``bins`` - 1 at most."""
    points = [i / bins for i in range(1, bins)]
    found = df.approxQuantile(list(features), points, 0.2 / bins)
    return [np.unique(np.array(c, "float64")) for c in found]


def _rows(table: pa.RecordBatch, n_features: int, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, label and scores of a batch."""
    x = _matrix(table.column("x"), np.dtype("u1"), n_features)
    return x, table.column("y").to_numpy(), _matrix(table.column("f"), np.dtype("<f8"), n_classes).copy()


def _matrix(column: pa.Array, kind: np.dtype, width: int) -> np.ndarray:
    """Values of equal width, as they lie behind each other in the column's buffer."""
    if not len(column):
        return np.zeros((0, width), kind)
    _, ends, values = column.buffers()
    start = np.frombuffer(ends, "<i8" if pa.types.is_large_binary(column.type) else "<i4")[column.offset]
    return np.frombuffer(values, kind, len(column) * width, int(start)).reshape(-1, width)


def _binned(df: DataFrame, label: str, features: list[str], classes: list[str], cuts: list[np.ndarray], priors: np.ndarray) -> DataFrame:
    number = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1
    numbers = df.select(number.cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    schema = pa.schema([("y", pa.int32()), ("x", pa.binary()), ("f", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = priors.astype("<f8").tobytes()
        for table in batches:
            columns = [table.column(f"x{i}").to_numpy(zero_copy_only=False).astype("float64") for i in range(len(cuts))]
            # missing values sort behind all others
            x = np.column_stack([np.searchsorted(c, v) for c, v in zip(cuts, columns)]).astype(np.uint8)
            rows = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([table.column("y"), pa.array(rows, pa.binary()), pa.array([start] * len(rows), pa.binary())], schema=schema)

    return numbers.mapInArrow(pack, "y int, x binary, f binary")


def _histogram(
    rows: DataFrame, n_features: int, n_classes: int, bins: int, depth: int, pending: list, growing: list[Tree], level: int
) -> dict[str, np.ndarray]:
    """Sums per (class, node of the level, feature, bin) of gradients, of their Newton
    weights and of rows; the last cell holds the loss."""
    width = 1 << level
    shape = (n_classes, width, n_features, bins)
    size = int(np.prod(shape))
    schema = pa.schema([("cell", pa.int64()), ("g", pa.float64()), ("h", pa.float64()), ("n", pa.int64())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h, n = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, np.int64)
        for table in batches:
            x, y, f = _rows(table, n_features, n_classes)
            p = softmax(add_trees(f, x, pending, depth))
            g[size] -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
            n[size] += len(y)
            for k in range(n_classes):
                r = (y == k) - p[:, k]
                w = np.abs(r) * (1 - np.abs(r))
                node = growing[k].nodes(x, level) - (width - 1) if growing else np.zeros(len(y), np.int64)
                inside = node >= 0  # rows that stopped at a leaf above are done
                for j in range(n_features):
                    cell = ((k * width + node[inside]) * n_features + j) * bins + x[inside, j]
                    g[:size] += np.bincount(cell, r[inside], size)
                    h[:size] += np.bincount(cell, w[inside], size)
                    n[:size] += np.bincount(cell, minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g[some]), pa.array(h[some]), pa.array(n[some])], schema=schema)

    sums = rows.mapInArrow(add_up, CELLS).groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    out = {}
    for name in "ghn":
        whole = np.zeros(size + 1)
        whole[sums.column("cell").to_numpy()] = sums.column(name).to_numpy()
        out[name] = whole[:size].reshape(shape)
        out[f"{name}_all"] = whole[size]
    return out


def _leaf(g: float, h: float, n_classes: int, rate: float) -> float:
    """The Newton step of the multi-class loss, shrunk by the learning rate."""
    return rate * (n_classes - 1) / n_classes * g / h if h > 1e-150 else 0.0


def _split_level(
    trees: list[Tree], sums: dict[str, np.ndarray], level: int, last: bool, rate: float, gains: np.ndarray
) -> bool:
    """Split the open nodes of a level where it gains; whether any is open below."""
    n_classes, width = sums["g"].shape[:2]
    g, h, n = (np.cumsum(sums[c], axis=3) for c in "ghn")
    grown = False
    for k, tree in enumerate(trees):
        for i in range(width):
            at = width - 1 + i
            total_g, total_h, total_n = (float(c[k, i, 0, -1]) for c in (g, h, n))
            if total_n == 0:
                continue
            tree.value[at] = _leaf(total_g, total_h, n_classes, rate)
            left_n, left_g = n[k, i, :, :-1], g[k, i, :, :-1]
            right_n, right_g = total_n - left_n, total_g - left_g
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((left_n > 0) & (right_n > 0), left_g**2 / left_n + right_g**2 / right_n - total_g**2 / total_n, -1.0)
            j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[j, b] <= 1e-12:
                continue
            gains[j] += float(gain[j, b])
            tree.feature[at], tree.threshold[at] = j, b
            for child, (cg, ch) in enumerate((
                (float(left_g[j, b]), float(h[k, i, j, b])), (float(right_g[j, b]), total_h - float(h[k, i, j, b]))
            )):
                tree.value[2 * at + 1 + child] = _leaf(cg, ch, n_classes, rate)
            grown = not last
    return grown


def fit_boosting(
    df: DataFrame, label: str, features, rounds: int = 100, rate: float = 0.1, depth: int = 5, bins: int = 64
) -> BoostedModel:
    """Fit on the rows whose label is not null; classes in alphabetical order.

    Scores begin at the logarithms of the class shares.  ``bins`` is at most 256; what
    comes to the driver in one pass is at most classes x 2 ** (depth - 1) x features x
    bins sums.  Missing features go to the right of every split.
    """
    if not 2 <= bins <= 256:
        raise ValueError("from 2 to 256 bins")
    features = list(features)
    # the classes, the quantiles and the bins are three passes
    data = stored(df.where(F.col(label).isNotNull()).select(*dict.fromkeys([label, *features])), "boosting-data")
    sizes = data.groupBy(F.col(label).cast("string").alias("class")).count()
    shares = {r[0]: r[1] for r in sizes.limit(MOST_CLASSES + 1).collect()}
    if not 0 < len(shares) <= MOST_CLASSES:
        raise ValueError(f"from 1 to {MOST_CLASSES} classes, not {len(shares) or 'none'}")
    classes = sorted(shares)
    total = sum(shares.values())
    priors = np.log(np.array([shares[c] / total for c in classes]))
    cuts = cut_points(data, features, bins)
    rows = stored(_binned(spread(data, total), label, features, classes, cuts, priors), "boosting-rows")
    n, k = len(features), len(classes)
    gains, losses, pending, binned = np.zeros(n), [], [], []
    for _ in range(rounds):
        trees = [Tree.empty(depth) for _ in classes]
        for level in range(depth):
            sums = _histogram(rows, n, k, bins, depth, pending, trees if level else [], level)
            if level == 0:
                losses.append(sums["g_all"] / max(sums["n_all"], 1))
            if not _split_level(trees, sums, level, level == depth - 1, rate, gains):
                break
        pending.append(trees)
        binned.append(trees)
        if len(pending) == KEPT_ROUNDS:
            rows, pending = stored(_advanced(rows, n, k, depth, pending), "boosting-rows"), []
    return BoostedModel(features, classes, priors, depth, [[_on_values(t, cuts) for t in r] for r in binned], gains, losses)


def _advanced(rows: DataFrame, n: int, k: int, depth: int, pending: list) -> DataFrame:
    """The rows with the scores that the pending trees add."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches:
            x, _, f = _rows(table, n, k)
            scores = add_trees(f, x, pending, depth).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [table.column("y"), table.column("x"), pa.array([r.tobytes() for r in scores], pa.binary())], ["y", "x", "f"]
            )

    return rows.mapInArrow(add, "y int, x binary, f binary")


def _on_values(tree: Tree, cuts: list[np.ndarray]) -> Tree:
    """The tree with thresholds on feature values instead of bins."""
    values = [cuts[f][int(b)] if f >= 0 and int(b) < len(cuts[f]) else np.inf if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold)]
    return Tree(tree.feature, np.array(values), tree.value)


def save_boosting(model: BoostedModel, path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_boosting(path: str, spark: SparkSession) -> BoostedModel:
    return BoostedModel.from_json(spark.read.parquet(path).first().model)
