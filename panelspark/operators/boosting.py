"""Second-order boosting of trees for any loss: one histogram aggregate per tree level.

Rows are binned once and written. Each level is one job: every task works out gradient and curvature of
its rows, adds them up per node, feature and bin, and Spark sums the tasks' histograms. What comes to the
driver has at most nodes x features x bins rows, whatever the size of the table. Gradients are added
as whole numbers (``_UNIT`` of a row's greatest weight), so a fit does not depend on the layout of the rows.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.schema import EARLY_STOP_ROUNDS, MISSING_CATEGORY, MISSING_CONTINUOUS
from panelspark.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors get the functions with the task

_UNIT = float(1 << 24)
_TRAIN_LOSS, _VALID_LOSS = -1, -2


@dataclass(frozen=True)
class LogLoss:
    """Cross entropy of the margin."""

    def value(self, margin: np.ndarray, label: np.ndarray) -> np.ndarray:
        return np.logaddexp(0, np.where(label > 0, -margin, margin))

    def derivatives(self, margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return p - label, p * (1 - p)


@dataclass(frozen=True)
class FocalLoss:
    """Cross entropy scaled by ``(1 - p of the class) ** gamma``, positives weighing ``alpha``, others 1 - alpha."""

    alpha: float = 0.25
    gamma: float = 2.0

    def _parts(self, margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
        sign = 2 * label - 1
        log_q = -np.logaddexp(0, -sign * margin)  # q: probability of the row's class
        q = np.exp(log_q)
        return sign, q, np.maximum(1 - q, 1e-15), np.where(label > 0, self.alpha, 1 - self.alpha), log_q

    def value(self, margin: np.ndarray, label: np.ndarray) -> np.ndarray:
        _, _, rest, weight, log_q = self._parts(margin, label)
        return -weight * rest**self.gamma * log_q

    def derivatives(self, margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sign, q, rest, weight, log_q = self._parts(margin, label)
        inner = self.gamma * q * log_q - rest
        slope = -self.gamma * rest ** (self.gamma - 1) * inner + rest**self.gamma * (self.gamma * (log_q + 1) + 1)
        return weight * sign * rest**self.gamma * inner, weight * slope * q * rest


LOSSES = {"LogLoss": LogLoss, "FocalLoss": FocalLoss}


@dataclass
class Tree:
    """Nodes in heap order: node i has the children 2i + 1 (bin at most ``cut``) and 2i + 2; -1: a leaf."""

    feature: list[int]
    cut: list[int]
    value: list[float]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut = np.array(self.feature), np.array(self.cut)
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(int(np.log2(len(feature) + 1)) - 1):
            own = feature[node]
            node = np.where(own < 0, node, 2 * node + 1 + (bins[row, np.maximum(own, 0)] > cut[node]))
        return node

    def leaves(self) -> list[int]:
        """Nodes that rows end in, from left to right."""
        out = []

        def walk(i: int) -> None:
            if self.feature[i] < 0:
                out.append(i)
            else:
                walk(2 * i + 1)
                walk(2 * i + 2)

        walk(0)
        return out


@dataclass(frozen=True)
class Params:
    """``rounds`` trees of ``depth`` levels; ``min_hessian`` and ``min_rows`` on either side of a split."""

    rounds: int = 100
    depth: int = 5
    rate: float = 0.1
    l2: float = 1.0
    min_gain: float = 0.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    bins: int = 64
    start: float = 0.0
    margin_every: int = 10  # trees after which the margins are written anew


@dataclass
class Boosted:
    """A fitted ensemble: scores by itself, and any prefix of its trees is the fit of that many rounds."""

    continuous: list[str]
    category: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)
    gains: list[list[float]] = field(default_factory=list)  # per tree and feature
    train_loss: list[float] = field(default_factory=list)
    valid_loss: list[float] = field(default_factory=list)
    start: float = 0.0

    @property
    def features(self) -> list[str]:
        return [*self.continuous, *self.category]

    @property
    def importance(self) -> dict[str, float]:
        """Share of the gain of all splits."""
        total = np.array(self.gains).reshape(-1, len(self.features)).sum(0)
        return dict(zip(self.features, (total / total.sum() if total.sum() else total).tolist(), strict=True))

    def prefix(self, rounds: int) -> Boosted:
        return Boosted(
            self.continuous, self.category, self.edges, self.trees[:rounds], self.gains[:rounds], self.train_loss[:rounds], self.valid_loss[:rounds], self.start
        )

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(np.array(e), c, side="left") for e, c in zip(self.edges, columns, strict=True)], 1).astype(np.uint8)

    def margin(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.full(len(bins), self.start if first == 0 else 0.0)
        for tree in self.trees[first:]:
            out += np.array(tree.value)[tree.leaf_of(bins)]
        return out

    def transform(self, df: DataFrame, leaves: bool = False) -> DataFrame:
        """Add ``probability`` (of both classes, as a vector); with ``leaves`` also the leaf of each tree, numbered
        from the left, as a vector. Rows stay in place; missing values take the fills of the fit."""
        fit = self
        schema = "margin double, leaves array<double>" if leaves else "margin double"

        @F.pandas_udf(schema)
        def score(rows):  # noqa: ANN001, ANN202
            import pandas as pd

            bins = fit.binned([rows[c].to_numpy() for c in rows.columns])
            out = pd.DataFrame({"margin": fit.margin(bins)})
            if leaves:
                found = np.empty((len(bins), len(fit.trees)))
                for i, tree in enumerate(fit.trees):
                    number = np.zeros(len(tree.feature))
                    number[tree.leaves()] = np.arange(len(tree.leaves()))
                    found[:, i] = number[tree.leaf_of(bins)]
                out["leaves"] = list(found)
            return out

        scored = df.withColumn("__score", score(F.struct(*_filled(self.continuous, self.category))))
        p = 1 / (1 + F.exp(-F.col("__score.margin")))
        scored = scored.withColumn("probability", array_to_vector(F.array(1 - p, p)))
        if leaves:
            scored = scored.withColumn("leaves", array_to_vector(F.col("__score.leaves")))
        return scored.drop("__score")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Boosted:
        told = json.loads(text)
        return Boosted(**{**told, "trees": [Tree(**t) for t in told["trees"]]})


def _filled(continuous: Sequence[str], category: Sequence[str]) -> list[Column]:
    fills = [*[(c, MISSING_CONTINUOUS) for c in continuous], *[(c, MISSING_CATEGORY) for c in category]]
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(v))).alias(f"f{i}") for i, (c, v) in enumerate(fills)]


def quantile_edges(df: DataFrame, continuous: Sequence[str], category: Sequence[str], bins: int) -> list[list[float]]:
    """At most ``bins`` - 1 borders per feature, from one approximate-quantile aggregate; few values are their own."""
    columns = _filled(continuous, category)
    asked = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = df.select(*columns)
    found = rows.agg(*[F.percentile_approx(c, asked, 10_000).alias(c) for c in rows.columns]).first()
    return [sorted(set(found[c] or [])) for c in rows.columns]


def _gain(histogram: np.ndarray, params: Params) -> tuple[float, int, int, np.ndarray]:
    """Best split of one node from its sums ``[feature, bin, (g, h, n)]``: gain, feature, cut, left sums."""
    left = histogram.cumsum(1)
    whole = left[:, -1:, :]
    right = whole - left

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + params.l2, 1e-12)

    gain = worth(left) + worth(right) - worth(whole)
    for side in (left, right):
        gain[(side[..., 1] < params.min_hessian) | (side[..., 2] < params.min_rows)] = -np.inf
    at = int(np.argmax(gain))
    feature, cut = divmod(at, histogram.shape[1])
    return float(gain[feature, cut]), feature, cut, left[feature, cut]


def train_boosted(
    df: DataFrame,
    continuous: Sequence[str],
    category: Sequence[str] = (),
    label: str = "tag",
    weight: Column | str | None = None,
    split: str | None = None,
    loss: LogLoss | FocalLoss = LogLoss(),
    patience: int = EARLY_STOP_ROUNDS,
    edges: Sequence[Sequence[float]] | None = None,
    params: Params = Params(),
) -> Boosted:
    """Fit trees that lower ``loss`` by its first and second derivatives.

    ``label`` is 0 or 1. Rows whose ``split`` is ``valid`` are not learned from; their mean loss is known after each
    round from the next round's first pass, and training ends ``patience`` rounds after the best one, whose
    prefix is returned (with ``split`` None all rounds stay). Missing values are filled with the fixed markers;
    rows without a label are left out. A table without learnable rows gives a model without trees.
    """
    if not 2 <= params.bins <= 256:
        raise ValueError("between 2 and 256 bins")
    model = Boosted(list(continuous), list(category), [], start=params.start)
    columns = _filled(continuous, category)
    is_valid = F.col(split).eqNullSafe("valid") if split else F.lit(False)
    own_weight = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    rows = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("label"), own_weight.alias("weight"), is_valid.alias("valid"), F.lit(float(params.start)).alias("margin"), *columns
    )
    model.edges = [list(e) for e in edges] if edges is not None else quantile_edges(df.filter(~is_valid), continuous, category, params.bins)
    n_features, n_bins = len(model.edges), max([len(e) for e in model.edges] + [1]) + 1
    names = [f"f{i}" for i in range(n_features)]

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.binned([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            packed = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], packed], ["label", "weight", "valid", "margin", "bins"])

    schema = "label double, weight double, valid boolean, margin double, bins binary"
    table = materialize(rows.mapInArrow(to_bins, schema), "binned")
    top = table.agg(F.max("weight")).first()[0] or 1.0
    unit = _UNIT / top
    written = 0  # trees that are in the stored margins
    for number in range(params.rounds + 1):
        open_nodes, tree = [0], Tree([-1], [0], [0.0])
        gains = np.zeros(n_features)
        for level in range(params.depth):
            sums = _histograms(table, model, written, tree, open_nodes, n_features, n_bins, loss, unit, level == 0)
            if level == 0:
                told = sums.pop("losses")
                if number:
                    model.train_loss.append(told[_TRAIN_LOSS])
                    model.valid_loss += [told[_VALID_LOSS]] if split is not None else []
                if number == params.rounds or split is not None and _done(model.valid_loss, patience):
                    open_nodes = None
                    break
            size = 2 ** (level + 2) - 1
            tree = Tree(*[old + [new] * (size - len(old)) for old, new in ((tree.feature, -1), (tree.cut, 0), (tree.value, 0.0))])
            following = []
            for node in open_nodes:
                own = sums["nodes"][node]
                if level == 0:
                    tree.value[0] = _leaf(own[0].sum(0), params)
                gain, feature, cut, left = _gain(own, params)
                if not gain > params.min_gain:
                    continue
                tree.feature[node], tree.cut[node] = feature, cut
                gains[feature] += gain
                tree.value[2 * node + 1], tree.value[2 * node + 2] = _leaf(left, params), _leaf(own[0].sum(0) - left, params)
                following += [2 * node + 1, 2 * node + 2]
            open_nodes = following
            if not open_nodes:
                break
        if open_nodes is None:
            break
        if tree.feature[0] < 0:  # nothing left to split
            break
        model.trees.append(tree)
        model.gains.append(gains.tolist())
        if len(model.trees) - written >= params.margin_every and number + 1 < params.rounds:
            table = _with_margins(table, model, written)
            written = len(model.trees)
    if split is not None and model.valid_loss:
        model = model.prefix(int(np.argmin(model.valid_loss)) + 1)
    return model


def _done(losses: Sequence[float], patience: int) -> bool:
    return bool(losses) and len(losses) - 1 - int(np.argmin(losses)) >= patience


def _leaf(sums: np.ndarray, params: Params) -> float:
    return float(-params.rate * sums[0] / max(sums[1] + params.l2, 1e-12))


def _read(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, n_features)
    label, weight, margin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "margin"))
    return bins, label, weight, margin, batch.column("valid").to_numpy(zero_copy_only=False).astype(bool)


def _with_margins(table: DataFrame, model: Boosted, written: int) -> DataFrame:
    n_features = len(model.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, _, margin, _ = _read(batch, n_features)
            new = pa.array(margin + Boosted([], [], [], model.trees[written:]).margin(bins))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), batch.column("valid"), new, batch.column("bins")], batch.schema.names)

    return materialize(table.mapInArrow(run, table.schema), "margins")


def _histograms(
    table: DataFrame, model: Boosted, written: int, tree: Tree, open_nodes: list[int], n_features: int, n_bins: int, loss, unit: float, with_loss: bool
) -> dict:
    """Sums of gradient, curvature and rows for the open nodes of the tree in growth, per feature and bin; at the
    first level also the mean loss so far of the learned and of the validation rows."""
    recent = Boosted([], [], [], model.trees[written:])
    place = np.full(len(tree.feature), -1)
    place[open_nodes] = np.arange(len(open_nodes))
    cells = len(open_nodes) * n_features * n_bins
    offset = np.arange(n_features) * n_bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, losses = np.zeros((cells, 3)), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, label, weight, margin, valid = _read(batch, n_features)
            margin = margin + recent.margin(bins)
            if with_loss:
                value = np.rint(loss.value(margin, label) * weight * unit)
                for slot, chosen in ((_TRAIN_LOSS, ~valid), (_VALID_LOSS, valid)):
                    old = losses.get(slot, np.zeros(3))
                    losses[slot] = old + [value[chosen].sum(), np.rint(weight[chosen] * unit).sum(), chosen.sum()]
            own = place[tree.leaf_of(bins)]
            learn = ~valid & (own >= 0)
            g, h = loss.derivatives(margin[learn], label[learn])
            cell = ((own[learn] * n_features * n_bins)[:, None] + offset + bins[learn]).ravel()
            for i, v in enumerate((np.rint(g * weight[learn] * unit), np.rint(h * weight[learn] * unit), np.ones(int(learn.sum())))):
                total[:, i] += np.bincount(cell, np.repeat(v, n_features), cells)
        used = np.flatnonzero(total[:, 2])
        slots = np.concatenate([used, np.array(list(losses), np.int64)]).astype(np.int64)
        values = np.concatenate([total[used], np.array(list(losses.values())).reshape(-1, 3)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slots), *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(3)]], ["slot", "g", "h", "n"])

    summed = table.mapInArrow(run, "slot long, g long, h long, n long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    found = summed.toArrow()  # at most nodes x features x bins rows
    slot = found.column("slot").to_numpy()
    values = np.stack([found.column(c).to_numpy().astype(float) for c in ("g", "h", "n")], 1) if len(slot) else np.zeros((0, 3))
    values[:, :2] /= unit
    whole = np.zeros((cells, 3))
    whole[slot[slot >= 0]] = values[slot >= 0]
    shaped = whole.reshape(len(open_nodes), n_features, n_bins, 3)
    out: dict = {"nodes": {node: shaped[i] for i, node in enumerate(open_nodes)}}
    if with_loss:
        means = dict.fromkeys((_TRAIN_LOSS, _VALID_LOSS), float("nan"))
        for s, (value, weights, _) in zip(slot, values, strict=True):
            if s < 0 and weights > 0:
                means[int(s)] = value / weights
        out["losses"] = means
    return out


def save_boosted(spark: SparkSession, model: Boosted, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    return Boosted.from_json(spark.read.text(path, wholetext=True).first()["value"])
