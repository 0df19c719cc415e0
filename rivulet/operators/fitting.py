"""Models fitted by gradient descent over rows that may lie on many executors.

A step needs the sum of the rows' gradients and nothing else. Rows that fit the
driver (DRIVER_ROWS) are added up there, in one array; more are checkpointed
once, and each step every partition sends back one vector as long as the
parameters. Both ways compute the same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.streaming.cutting import cut

#: Rows that are fitted on the driver; more stay where they are.
DRIVER_ROWS = 100_000


def _array(col: pa.Array) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Numbers as a vector, lists as a matrix, lists of lists as (matrix, lists a row)."""
    if not pa.types.is_list(col.type):
        return col.to_numpy(zero_copy_only=False).astype(float)
    if pa.types.is_list(col.type.value_type):
        counts = np.diff(col.offsets.to_numpy())
        return _array(col.flatten()), counts
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(col), len(flat) // len(col) if len(col) else 0)


def _arrays(batch: pa.RecordBatch) -> dict:
    return {c: _array(batch.column(c)) for c in batch.schema.names}


class Rows:
    """Columns of a DataFrame, seen as arrays. Rows with a null in one of them are left out."""

    def __init__(self, df: DataFrame, columns: list[str], driver_rows: int = DRIVER_ROWS):
        df = cut(df.select(*columns).dropna())
        self.n = df.count()
        self.df = df if self.n > driver_rows else None
        self.local = None if self.df is not None else _arrays(df.toArrow().combine_chunks().to_batches()[0]) if self.n else None

    def sum(self, f: Callable[[dict], np.ndarray]) -> np.ndarray:
        """The sum of f over the rows; f adds up the rows of one batch."""
        if self.df is None:
            return np.asarray(f(self.local), float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = np.asarray(f(_arrays(batch)), float)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

        return np.sum([r["v"] for r in self.df.mapInArrow(run, "v array<double>").collect()], axis=0)

    def add(self, name: str, f: Callable[[dict], np.ndarray]) -> None:
        """A new column of numbers, or new values of one."""
        if self.df is None:
            self.local[name] = f(self.local)
            return
        old = [c for c in self.df.columns if c != name]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in old], pa.array(f(_arrays(batch)), pa.float64())], [*old, name])

        rows = self.df.select(*[c for c in self.df.columns])
        self.df = cut(rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in old], T.StructField(name, T.DoubleType())])))

    def moments(self, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation over all the matrices named; a column without spread has 1."""
        n = self.n * len(columns)
        mean = self.sum(lambda a: sum(a[c].sum(axis=0) for c in columns)) / n
        std = np.sqrt(self.sum(lambda a: sum(((a[c] - mean) ** 2).sum(axis=0) for c in columns)) / n)
        return mean, np.where(std == 0, 1.0, std)


def fit_logistic(df: DataFrame, features: str = "x", label: str = "y", steps: int = 500, rate: float = 0.5, l2: float = 1.0, driver_rows: int = DRIVER_ROWS) -> tuple[np.ndarray, float]:
    """(weights, bias) for array features and 0/1 labels; the bias isn't penalised."""
    rows = Rows(df, [features, label], driver_rows)
    if not rows.n:
        raise ValueError("no rows to fit")
    mean, std = rows.moments([features])
    p = np.zeros(len(mean) + 1)
    for _ in range(steps):

        def gradient(a, p=p):
            z = (a[features] - mean) / std
            e = 1 / (1 + np.exp(-np.clip(z @ p[:-1] + p[-1], -30, 30))) - a[label]
            return np.append(z.T @ e, e.sum())

        p = p - rate * (rows.sum(gradient) + np.append(l2 * p[:-1], 0.0)) / rows.n
    w = p[:-1] / std
    return w, float(p[-1] - w @ mean)


class Mlp:
    """One hidden layer of rectified units and a number out; parameters are one vector."""

    def __init__(self, inputs: int, hidden: int):
        self.inputs, self.hidden = inputs, hidden

    def start(self, seed: int) -> np.ndarray:
        rng, a, b = np.random.default_rng(seed), self.inputs**-0.5 if self.inputs else 1.0, self.hidden**-0.5
        return np.concatenate([rng.uniform(-a, a, self.inputs * self.hidden + self.hidden), rng.uniform(-b, b, self.hidden + 1)])

    def _parts(self, p: np.ndarray):
        n = self.inputs * self.hidden
        return p[:n].reshape(self.inputs, self.hidden), p[n : n + self.hidden], p[n + self.hidden : -1], p[-1]

    def value(self, p: np.ndarray, x: np.ndarray) -> np.ndarray:
        w, b, out, c = self._parts(p)
        return np.maximum(x @ w + b, 0) @ out + c

    def pull(self, p: np.ndarray, x: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """The gradient by the parameters of the sum of slope * value."""
        w, b, out, _ = self._parts(p)
        h = np.maximum(x @ w + b, 0)
        inner = slope[:, None] * out * (h > 0)
        return np.concatenate([(x.T @ inner).ravel(), inner.sum(axis=0), h.T @ slope, [slope.sum()]])


def adam(gradient: Callable[[np.ndarray], np.ndarray], p: np.ndarray, steps: int, rate: float, state: dict | None = None) -> np.ndarray:
    """p after some steps of Adam; state carries the moments from call to call."""
    s = state if state is not None else {}
    s.setdefault("m", np.zeros_like(p)), s.setdefault("v", np.zeros_like(p)), s.setdefault("t", 0)
    for _ in range(steps):
        g = gradient(p)
        s["t"] += 1
        s["m"], s["v"] = 0.9 * s["m"] + 0.1 * g, 0.999 * s["v"] + 0.001 * g * g
        p = p - rate * (s["m"] / (1 - 0.9 ** s["t"])) / (np.sqrt(s["v"] / (1 - 0.999 ** s["t"])) + 1e-8)
    return p


class Scorer:
    """A network with the scale of its features."""

    def __init__(self, net: Mlp, p: np.ndarray, mean: np.ndarray, std: np.ndarray):
        self.net, self.p, self.mean, self.std = net, p, mean, std

    def value(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        return self.net.value(self.p, (x - self.mean) / self.std) if len(x) else np.empty(0)

    def score(self, df: DataFrame, features: str = "x", out: str = "score") -> DataFrame:
        """df with the network's number for its array features; null for null."""
        me, columns = self, df.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = batch.column(columns.index(features))
                there = col.is_valid().to_numpy(zero_copy_only=False)
                got = np.zeros(len(col))
                if there.any():
                    got[there] = me.value(_array(col.drop_null()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, mask=~there)], [*columns, out])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def fitted_q(steps: DataFrame, gamma: float = 0.9, iterations: int = 20, epochs: int = 50, hidden: int = 32, rate: float = 0.01, seed: int = 42, driver_rows: int = DRIVER_ROWS) -> Scorer:
    """Q of (state, action) features by repeated regression on targets of a frozen network.

    steps: x array<double>, reward double, next array<array<double>> (features
    of the actions that can follow; empty where the session ends).
    """
    rows = Rows(steps, ["x", "reward", "next"], driver_rows)
    if not rows.n:
        raise ValueError("no transitions to fit")
    mean, std = rows.moments(["x"])
    net = Mlp(len(mean), hidden)
    p, state = net.start(seed), {}
    for _ in range(iterations):

        def target(a, p=p):
            flat, counts = a["next"]
            best = np.zeros(len(counts))
            some = np.flatnonzero(counts)
            if len(some):
                first = np.concatenate([[0], np.cumsum(counts)[:-1]])
                best[some] = np.maximum.reduceat(net.value(p, (flat - mean) / std), first[some])
            return a["reward"] + gamma * best

        rows.add("target", target)

        def gradient(p):
            def part(a):
                x = (a["x"] - mean) / std
                return net.pull(p, x, 2 * (net.value(p, x) - a["target"]))

            return rows.sum(part) / rows.n

        p = adam(gradient, p, epochs, rate, state)
    return Scorer(net, p, mean, std)


def fit_preferences(pairs: DataFrame, beta: float = 1.0, epochs: int = 200, hidden: int = 32, rate: float = 0.01, seed: int = 42, driver_rows: int = DRIVER_ROWS) -> Scorer:
    """A scorer fitted to pairs by direct preference optimisation.

    pairs: chosen, rejected array<double>; chosen_ref, rejected_ref double (scores
    of the policy that served). Features of both sides share one scale.
    """
    rows = Rows(pairs, ["chosen", "rejected", "chosen_ref", "rejected_ref"], driver_rows)
    if not rows.n:
        raise ValueError("no pairs to fit")
    mean, std = rows.moments(["chosen", "rejected"])
    net = Mlp(len(mean), hidden)

    def gradient(p):
        def part(a):
            c, r = (a["chosen"] - mean) / std, (a["rejected"] - mean) / std
            margin = net.value(p, c) - net.value(p, r) - (a["chosen_ref"] - a["rejected_ref"])
            slope = -beta / (1 + np.exp(np.clip(beta * margin, -500, 500)))
            return net.pull(p, c, slope) - net.pull(p, r, slope)

        return rows.sum(part) / rows.n

    return Scorer(net, adam(gradient, net.start(seed), epochs, rate), mean, std)


def preference_loss(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """(pairs, loss, accuracy) of scored pairs: chosen_score, rejected_score, chosen_ref, rejected_ref. Ties are losses; null without pairs."""
    margin = F.lit(beta) * (F.col("chosen_score") - F.col("rejected_score") - F.col("chosen_ref") + F.col("rejected_ref"))
    # -log sigmoid(m) without overflow
    loss = F.log1p(F.exp(-F.abs(margin))) + F.greatest(-margin, F.lit(0.0))
    return pairs.agg(F.count("*").alias("pairs"), F.avg(loss).alias("loss"), F.avg((F.col("chosen_score") > F.col("rejected_score")).cast("double")).alias("accuracy"))
