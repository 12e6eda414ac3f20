"""Nuisance models: fitted by aggregates over the data, applied as Column expressions.

One pass gives the counts, means and co-moments of features and target by action (and by fold): these
are all that least squares, scalers and every out-of-fold fit need, as the moments of all folds but one are
merged on the driver. Logistic fits group equal rows with their counts first, once for all folds; up to
``DRIVER_ROWS`` groups are then summed on the driver, more in one pass per Newton step over the written
groups. Only matrices of (features x classes) squared reach the driver. A fitted model is a frozen set of
coefficients that compiles to a pure Column.

Rows without an action, a feature or the target take no part in a fit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.policies import softmax
from lodestar.operators.bootstrap import cut

LOW = 1e-6
#: Groups of equal rows that a logistic fit may hold on the driver (a few MB); more stay distributed, with the same sums.
DRIVER_ROWS = 1 << 16
#: An action space is held by every model, so it can't grow with the data.
MAX_ACTIONS = 10_000


@dataclass(frozen=True)
class Scaler:
    """Population mean and deviation; constant features keep scale 1."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def columns(self, names: Sequence[str]) -> list[Column]:
        return [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(names, self.mean, self.scale)]


def fit_scaler(df: DataFrame, names: Sequence[str]) -> Scaler:
    if not names:
        raise ValueError("the list of features is empty")
    r = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(names) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return Scaler(tuple(r[f"m{i}"] for i in range(len(names))), tuple(r[f"s{i}"] or 1.0 for i in range(len(names))))


@dataclass(frozen=True)
class Moments:
    """Count, mean and sums of centred products of some columns; sums of disjoint rows add up."""

    n: float
    mean: np.ndarray
    spread: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n, gap = self.n + other.n, other.mean - self.mean
        between = np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), self.spread + other.spread + between)


def complete(df: DataFrame, features: Sequence[str], action: str, target: str | None) -> DataFrame:
    return df.dropna(subset=[*features, action, *([target] if target else [])])


def moments(df: DataFrame, features: Sequence[str], action: str, target: str | None = None, fold: str | None = None) -> dict[int, dict]:
    """{fold: {action: Moments of features and target}}; without folds all rows are in fold 0."""
    if not features:
        raise ValueError("the list of features is empty")
    columns = [F.col(c).cast("double") for c in (*features, *([target] if target else []))]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    groups = complete(df, features, action, target).groupBy((F.col(fold) if fold else F.lit(0)).alias("fold"), F.col(action).alias("action"))
    found = groups.agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("mean"),
        F.array(*[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).alias("cov"),
    )
    rows = found.limit(MAX_ACTIONS + 1).collect()  # one per fold and action
    if len(rows) > MAX_ACTIONS:
        raise ValueError(f"there are more than {MAX_ACTIONS} actions (by fold)")
    out: dict[int, dict] = {}
    for r in rows:
        spread = np.zeros((len(columns), len(columns)))
        for (i, j), c in zip(pairs, r["cov"]):
            spread[i, j] = spread[j, i] = c * r["n"]
        out.setdefault(r["fold"], {})[r["action"]] = Moments(float(r["n"]), np.array(r["mean"]), spread)
    return out


def outside(parts: dict[int, dict], fold: int | None) -> dict:
    """Moments by action of all folds but one, or of all."""
    out: dict = {}
    for j, own in parts.items():
        if j != fold:
            for action, m in own.items():
                out[action] = out[action] + m if action in out else m
    return dict(sorted(out.items()))


def scaler_of(by_action: dict, p: int) -> Scaler:
    if not by_action:
        raise ValueError("there are no rows to fit a model on")
    whole = reduce(lambda a, b: a + b, by_action.values())
    deviation = np.sqrt(np.diag(whole.spread)[:p] / whole.n)
    return Scaler(tuple(map(float, whole.mean[:p])), tuple(float(d) or 1.0 for d in deviation))


@dataclass(frozen=True)
class LinearModel:
    """Least squares of minimum norm on scaled features and one dummy per action."""

    features: tuple[str, ...]
    actions: tuple
    scaler: Scaler
    intercept: float
    slopes: tuple[float, ...]
    effects: tuple[float, ...] = field(default=())
    binary: bool = False

    def _linear(self, effect: Column) -> Column:
        return sum((F.lit(b) * x for b, x in zip(self.slopes, self.scaler.columns(self.features))), F.lit(self.intercept)) + effect

    def _out(self, z: Column) -> Column:
        return F.greatest(F.least(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), F.lit(1 - LOW)), F.lit(LOW)) if self.binary else z

    def mu(self, action) -> Column:
        """Prediction for one action; an action that wasn't seen has no effect of its own."""
        known = dict(zip(self.actions, self.effects))
        return self._out(self._linear(F.lit(known.get(action, 0.0))))

    def mu_at(self, action: Column) -> Column:
        effect = F.lit(0.0)
        for a, e in zip(self.actions, self.effects):
            effect = F.when(action == F.lit(a), F.lit(e)).otherwise(effect)
        return self._out(self._linear(effect))

    def mu_array(self, space: Sequence) -> Column:
        return F.array(*[self.mu(a) for a in space])


def observed(df: DataFrame, action: str) -> list:
    """Sorted distinct actions: as many as the action space has."""
    rows = df.select(action).filter(F.col(action).isNotNull()).distinct().limit(MAX_ACTIONS + 1).collect()
    if len(rows) > MAX_ACTIONS:
        raise ValueError(f"there are more than {MAX_ACTIONS} actions")
    return sorted(r[0] for r in rows)


def min_norm(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Coefficients of least norm, apart from the intercept: centre, then pseudo-inverse."""
    n = gram[0, 0]
    mean, mean_y = gram[0, 1:] / n, moment[0] / n
    inner = gram[1:, 1:] - n * np.outer(mean, mean)
    beta = np.linalg.pinv(inner, rcond=1e-12, hermitian=True) @ (moment[1:] - n * mean * mean_y)
    return np.concatenate([[mean_y - mean @ beta], beta])


def _model(features: Sequence[str], by_action: dict, scaler: Scaler, beta: np.ndarray, binary: bool = False) -> LinearModel:
    k = 1 + len(features)
    return LinearModel(tuple(features), tuple(by_action), scaler, float(beta[0]), tuple(map(float, beta[1:k])), tuple(map(float, beta[k:])), binary)


def linear_from(features: Sequence[str], by_action: dict) -> LinearModel:
    """Least squares on scaled features and action dummies, from the moments of features and target by action."""
    p, scaler = len(features), scaler_of(by_action, len(features))
    whole = reduce(lambda a, b: a + b, by_action.values())
    scale, n = np.array(scaler.scale), np.array([m.n for m in by_action.values()])
    centred = np.array([(m.mean[:p] - whole.mean[:p]) / scale for m in by_action.values()])
    d = 1 + p + len(n)
    gram, moment = np.zeros((d, d)), np.zeros(d)
    gram[0, 0], gram[0, 1 + p :], gram[1 + p :, 0] = whole.n, n, n
    gram[1 : 1 + p, 1 : 1 + p] = whole.spread[:p, :p] / np.outer(scale, scale)
    gram[1 : 1 + p, 1 + p :] = (centred * n[:, None]).T
    gram[1 + p :, 1 : 1 + p] = centred * n[:, None]
    gram[1 + p :, 1 + p :] = np.diag(n)
    moment[0], moment[1 : 1 + p] = whole.n * whole.mean[p], whole.spread[:p, p] / scale
    moment[1 + p :] = [m.n * m.mean[p] for m in by_action.values()]
    return _model(features, by_action, scaler, min_norm(gram, moment))


def fit_linear(df: DataFrame, features: Sequence[str], action: str, target: str) -> LinearModel:
    return linear_from(features, outside(moments(df, features, action, target), None))


def newton(step, size: int, penalised: np.ndarray, max_iter: int = 50, tol: float = 1e-9, shifts: np.ndarray | None = None) -> np.ndarray:
    """Minimises log-loss + half the squared norm of the penalised coordinates; step(b) -> (loss, gradient, Hessian).

    shifts: directions (columns) along which the loss is constant, so that the sums hold only rounding errors
    there, which grow with the rows: they get a curvature of the Hessian's own size, and b stays where it began.
    """
    b = np.zeros(size)
    held = np.zeros((size, size)) if shifts is None else shifts @ shifts.T
    loss, g, h = step(b)
    value = loss
    for _ in range(max_iter):
        g, h = g + penalised * b, h + np.diag(penalised) + 1e-10 * np.eye(size)
        h += held * max(np.trace(h) / size, 1e-10)
        move = np.linalg.solve(h, g)
        t = 1.0
        while True:
            trial = b - t * move
            loss, g2, h2 = step(trial)
            new = loss + 0.5 * float((penalised * trial * trial).sum())
            if new <= value + 1e-12 * abs(value) or t < 1e-4:
                break
            t /= 2
        small = np.abs(trial - b).max() < tol
        b, g, h, value = trial, g2, h2, new
        if small:
            break
    return b


class Groups:
    """Equal rows (features, action, fold) with their number and the sum of the target, written once."""

    def __init__(self, df: DataFrame, features: Sequence[str], action: str, target: str | None, fold: str | None, driver_rows: int = DRIVER_ROWS) -> None:
        self.p = len(features)
        names = [f"x{i}" for i in range(self.p)]
        keys = [F.col(c).cast("double").alias(n) for c, n in zip(features, names)]
        keys += [F.col(action).alias("a"), (F.col(fold) if fold else F.lit(0)).alias("fold")]
        y = F.col(target).cast("double") if target else F.lit(0.0)
        self.table = cut(complete(df, features, action, target).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("y")))
        self.held = None
        if self.table.limit(driver_rows + 1).count() <= driver_rows:
            held = self.table.toPandas()
            self.held = (held[names].to_numpy(float), held["a"].to_numpy(object), held["n"].to_numpy(float), held["y"].to_numpy(float), held["fold"].to_numpy())

    def total(self, classes: Sequence, size: int, of_rows: Callable, without: int | None) -> np.ndarray:
        """Sum of of_rows(features, place of the action among the classes, number, sum of the target) over rows outside a fold."""
        place = {c: i for i, c in enumerate(classes)}
        if self.held is not None:
            x, a, n, y, fold = self.held
            keep = fold != without if without is not None else np.ones(len(n), bool)
            return of_rows(x[keep], np.array([place[v] for v in a[keep]], int), n[keep], y[keep])
        p = self.p

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in batches:
                x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(p)])
                a = np.array([place[v] for v in batch.column(p).to_pylist()], int)
                out += of_rows(x, a, *(batch.column(p + 1 + i).to_numpy(zero_copy_only=False) for i in range(2)))
            yield pa.RecordBatch.from_pydict({"i": np.arange(size), "v": out})

        rows = self.table if without is None else self.table.filter(F.col("fold") != without)
        parts = rows.select(*[f"x{i}" for i in range(p)], "a", "n", "y").mapInArrow(partial, "i long, v double")
        out = np.zeros(size)
        for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # a matrix
            out[r["i"]] = r["v"]
        return out


def binary_from(features: Sequence[str], by_action: dict, groups: Groups, without: int | None = None) -> LinearModel:
    """Logistic regression (L2, unit penalty, free intercept) on scaled features and action dummies."""
    scaler, k = scaler_of(by_action, len(features)), len(by_action)
    d = 1 + len(features) + k

    def step(b: np.ndarray):
        def of_rows(x: np.ndarray, a: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.hstack([np.ones((len(x), 1)), (x - np.array(scaler.mean)) / np.array(scaler.scale), np.eye(k)[a]])
            m = z @ b
            p = 1 / (1 + np.exp(-m))
            loss = n @ np.logaddexp(0, m) - y @ m
            return np.concatenate([[loss], z.T @ (n * p - y), ((z * (n * p * (1 - p))[:, None]).T @ z).ravel()])

        t = groups.total(list(by_action), 1 + d + d * d, of_rows, without)
        return t[0], t[1 : d + 1], t[d + 1 :].reshape(d, d)

    return _model(features, by_action, scaler, newton(step, d, np.concatenate([[0.0], np.ones(d - 1)])), True)


def fit_binary(df: DataFrame, features: Sequence[str], action: str, target: str, driver_rows: int = DRIVER_ROWS) -> LinearModel:
    by_action = outside(moments(df, features, action, target), None)
    return binary_from(features, by_action, Groups(df, features, action, target, None, driver_rows))


def fit_outcomes(df: DataFrame, features: Sequence[str], action: str, target: str, k: int, binary: bool | None = None, fold: str = "fold") -> list[LinearModel]:
    """A model for each of k folds, fitted on the others, from one pass over the rows (two if binary)."""
    from lodestar.contract import is_binary

    parts = moments(df, features, action, target, fold)
    if is_binary(df, target) if binary is None else binary:
        groups = Groups(df, features, action, target, fold)
        return [binary_from(features, outside(parts, j), groups, j) for j in range(k)]
    return [linear_from(features, outside(parts, j)) for j in range(k)]


def fit_outcome(df: DataFrame, features: Sequence[str], action: str, target: str, binary: bool | None = None) -> LinearModel:
    """A classifier where the target is exactly {0, 1}, else least squares."""
    from lodestar.contract import is_binary

    binary = is_binary(df, target) if binary is None else binary
    return (fit_binary if binary else fit_linear)(df, features, action, target)


@dataclass(frozen=True)
class BehaviorModel:
    """Multinomial logistic model of the logged action; classes in sorted order."""

    features: tuple[str, ...]
    classes: tuple
    scaler: Scaler
    coefficients: tuple[tuple[float, ...], ...]

    def probs(self) -> Column:
        x = self.scaler.columns(self.features)
        scores = F.array(*[sum((F.lit(b) * c for b, c in zip(row[1:], x)), F.lit(row[0])) for row in self.coefficients])
        return F.transform(softmax(scores), lambda p: F.greatest(F.least(p, F.lit(1 - LOW)), F.lit(LOW)))

    def probs_over(self, space: Sequence) -> Column:
        """Probabilities in the order of an action space; actions never seen get the floor."""
        p = self.probs()
        if tuple(space) == self.classes:
            return p
        at = {a: i for i, a in enumerate(self.classes)}
        return F.array(*[F.element_at(p, at[a] + 1) if a in at else F.lit(LOW) for a in space])


def behavior_from(features: Sequence[str], by_action: dict, groups: Groups, without: int | None = None) -> BehaviorModel:
    scaler = scaler_of(by_action, len(features))
    if len(by_action) < 2:
        raise ValueError("a behaviour model needs at least two observed actions")
    k, d = len(by_action), 1 + len(features)

    def step(b: np.ndarray):
        coef = b.reshape(k, d)

        def of_rows(x: np.ndarray, a: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.hstack([np.ones((len(x), 1)), (x - np.array(scaler.mean)) / np.array(scaler.scale)])
            s = z @ coef.T
            top = s.max(1, keepdims=True)
            e = np.exp(s - top)
            p = e / e.sum(1, keepdims=True)
            loss = (n * (np.log(e.sum(1)) + top[:, 0] - s[np.arange(len(a)), a])).sum()
            g = ((p - np.eye(k)[a]) * n[:, None]).T @ z
            h = np.zeros((k, d, k, d))
            for i in range(k):
                for j in range(k):
                    h[i, :, j, :] = (z * (n * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z
            return np.concatenate([[loss], g.ravel(), h.ravel()])

        size = k * d
        t = groups.total(list(by_action), 1 + size + size * size, of_rows, without)
        return t[0], t[1 : size + 1], t[size + 1 :].reshape(size, size)

    shifts = np.tile(np.eye(d), (k, 1))  # the same change in every class; the penalty alone puts the slopes' sum at zero
    beta = newton(step, k * d, np.tile(np.concatenate([[0.0], np.ones(d - 1)]), k), shifts=shifts).reshape(k, d)
    beta[:, 0] -= beta[:, 0].mean()  # a common intercept changes no probability: zero makes the fit unique
    return BehaviorModel(tuple(features), tuple(by_action), scaler, tuple(tuple(map(float, r)) for r in beta))


def fit_behavior(df: DataFrame, features: Sequence[str], action: str, driver_rows: int = DRIVER_ROWS) -> BehaviorModel:
    return behavior_from(features, outside(moments(df, features, action), None), Groups(df, features, action, None, None, driver_rows))


def fit_behaviors(df: DataFrame, features: Sequence[str], action: str, k: int, fold: str = "fold") -> list[BehaviorModel]:
    """A model for each of k folds, fitted on the others, from two passes over the rows."""
    parts, groups = moments(df, features, action, None, fold), Groups(df, features, action, None, fold)
    return [behavior_from(features, outside(parts, j), groups, j) for j in range(k)]
