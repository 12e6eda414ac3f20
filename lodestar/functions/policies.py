"""Policies as array columns of action probabilities; position i belongs to action_space[i]."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE_PROPENSITY = 1e-6


def action_array(space: Sequence) -> Column:
    return F.array(*[F.lit(a) for a in space])


def argmax_index(p: Column) -> Column:
    """Zero-based place of the first largest entry."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax_action(p: Column, space: Sequence) -> Column:
    return F.element_at(action_array(space), argmax_index(p) + 1)


def take_probability(p: Column, action: Column, space: Sequence) -> Column:
    """Probability of the row's action; an action outside the space raises."""
    at = F.array_position(action_array(space), action)
    missing = F.raise_error(F.concat(F.lit("action is not in the action space: "), F.coalesce(action.cast("string"), F.lit("NULL"))))
    return F.when(at > 0, F.element_at(p, F.greatest(at, F.lit(1)).cast("int"))).otherwise(missing.cast("double"))


def take_probability_or(p: Column, action: Column, space: Sequence, default: float = SAFE_PROPENSITY) -> Column:
    at = F.array_position(action_array(space), action)
    return F.when(at > 0, F.element_at(p, F.greatest(at, F.lit(1)).cast("int"))).otherwise(F.lit(default))


class Policy:
    """Row-local policy: ``probs()`` is a Column over the log's columns."""

    action_space: Sequence

    def probs(self) -> Column:
        raise NotImplementedError

    def prepare(self, df: DataFrame) -> DataFrame:
        """Checks that need the data; default: none."""
        return df

    def argmax(self) -> Column:
        return argmax_index(self.probs())


class ColumnPolicy(Policy):
    """A user's expression, or a Pandas UDF applied to columns, that yields array<double>."""

    def __init__(self, probs: Callable[[], Column], action_space: Sequence) -> None:
        self._probs, self.action_space = probs, list(action_space)

    def probs(self) -> Column:
        return self._probs()


def scores_of(weights: Sequence[Sequence[float]], features: Sequence[Column]) -> Column:
    """Array of linear scores, one per row of weights."""
    return F.array(*[sum((F.lit(float(w)) * f for w, f in zip(row[1:], features[1:])), F.lit(float(row[0])) * features[0]) for row in weights])


class GreedyScores(Policy):
    """One-hot at the best linear score. The default weights are a seeded normal matrix whose bias
    column is raised by (.5, .4, .3, .2), over the standardised features of the synthetic log."""

    def __init__(self, seed: int = 0, weights: np.ndarray | None = None, features: Sequence[Column] | None = None) -> None:
        if weights is None:
            weights = np.random.default_rng(seed).normal(size=(4, 5))
            weights[:, 0] += (0.5, 0.4, 0.3, 0.2)
        self.weights, self.features = np.asarray(weights), features
        self.action_space = list(range(len(self.weights)))

    def scores(self) -> Column:
        features = self.features or standard_features()
        return scores_of(self.weights, features)

    def probs(self) -> Column:
        best = argmax_index(self.scores())
        return F.transform(F.array(*map(F.lit, self.action_space)), lambda i: (i == best).cast("double"))


def standard_features() -> list[Column]:
    return [F.lit(1.0), F.col("loyal").cast("double"), (F.col("age") - 40) / 12.0, (F.col("risk") - 0.5) / 0.25, (F.log("income") - 10.5) / 0.5]


class EpsilonGreedy(Policy):
    """epsilon / k everywhere and the rest on the base policy's best action."""

    def __init__(self, base: Policy, epsilon: float = 0.1) -> None:
        self.base, self.epsilon, self.action_space = base, epsilon, base.action_space

    def probs(self) -> Column:
        k = len(self.action_space)
        return F.transform(self.base.probs(), lambda p: F.lit(self.epsilon / k) + F.lit(1.0 - self.epsilon) * p)


def softmax(scores: Column, tau: float = 1.0) -> Column:
    t = max(tau, 1e-6)
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp((s - top) / F.lit(t)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


class SoftmaxScores(Policy):
    def __init__(self, base: GreedyScores, tau: float = 1.0) -> None:
        self.base, self.tau, self.action_space = base, tau, base.action_space

    def probs(self) -> Column:
        return softmax(self.base.scores(), self.tau)


def make_policy(kind: str, seed: int = 0, epsilon: float = 0.1, tau: float = 1.0) -> Policy:
    base = GreedyScores(seed)
    made = {"greedy": lambda: base, "epsilon_greedy": lambda: EpsilonGreedy(base, epsilon), "softmax": lambda: SoftmaxScores(base, tau)}
    if kind not in made:
        raise ValueError(f"unknown policy kind: {kind}; one of {sorted(made)}")
    return made[kind]()


class ActionColumnPolicy(Policy):
    """One-hot at the action that a column names; unknown actions raise with their sorted list."""

    def __init__(self, action_col: str, action_space: Sequence) -> None:
        if not len(action_space):
            raise ValueError("action_space must not be empty")
        if len(set(action_space)) != len(action_space):
            raise ValueError("action_space must not hold duplicates")
        self.action_col, self.action_space = action_col, list(action_space)

    def prepare(self, df: DataFrame) -> DataFrame:
        if self.action_col not in df.columns:
            raise ValueError(f"missing action column: {self.action_col}")
        c = F.col(self.action_col)
        unknown = df.filter(c.isNull() | ~c.isin(*self.action_space)).select(c.alias("a")).distinct().limit(20).collect()
        if unknown:
            raise ValueError(f"Unknown actions: {sorted((r['a'] for r in unknown), key=str)}")
        return df

    def probs(self) -> Column:
        return F.transform(action_array(self.action_space), lambda a: (a == F.col(self.action_col)).cast("double"))

