"""Propensity and outcome columns: logged, estimated, or out of fold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.contract import bad_propensity
from lodestar.functions.policies import SAFE_PROPENSITY, take_probability_or
from lodestar.operators.bootstrap import hash32
from lodestar.operators.models import fit_behavior, fit_behaviors, fit_outcomes, observed

#: Notes that summaries carry.
ESTIMATED = "estimated_propensity_from_behavior_model"
AUTO_LOGGED = "auto_selected_logged_propensity"
AUTO_INVALID = "logged_propensity_invalid_fallback_to_estimated"
AUTO_MISSING = "logged_propensity_missing_fallback_to_estimated"


@dataclass(frozen=True)
class Propensity:
    """pa: propensity of the logged action; pa_all: of every action, in the order of the space."""

    pa: Column
    pa_all: Column | None
    source: str
    column: str | None = None
    notes: tuple[str, ...] = ()
    out_of_fold: bool = False


def fold_column(row_key: Column, k: int, seed: int = 123) -> Column:
    """Fold 0 .. k - 1 of a row by the hash of its key: independent of partitioning, balanced on average."""
    if k < 2:
        raise ValueError("n_splits must be at least 2")
    return F.pmod(hash32(F.concat(F.lit(f"{seed}|"), row_key.cast("string"))), F.lit(k)).cast("int")


def balanced_folds(df: DataFrame, row_key: str, k: int, seed: int = 123) -> DataFrame:
    """df with a fold of exactly balanced sizes: ranks of hashed keys, modulo k."""
    from lodestar.operators.bootstrap import ranked

    if k < 2:
        raise ValueError("n_splits must be at least 2")
    keyed = df.withColumn("__h", hash32(F.concat(F.lit(f"{seed}|"), F.col(row_key).cast("string")))).withColumn("__k", F.struct("__h", row_key))
    return ranked(keyed, "__k").withColumn("fold", F.pmod("rank", F.lit(k)).cast("int")).drop("__h", "__k", "rank")


def by_fold(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for i, c in enumerate(columns[1:], 1):
        out = F.when(F.col("fold") == i, c).otherwise(out)
    return out


def logged(df: DataFrame, column: str) -> Propensity:
    if column not in df.columns:
        raise ValueError(f"missing propensity column: {column}")
    if not df.filter(bad_propensity(F.col(column))).isEmpty():
        raise ValueError(f"propensity column {column} must be in (0, 1] and without NaN")
    return Propensity(F.col(column).cast("double"), None, "logged", column)


def estimated(df: DataFrame, features: Sequence[str], action: str, space: Sequence) -> Propensity:
    p = fit_behavior(df, features, action).probs_over(space)
    return Propensity(take_probability_or(p, F.col(action), space), p, "estimated", None, (ESTIMATED,))


def resolve_propensity(df: DataFrame, source: str, column: str | None, features: Sequence[str], action: str, space: Sequence) -> Propensity:
    """logged (strict), estimated, or auto: logged where present and valid."""
    if source == "logged":
        if column is None:
            raise ValueError("propensity_source='logged' needs a propensity column")
        return logged(df, column)
    if source == "estimated":
        return estimated(df, features, action, space)
    if source != "auto":
        raise ValueError(f"unknown propensity_source: {source}")
    note = AUTO_MISSING
    if column is not None and column in df.columns:
        try:
            p = logged(df, column)
            return Propensity(p.pa, None, "logged", column, (AUTO_LOGGED,))
        except ValueError:
            note = AUTO_INVALID
    p = estimated(df, features, action, space)
    return Propensity(p.pa, p.pa_all, "estimated", None, (note, *p.notes))


def out_of_fold(df: DataFrame, k: int, features: Sequence[str], action: str, target: str, space: Sequence, binary: bool | None = None) -> tuple[Propensity, Column]:
    """Propensity and mu array with a model per fold, each fitted on the other folds; df has ``fold``."""
    probs = [m.probs_over(space) for m in fit_behaviors(df, features, action, k)]
    pa = by_fold([take_probability_or(p, F.col(action), space, SAFE_PROPENSITY) for p in probs])
    return Propensity(pa, None, "estimated", None, (ESTIMATED,), True), out_of_fold_outcome(df, k, features, action, target, space, binary)


def out_of_fold_outcome(df: DataFrame, k: int, features: Sequence[str], action: str, target: str, space: Sequence, binary: bool | None = None) -> Column:
    return by_fold([m.mu_array(space) for m in fit_outcomes(df, features, action, target, k, binary)])


@dataclass(frozen=True)
class OutcomePredictions:
    """mu: predictions of a target for every action of a space, as an array column of the log."""

    target: str
    mu: Column
    space: tuple
    out_of_fold: bool = False


@dataclass(frozen=True)
class NuisanceBundle:
    """Predictions that a caller holds and reuses: fitted out of fold, or from models of their own."""

    behavior: Propensity | None = None
    outcome: OutcomePredictions | None = None
    n_splits: int | None = None
    notes: tuple[str, ...] = ()


def validate_behavior_predictions(df: DataFrame, propensity: Propensity) -> None:
    """The predictions must be columns of df without missing values."""
    _validate(df, "propensity", propensity.pa)


def validate_outcome_predictions(df: DataFrame, outcome: OutcomePredictions, required_actions: Sequence | None = None, target: str | None = None) -> None:
    """The predictions must be of the target, for every required action, one for each on every row."""
    if target is not None and outcome.target != target:
        raise ValueError(f"outcome predictions are for target {outcome.target}, not {target}")
    if missing := [a for a in required_actions or () if a not in outcome.space]:
        raise ValueError(f"outcome predictions are missing actions {missing}")
    _validate(df, "outcome predictions", F.when(F.size(outcome.mu) == len(outcome.space), F.element_at(outcome.mu, 1)))


def _validate(df: DataFrame, what: str, value: Column) -> None:
    try:
        bad = df.select(value.alias("v")).filter("v IS NULL OR isnan(v)").isEmpty()
    except AnalysisException as e:
        raise ValueError(f"{what} can't be read from the log: {e.getMessage()}") from e
    if not bad:
        raise ValueError(f"{what} must have a value on every row")


def fit_crossfit_bundle(df: DataFrame, target: str, *, features: Sequence[str], action_col: str, space: Sequence, k: int = 5, binary: bool | None = None) -> NuisanceBundle:
    """Out-of-fold predictions of both models as one bundle; df has ``fold``."""
    propensity, mu = out_of_fold(df, k, features, action_col, target, space, binary)
    return NuisanceBundle(propensity, OutcomePredictions(target, mu, tuple(space), True), k, ("oof_crossfit_bundle",))


def default_space(df: DataFrame, action: str, space: Sequence | None, k: int | None = None) -> list:
    """The given space, or 0 .. k - 1; string actions need theirs stated."""
    if space is not None:
        return list(space)
    if k is not None:
        return list(range(k))
    found = observed(df, action)
    if any(isinstance(a, str) for a in found):
        raise ValueError("string actions need an explicit action_space")
    return list(range(max(found) + 1))
