"""Column contract of a logged bandit table and its validation in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Feature names that win over others when features are inferred, and names never inferred.
PREFERRED_FEATURES = ("loyal", "age", "risk", "income")
RESERVED = ("user_id", "a_A", "a_B", "propensity_A")
DEFAULT_TARGETS = ("accept", "cltv")


@dataclass(frozen=True)
class BanditSchema:
    """Names of the columns of a decision log."""

    action_col: str = "a_A"
    reward_col: str = "accept"
    feature_cols: Sequence[str] | None = None
    propensity_col: str | None = None
    cluster_col: str | None = "user_id"


def bad_propensity(p: Column) -> Column:
    """True where a propensity is missing, NaN or outside (0, 1]."""
    return p.isNull() | F.isnan(p.cast("double")) | (p <= 0) | (p > 1)


def is_null_or_nan(c: Column) -> Column:
    return c.isNull() | F.isnan(c.cast("double"))


class LoggedBandit:
    """A DataFrame with its schema; column checks are free, value checks are one job."""

    def __init__(self, df: DataFrame, schema: BanditSchema) -> None:
        self.df, self.schema = df, schema
        self.validate()

    def validate(self) -> None:
        s, have = self.schema, set(self.df.columns)
        checks = [F.count(F.lit(1)).alias("n")]
        if s.propensity_col in have:
            checks.append(F.sum(bad_propensity(F.col(s.propensity_col)).cast("long")).alias("bad"))
        found = self.df.agg(*checks).first()
        if not found["n"]:
            raise ValueError("a non-empty DataFrame is required")
        for kind, name in (("action", s.action_col), ("reward", s.reward_col)):
            if name not in have:
                raise ValueError(f"missing {kind} column: {name}")
        if missing := [c for c in s.feature_cols or () if c not in have]:
            raise ValueError(f"missing feature columns: {missing}")
        if s.propensity_col is not None:
            if s.propensity_col not in have:
                raise ValueError(f"missing propensity column: {s.propensity_col}")
            if found["bad"]:
                raise ValueError(f"propensity column {s.propensity_col} must be in (0, 1] and without NaN")
        if s.cluster_col is not None and s.cluster_col not in have:
            raise ValueError(f"missing cluster column: {s.cluster_col}")

    @property
    def actions(self) -> DataFrame:
        return self.df.select(self.schema.action_col)

    @property
    def rewards(self) -> DataFrame:
        return self.df.select(self.schema.reward_col)

    @property
    def features(self) -> DataFrame:
        return self.df.select(*(self.schema.feature_cols or ()))

    @property
    def clusters(self) -> DataFrame | None:
        return self.df.select(self.schema.cluster_col) if self.schema.cluster_col else None

    @property
    def logged_propensity(self) -> DataFrame | None:
        return self.df.select(self.schema.propensity_col) if self.schema.propensity_col else None


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    if missing := sorted(c for c in names if c not in df.columns):
        raise ValueError(f"required columns are missing: {missing}")


def infer_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric and boolean columns besides the excluded ones, in order."""
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in exclude]


def resolve_features(df: DataFrame, feature_cols: Sequence[str] | None, *, action_col: str, target: str | None = None, propensity_col: str | None = None, cluster_col: str | None = None) -> list[str]:
    """The explicit list, or the inferred one: preferred names if any is there; else all but the default targets."""
    if feature_cols is not None:
        require_columns(df, feature_cols)
        if not feature_cols:
            raise ValueError("the list of features is empty")
        return list(feature_cols)
    exclude = {c for c in (action_col, target, propensity_col, cluster_col, *RESERVED) if c}
    exclude |= {c for c in df.columns if c.startswith("a_")}
    found = infer_features(df, tuple(exclude))
    preferred = [c for c in PREFERRED_FEATURES if c in found]
    if not (found := preferred or [c for c in found if c not in DEFAULT_TARGETS]):
        raise ValueError("no numeric feature columns found")
    return found


def is_binary(df: DataFrame, target: str) -> bool:
    """Whether the values are exactly {0, 1}; nulls and NaN make it false."""
    y = F.col(target).cast("double")
    r = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.sum((~y.isin(0.0, 1.0)).cast("int")).alias("other"), F.sum(is_null_or_nan(y).cast("int")).alias("none")).first()
    return r["lo"] == 0.0 and r["hi"] == 1.0 and not r["other"] and not r["none"]
