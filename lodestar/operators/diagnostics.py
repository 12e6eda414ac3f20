"""Overlap, weight and model-quality diagnostics with warning flags, each an aggregate expression."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.bootstrap import cumulative, quantiles
from lodestar.operators.estimators import MODELLED, WEIGHTED, effective_sample_size

#: Thresholds and names of the flags, in order; all inequalities are strict.
FLAGS = (
    ("low_replay_overlap", "replay_overlap", "<", 0.05),
    ("low_ess_ratio", "weight_ess_ratio", "<", 0.1),
    ("extreme_max_weight", "weight_max", ">", 50.0),
    ("heavy_weight_tail", "weight_p99", ">", 20.0),
    ("large_clip_share", "clip_share", ">", 0.2),
    ("large_switch_share", "switch_share", ">", 0.2),
)
BEHAVIOR_FLAGS = (("weak_behavior_log_loss", "multiclass_log_loss", ">", 1.2), ("weak_behavior_top1_accuracy", "top1_accuracy", "<", 0.4))
BINARY_FLAGS = (("weak_outcome_log_loss", "log_loss", ">", 0.69), ("weak_outcome_brier_score", "brier_score", ">", 0.25), ("weak_outcome_roc_auc", "roc_auc", "<", 0.6))
CONTINUOUS_FLAGS = (("weak_outcome_r2", "r2", "<", 0.0),)
NOT_APPLICABLE = "behavior_model_not_applicable_for_logged_propensity"
NO_OUTCOME = "outcome_model_not_used_for_estimator"
LOG_FLOOR = 1e-12


def raised(flags, values: dict) -> list[str]:
    """Names of the flags that the values raise; missing values raise none."""
    return [name for name, key, sign, limit in flags if values.get(key) is not None and (values[key] < limit if sign == "<" else values[key] > limit)]


def flags_column(flags, columns: dict[str, Column]) -> Column:
    """The same as an array column."""
    tests = [F.when(columns[key] < limit if sign == "<" else columns[key] > limit, F.lit(name)) for name, key, sign, limit in flags if key in columns]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def weight_aggregates(method: str, clip: float | None = None, tau: float | None = None) -> dict[str, Column]:
    """Aggregates over scored rows; weights are unclipped, missing ones count as 0. Percentiles: :func:`weight_tail`."""
    out = {"n_samples": F.count(F.lit(1)), "replay_overlap": F.avg(F.col("match").cast("double"))}
    if method in WEIGHTED:
        w = weight_column()
        ess = effective_sample_size(w)
        out |= {"weight_ess": ess, "weight_ess_ratio": ess / F.greatest(F.count(F.lit(1)), F.lit(1)), "weight_max": F.max(w)}
        if clip is not None and method in ("ips", "snips", "dr", "sndr"):
            out["clip_share"] = F.avg((w > clip).cast("double"))
        if method == "switch_dr":
            out["switch_share"] = F.avg((w > tau).cast("double"))
    return out


def behavior_aggregates(has_all: bool) -> dict[str, Column]:
    out = {"multiclass_log_loss": F.avg(-F.log(F.least(F.greatest("pa", F.lit(LOG_FLOOR)), F.lit(1.0)))), "mean_logged_action_prob": F.avg("pa")}
    if has_all:
        out["top1_accuracy"] = F.avg(F.col("top1").cast("double"))
    return out


def outcome_aggregates(binary: bool) -> dict[str, Column]:
    y, m = F.col("r"), F.col("mu_logged")
    if binary:
        p = F.least(F.greatest(m, F.lit(LOG_FLOOR)), F.lit(1 - LOG_FLOOR))
        return {"log_loss": -F.avg(y * F.log(p) + (1 - y) * F.log(1 - p)), "brier_score": F.avg((m - y) * (m - y))}
    e = y - m
    return {"rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "r2": 1 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))}


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``roc_auc``: rank-sum with half credit for ties; null with one class. Equal scores are one
    group, and groups are summed up in ranges of their order, so no scores, however alike, meet in one task."""
    groups = df.groupBy(F.col(score).alias("s")).agg(F.sum((F.col(label) == 1).cast("double")).alias("pos"), F.sum((F.col(label) == 0).cast("double")).alias("neg"))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return cumulative(groups, "s", "neg", "below").agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("roc_auc"))


def weight_column() -> Column:
    """Unclipped weights; missing ones count as 0."""
    return F.coalesce(F.when(~F.isnan("w"), F.col("w")), F.lit(0.0))


def weight_tail(scored: DataFrame) -> tuple[float | None, float | None]:
    """The exact 95th and 99th percentiles of the weights of scored rows."""
    return tuple(quantiles(scored, weight_column(), (0.95, 0.99)))


@dataclass(frozen=True)
class PolicyDiagnostics:
    method: str
    n_samples: int
    replay_overlap: float | None
    replay_coverage: float | None
    weight_ess: float | None = None
    weight_ess_ratio: float | None = None
    weight_max: float | None = None
    weight_p95: float | None = None
    weight_p99: float | None = None
    clip_share: float | None = None
    switch_share: float | None = None
    warnings: tuple[str, ...] = ()
    propensity_source: str | None = None
    propensity_column: str | None = None

    def to_dict(self) -> dict:
        return asdict(self) | {"warnings": list(self.warnings)}


@dataclass(frozen=True)
class BehaviorDiagnostics:
    applicable: bool
    propensity_source: str
    is_out_of_fold: bool = False
    multiclass_log_loss: float | None = None
    top1_accuracy: float | None = None
    mean_logged_action_prob: float | None = None
    warnings: tuple[str, ...] = ()

    def to_dict(self) -> dict:
        return asdict(self) | {"warnings": list(self.warnings)}


@dataclass(frozen=True)
class OutcomeDiagnostics:
    applicable: bool
    target: str
    is_binary_target: bool = False
    is_out_of_fold: bool = False
    log_loss: float | None = None
    brier_score: float | None = None
    roc_auc: float | None = None
    rmse: float | None = None
    mae: float | None = None
    r2: float | None = None
    warnings: tuple[str, ...] = ()

    def to_dict(self) -> dict:
        return asdict(self) | {"warnings": list(self.warnings)}


@dataclass(frozen=True)
class NuisanceDiagnostics:
    behavior: BehaviorDiagnostics
    outcome: OutcomeDiagnostics
    warnings: tuple[str, ...] = field(default=())

    def to_dict(self) -> dict:
        return {"behavior": self.behavior.to_dict(), "outcome": self.outcome.to_dict(), "warnings": list(self.warnings)}


def policy_diagnostics(method: str, found: dict, source: str | None, column: str | None) -> PolicyDiagnostics:
    tail = found.pop("weight_tail", None) or (None, None)
    values = {k: found.get(k) for k in ("replay_overlap", "weight_ess", "weight_ess_ratio", "weight_max", "clip_share", "switch_share")} | {"weight_p95": tail[0], "weight_p99": tail[1]}
    return PolicyDiagnostics(method, found["n_samples"], replay_coverage=values["replay_overlap"], warnings=tuple(raised(FLAGS, values)), propensity_source=source, propensity_column=column, **values)


def nuisance_diagnostics(method: str, target: str, found: dict, source: str, out_of_fold: bool, binary: bool) -> NuisanceDiagnostics:
    if source in ("estimated", "auto"):
        values = {k: found.get(k) for k in ("multiclass_log_loss", "top1_accuracy", "mean_logged_action_prob")}
        behavior = BehaviorDiagnostics(True, source, out_of_fold, warnings=tuple(raised(BEHAVIOR_FLAGS, values)), **values)
    else:
        behavior = BehaviorDiagnostics(False, source, warnings=(NOT_APPLICABLE,))
    if method in MODELLED:
        values = {k: found.get(k) for k in ("log_loss", "brier_score", "roc_auc", "rmse", "mae", "r2")}
        outcome = OutcomeDiagnostics(True, target, binary, out_of_fold, warnings=tuple(raised(BINARY_FLAGS if binary else CONTINUOUS_FLAGS, values)), **values)
    else:
        outcome = OutcomeDiagnostics(False, target, binary, warnings=(NO_OUTCOME,))
    return NuisanceDiagnostics(behavior, outcome, behavior.warnings + outcome.warnings)
