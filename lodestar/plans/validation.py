"""Repeated synthetic experiments against the oracle, and their aggregate by mode and estimator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.policies import make_policy
from lodestar.plans.compare import compare_policies
from lodestar.sources.synthetic import SynthConfig, SyntheticEnvironment


@dataclass(frozen=True)
class ValidationMode:
    name: str
    propensity_source: str = "auto"
    propensity_col: str | None = None
    use_crossfit: bool = False
    weight_clip: float | None = None


#: The modes that run by default.
DEFAULT_MODES = (
    ValidationMode("estimated_default", "estimated"),
    ValidationMode("logged_auto", "auto", "propensity_A"),
    ValidationMode("crossfit_estimated", "estimated", use_crossfit=True),
    ValidationMode("estimated_clip20", "estimated", weight_clip=20.0),
)

#: The record of a run.
RUN_SCHEMA = (
    "run_id int, seed int, estimator string, mode string, oracle_v_a double, oracle_v_b double, oracle_delta double, "
    "v_a_hat double, v_b_hat double, delta_hat double, v_b_bias double, delta_bias double, abs_delta_error double, "
    "delta_ci_low double, delta_ci_high double, delta_ci_covers_oracle boolean, is_significant boolean, p_value double, "
    "propensity_source_used string, propensity_column_used string, trust_level string, ess_ratio double, weight_p99 double, "
    "behavior_log_loss double, outcome_log_loss double, outcome_rmse double"
)


@dataclass(frozen=True)
class ValidationResult:
    config: dict
    run_rows: DataFrame
    aggregate: DataFrame

    def to_dict(self) -> dict:
        return {"config": self.config, "run_rows": [r.asDict() for r in self.run_rows.collect()], "aggregate": [r.asDict() for r in self.aggregate.collect()]}


def aggregate_runs(rows: DataFrame) -> DataFrame:
    """By mode and estimator (nulls are a group): errors, coverage, significance and mean diagnostics.

    The names of the columns are fixed values."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    grouped = rows.groupBy("mode", "estimator").agg(
        F.count("run_id").alias("runs"),
        F.avg("v_b_bias").alias("v_b_bias_mean"),
        F.stddev_samp("v_b_hat").alias("v_b_std"),
        rmse("v_b_bias").alias("v_b_rmse"),
        F.avg("delta_bias").alias("delta_bias_mean"),
        F.stddev_samp("delta_hat").alias("delta_std"),
        rmse("delta_bias").alias("delta_rmse"),
        F.avg("abs_delta_error").alias("delta_abs_error_mean"),
        share("delta_ci_covers_oracle").alias("delta_ci_coverage"),
        share("is_significant").alias("significance_rate"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("ess_ratio", "weight_p99", "behavior_log_loss", "outcome_log_loss", "outcome_rmse")],
    )
    return grouped.orderBy("mode", "estimator")


def run_simulation_validation(
    spark: SparkSession,
    *,
    target: str = "accept",
    estimators: Sequence[str] = ("replay", "ips", "snips", "dm", "dr", "sndr", "switch_dr"),
    modes: Sequence[ValidationMode] = DEFAULT_MODES,
    n_runs: int = 5,
    n_users: int = 400,
    base_seed: int = 2026,
    n_boot: int = 40,
    alpha: float = 0.05,
    feature_cols: Sequence[str] = ("loyal", "age", "risk", "income"),
    cluster_col: str | None = "user_id",
    tau: float = 20.0,
    policyA_epsilon: float = 0.1,
    policyB_tau: float = 0.8,
) -> ValidationResult:
    """Runs x modes x estimators comparisons of an epsilon-greedy log with a softmax candidate.

    The defaults of the keywords are fixed values."""
    config = {"target": target, "estimators": list(estimators), "modes": [asdict(m) for m in modes], "n_runs": n_runs, "n_users": n_users, "base_seed": base_seed, "n_boot": n_boot, "alpha": alpha}
    rows = []
    for run in range(n_runs):
        seed = base_seed + run
        env = SyntheticEnvironment(spark, SynthConfig(n_users, seed=seed))
        a, b = make_policy("epsilon_greedy", seed, epsilon=policyA_epsilon), make_policy("softmax", seed + 1, tau=policyB_tau)
        logs = env.simulate_logs(a, propensity=True).cache()
        v_a, v_b = env.oracle_value(a, target=target, n_mc=2), env.oracle_value(b, target=target, n_mc=2)
        for mode in modes:
            for method in estimators:
                options = {k: v for k, v in asdict(mode).items() if k != "name"}
                r = compare_policies(
                    logs, b, method, target, feature_cols=feature_cols, cluster_col=cluster_col, n_boot=n_boot, alpha=alpha, tau=tau, row_key="user_id", **options
                )
                ci = r.delta_ci or (None, None)
                error = None if r.delta is None else r.delta - (v_b - v_a)
                nuisance = r.nuisance_diagnostics
                bias = None if r.v_b is None else r.v_b - v_b
                covers = None if ci[0] is None else bool(ci[0] <= v_b - v_a <= ci[1])
                rows.append(
                    (run, seed, method, mode.name, v_a, v_b, v_b - v_a, r.v_a, r.v_b, r.delta, bias, error, None if error is None else abs(error), *ci, covers)
                    + (r.is_significant, r.p_value, r.propensity_source, r.propensity_column, r.trust_level, r.diagnostics.weight_ess_ratio)
                    + (r.diagnostics.weight_p99, nuisance.behavior.multiclass_log_loss, nuisance.outcome.log_loss, nuisance.outcome.rmse)
                )
        logs.unpersist()
    frame = spark.createDataFrame(rows, RUN_SCHEMA)
    return ValidationResult(config, frame, aggregate_runs(frame))
