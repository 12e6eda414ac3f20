"""compare_policies: contract, nuisances, point estimate, diagnostics, inference and trust in a few jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.contract import LoggedBandit, is_binary, require_columns, resolve_features
from lodestar.functions.policies import Policy, argmax_action
from lodestar.operators import bootstrap as boot
from lodestar.operators.diagnostics import (
    NuisanceDiagnostics,
    PolicyDiagnostics,
    behavior_aggregates,
    nuisance_diagnostics,
    outcome_aggregates,
    policy_diagnostics,
    roc_auc,
    weight_aggregates,
    weight_tail,
)
from lodestar.operators.estimators import MODELLED, WEIGHTED, check_method, estimate_column, score_rows
from lodestar.operators.models import Scaler, fit_outcome, fit_scaler
from lodestar.operators.nuisance import (
    NuisanceBundle,
    OutcomePredictions,
    Propensity,
    fold_column,
    out_of_fold,
    resolve_propensity,
    validate_behavior_predictions,
    validate_outcome_predictions,
)
from lodestar.operators.refit import draws, refit_replicates

#: Recommendations and the names of notes.
RECOMMENDED_ESTIMATOR = "dr"
RECOMMENDED_PROPENSITY_SOURCE_WITH_LOGGED = "auto"
RECOMMENDED_PROPENSITY_SOURCE_FALLBACK = "estimated"
RECOMMENDED_CROSSFIT_ESTIMATORS = ("dr", "sndr", "switch_dr")
NOT_REUSED = "external_nuisance_not_reused_in_bootstrap_resamples_fallback_to_internal_nuisance_fit"
FIXED_NUISANCE = "bootstrap_with_fixed_nuisances_models_not_refitted"
UNDEFINED = "undefined_bootstrap_replicates"
DIAGNOSTICS_NOTE = "diagnostics_warnings_present_review_weight_overlap_metrics"
INFERENCE_NOTE = "inference_warnings_present_ci_and_p_value_less_stable"
CROSSFIT_NOTE = "crossfit_optional_recommendation_for_bias_hardening"
UNSTABLE_NOTE = "trust_elevated_concern_unstable_importance_weights"
CROSSFIT_OVERRIDES = "crossfit_overrides_logged_propensity_source"
CAUTION = "Review diagnostics and inference warnings before making product decisions."
CONCERN = "Treat comparison as directional; improve overlap/weights or collect more representative logs."
UNSTABLE = ("low_ess_ratio", "heavy_weight_tail", "extreme_max_weight")


def trust(estimator: str, crossfit: bool, notes: Sequence[str], diagnostic: Sequence[str], inference: Sequence[str]) -> tuple[tuple[str, ...], tuple[str, ...], str, str | None]:
    """(info notes, trust notes, level, recommendation)."""
    info = list(dict.fromkeys(notes))
    about = [note for found, note in ((diagnostic, DIAGNOSTICS_NOTE), (inference, INFERENCE_NOTE)) if found]
    if estimator in RECOMMENDED_CROSSFIT_ESTIMATORS and not crossfit:
        info.append(CROSSFIT_NOTE)
    unstable = bool(set(UNSTABLE) & set(diagnostic))
    if unstable:
        about.append(UNSTABLE_NOTE)
    risk = len(diagnostic) + len(inference) + unstable
    level, advice = ("elevated_concern", CONCERN) if risk >= 3 else ("caution", CAUTION) if risk else ("ok", None)
    return tuple(info), tuple(about), level, advice


@dataclass(frozen=True)
class Comparison:
    """Values of both policies, their difference, inference, diagnostics and trust."""

    estimator: str
    target: str
    v_a: float | None
    v_b: float | None
    delta: float | None
    v_a_ci: tuple[float, float] | None = None
    v_b_ci: tuple[float, float] | None = None
    delta_ci: tuple[float, float] | None = None
    p_value: float | None = None
    is_significant: bool | None = None
    significance_rule: str | None = None
    alpha: float | None = None
    n_boot: int | None = None
    inference_method: str | None = None
    inference_warnings: tuple[str, ...] = ()
    diagnostics: PolicyDiagnostics | None = None
    notes: tuple[str, ...] = ()
    info_notes: tuple[str, ...] = ()
    diagnostic_warnings: tuple[str, ...] = ()
    trust_notes: tuple[str, ...] = ()
    trust_level: str = "ok"
    recommendation: str | None = None
    recommended_defaults: dict = field(default_factory=dict)
    propensity_source: str | None = None
    propensity_column: str | None = None
    nuisance_diagnostics: NuisanceDiagnostics | None = None

    def to_dict(self) -> dict:
        """Always the first group; the others where they are known."""
        always = {"estimator": self.estimator, "target": self.target, "V_A": self.v_a, "V_B": self.v_b, "Delta": self.delta, "diagnostics": self.diagnostics.to_dict() if self.diagnostics else {}}
        always |= {k: list(getattr(self, k)) for k in ("notes", "info_notes", "diagnostic_warnings", "trust_notes")} | {"trust_level": self.trust_level}
        optional = {"V_A_CI": self.v_a_ci, "V_B_CI": self.v_b_ci, "Delta_CI": self.delta_ci} | {k: getattr(self, k) for k in ("recommendation", "p_value", "is_significant", "significance_rule", "alpha", "n_boot", "inference_method", "propensity_source", "propensity_column")}
        optional |= {"recommended_defaults": self.recommended_defaults or None, "inference_warnings": list(self.inference_warnings) or None, "nuisance_diagnostics": self.nuisance_diagnostics.to_dict() if self.nuisance_diagnostics else None}
        return always | {k: v for k, v in optional.items() if v is not None}


def recommended_defaults(estimator: str) -> dict:
    return {
        "preferred_estimator_general_use": RECOMMENDED_ESTIMATOR,
        "preferred_propensity_mode_when_logged_available": RECOMMENDED_PROPENSITY_SOURCE_WITH_LOGGED,
        "preferred_propensity_fallback_when_logged_unavailable": RECOMMENDED_PROPENSITY_SOURCE_FALLBACK,
        "crossfit_recommended_for_estimator": estimator in RECOMMENDED_CROSSFIT_ESTIMATORS,
    }


@dataclass(frozen=True)
class Prepared:
    """A scored log with what is known about its columns."""

    scored: DataFrame
    features: tuple[str, ...]
    propensity: Propensity | None
    binary: bool
    space: tuple
    notes: tuple[str, ...]
    out_of_fold: bool = False
    scaler: Scaler | None = None


@dataclass(frozen=True)
class Columns:
    """What of a log is read, and how its nuisances come about."""

    target: str
    action_col: str
    feature_cols: Sequence[str] | None
    cluster_col: str | None
    propensity_source: str
    propensity_col: str | None
    space: tuple
    crossfit: bool = False
    k: int = 5
    seed: int = 123
    row_key: str | None = None

    def features(self, df: DataFrame) -> list[str]:
        names = {"action_col": self.action_col, "target": self.target, "propensity_col": self.propensity_col, "cluster_col": self.cluster_col}
        return resolve_features(df, self.feature_cols, **names)


def prepare(df: DataFrame, policy: Policy, method: str, c: Columns, bundle: NuisanceBundle | None = None, shared: Propensity | None = None) -> Prepared:
    """Scores a log. A bundle's predictions stand before any fit; ``shared`` is a propensity resolved before."""
    check_method(method)
    require_columns(df, (c.action_col, c.target))
    df = policy.prepare(df)
    weighted, modelled = method in WEIGHTED, method in MODELLED
    propensity, outcome = (bundle.behavior if weighted else None, bundle.outcome if modelled else None) if bundle else (shared if weighted else None, None)
    if bundle and propensity:
        validate_behavior_predictions(df, propensity)
    if outcome:
        validate_outcome_predictions(df, outcome, c.space, c.target)
    need_pa, need_mu = weighted and propensity is None, modelled and outcome is None
    crossfit = c.crossfit and bundle is None and (weighted or modelled)
    features: list[str] = []
    if need_mu or crossfit or need_pa and c.propensity_source != "logged":
        try:
            features = c.features(df)
        except ValueError:
            if need_mu or crossfit or c.propensity_source == "estimated":
                raise
    notes: tuple[str, ...] = ()
    scaler = None
    binary = modelled and is_binary(df, c.target)
    if crossfit:
        key = F.col(c.row_key) if c.row_key else F.xxhash64(*df.columns)
        df = df.withColumn("fold", fold_column(key, c.k, c.seed))
        propensity, mu = out_of_fold(df, c.k, features, c.action_col, c.target, c.space, binary if modelled else None)
        outcome = OutcomePredictions(c.target, mu, c.space, True)
        if c.propensity_source == "logged":
            notes += (CROSSFIT_OVERRIDES,)
    else:
        if need_pa:
            propensity = resolve_propensity(df, c.propensity_source, c.propensity_col, features, c.action_col, c.space)
        if need_mu:
            model = fit_outcome(df, features, c.action_col, c.target, binary)
            outcome, scaler = OutcomePredictions(c.target, model.mu_array(c.space), c.space), model.scaler
    action, mu = F.col(c.action_col), None
    if modelled:
        place = {a: i for i, a in enumerate(outcome.space)}
        mu = outcome.mu if tuple(outcome.space) == c.space else F.array(*[F.element_at(outcome.mu, place[a] + 1) for a in c.space])
    pa = propensity.pa if propensity and weighted else None
    scored = score_rows(df, reward=F.col(c.target), action=action, pb=policy.probs(), space=c.space, pa=pa, mu=mu)
    if propensity and propensity.pa_all is not None:
        scored = scored.withColumn("top1", action == argmax_action(propensity.pa_all, c.space))
    notes += propensity.notes if propensity and bundle is None else ()
    outer = bool(propensity and propensity.out_of_fold) or bool(modelled and outcome.out_of_fold)
    return Prepared(scored, tuple(features), propensity, binary, c.space, notes, outer, scaler)


def unwrap(df, target: str, action_col: str, cluster_col: str | None, propensity_col: str | None, feature_cols) -> tuple:
    """The log and names of its columns. A LoggedBandit names action and target, the cluster unless one other
    than "user_id" is given, and features and propensity unless given."""
    if not isinstance(df, LoggedBandit):
        return df, target, action_col, cluster_col, propensity_col, feature_cols
    s = df.schema
    cluster = s.cluster_col if cluster_col == "user_id" else cluster_col
    propensity = s.propensity_col if propensity_col is None else propensity_col
    return df.df, s.reward_col, s.action_col, cluster, propensity, s.feature_cols if feature_cols is None else feature_cols


def compare_policies(
    df,
    policyB: Policy,
    estimator: str = RECOMMENDED_ESTIMATOR,
    target: str = "accept",
    *,
    action_col: str = "a_A",
    feature_cols: Sequence[str] | None = None,
    cluster_col: str | None = "user_id",
    propensity_source: str = "auto",
    propensity_col: str | None = None,
    action_space: Sequence | None = None,
    with_ci: bool = True,
    n_boot: int = 300,
    alpha: float = 0.05,
    weight_clip: float | None = None,
    tau: float = 20.0,
    use_crossfit: bool = False,
    crossfit_k: int = 5,
    crossfit_seed: int = 123,
    nuisance_bundle: NuisanceBundle | None = None,
    refit: bool | None = None,
    kind: str = "multinomial",
    row_key: str | None = None,
    seed: int | None = None,
    _propensity: Propensity | None = None,
) -> Comparison:
    """Policy B against the logging policy on one target.

    df is a DataFrame or a LoggedBandit (see :func:`unwrap`).

    nuisance_bundle: predictions to use for the values and diagnostics; replicates fit their own.
    refit: fit nuisance models again in every replicate; default: wherever models are fitted, at every
    size. With False, replicates reuse the fitted models and say so.
    kind: "multinomial" (exact resampling of clusters) or "poisson". seed: another set of replicates.
    """
    df, target, action_col, cluster_col, propensity_col, feature_cols = unwrap(df, target, action_col, cluster_col, propensity_col, feature_cols)
    space = tuple(action_space if action_space is not None else policyB.action_space)
    c = Columns(target, action_col, feature_cols, cluster_col, propensity_source, propensity_col, space, use_crossfit, crossfit_k, crossfit_seed, row_key)
    p = prepare(df, policyB, estimator, c, nuisance_bundle, _propensity)
    source = p.propensity.source if p.propensity and estimator in WEIGHTED else None
    column = p.propensity.column if p.propensity else None

    aggregates: dict[str, Column] = {"v_a": estimate_column("on_policy"), "v_b": estimate_column(estimator, weight_clip, tau)}
    aggregates |= weight_aggregates(estimator, weight_clip, tau)
    if source == "estimated":
        aggregates |= behavior_aggregates("top1" in p.scored.columns)
    if estimator in MODELLED:
        aggregates |= outcome_aggregates(p.binary)
    found = p.scored.agg(*[e.alias(n) for n, e in aggregates.items()]).first().asDict()
    if estimator in WEIGHTED:
        found["weight_tail"] = weight_tail(p.scored)
    if estimator in MODELLED and p.binary:
        found["roc_auc"] = roc_auc(p.scored, "mu_logged", "r").first()["roc_auc"]
    v_a, v_b = found.pop("v_a"), found.pop("v_b")
    diagnostics = policy_diagnostics(estimator, dict(found), source, column)
    nuisance = nuisance_diagnostics(estimator, target, found, source or "unknown", p.out_of_fold, p.binary)
    out = Comparison(
        estimator,
        target,
        v_a,
        v_b,
        v_b - v_a if v_a is not None and v_b is not None else None,
        diagnostics=diagnostics,
        diagnostic_warnings=diagnostics.warnings,
        recommended_defaults=recommended_defaults(estimator),
        propensity_source=source,
        propensity_column=column,
        nuisance_diagnostics=nuisance,
    )

    warnings: tuple[str, ...] = ()
    notes = p.notes
    if with_ci:
        own = df.sparkSession.createDataFrame([(out.v_a, out.v_b, out.delta)], "v_a double, v_b double, delta double")
        point = None
        external = nuisance_bundle is not None and (nuisance_bundle.behavior or nuisance_bundle.outcome)
        if external:  # replicates can't reuse what is known of the log's own rows only
            point, p = own, prepare(df, policyB, estimator, replace(c, crossfit=False))
        fitted = p.propensity is not None and p.propensity.source == "estimated" and estimator in WEIGHTED or estimator in MODELLED
        if fitted and (refit is None or refit):
            summary = _refit_bootstrap(df, p, estimator, c, n_boot, alpha, weight_clip, tau, policyB, seed, own).first()
        else:
            summary = boot.paired_bootstrap(p.scored, estimator, cluster_col, n_boot, alpha, weight_clip, tau, kind, row_key, seed, point).first()
            if fitted:
                notes = (*notes, FIXED_NUISANCE)
        if n_boot < 200:
            warnings += (boot.FEW_REPLICATES,)
        if estimator in WEIGHTED or (use_crossfit or external) and estimator in MODELLED:
            warnings += (NOT_REUSED,)
        if summary["p_value"] is None:
            warnings += (UNDEFINED,)
        pair = lambda x: (summary[f"{x}_low"], summary[f"{x}_high"]) if summary[f"{x}_low"] is not None else None
        out = replace(
            out,
            v_a_ci=pair("v_a"),
            v_b_ci=pair("v_b"),
            delta_ci=pair("delta"),
            p_value=summary["p_value"],
            is_significant=summary["is_significant"],
            significance_rule=boot.RULE,
            alpha=alpha,
            n_boot=n_boot,
            inference_method=boot.METHOD,
            inference_warnings=warnings,
        )
    info, about, level, advice = trust(estimator, use_crossfit, notes, out.diagnostic_warnings, warnings)
    every = tuple(dict.fromkeys((*info, *out.diagnostic_warnings, *warnings, *about)))
    return replace(out, notes=every, info_notes=info, trust_notes=about, trust_level=level, recommendation=advice)


def _refit_bootstrap(df: DataFrame, p: Prepared, method: str, c: Columns, n_boot: int, alpha: float, clip: float | None, tau: float, policy: Policy, seed: int | None, point: DataFrame) -> DataFrame:
    """Replicates with models fitted again, from sums per replicate over rows that stand once with their counts."""
    space, source = list(p.space), p.propensity.source if p.propensity and method in WEIGHTED else None
    features = list(p.features) or (c.features(df) if source == "estimated" or method in MODELLED else [])
    at = F.array_position(F.array(*map(F.lit, space)), F.col(c.action_col)) - 1
    x = F.array(*(p.scaler or fit_scaler(df, features)).columns(features)) if features else F.array(F.lit(0.0))
    name = c.cluster_col if c.cluster_col in df.columns else c.row_key
    key = F.col(name) if name else F.monotonically_increasing_id()
    pa = p.propensity.pa if source == "logged" else F.lit(1.0)
    rows = df.select(key.alias("__key"), x.alias("x"), at.cast("int").alias("a"), F.col(c.target).cast("double").alias("y"), policy.probs().alias("pb"), pa.alias("pa"))
    rows = rows.filter("__key IS NOT NULL")
    rows = rows if name else boot.cut(rows)  # numbered once
    keys = boot.ranked(rows.select(F.col("__key").alias("key")).distinct(), "key")
    drawn = boot.cut(rows.join(draws(keys, n_boot, boot.salted(seed)), "__key").drop("__key"))
    v_a, v_b = refit_replicates(drawn, n_boot, len(space), max(len(features), 1), method, p.binary, source == "estimated", clip, tau)
    reps = df.sparkSession.createDataFrame(pd.DataFrame({"v_a": v_a, "v_b": v_b, "delta": v_b - v_a}), "v_a double, v_b double, delta double")
    reps = reps.select(*[F.when(~F.isnan(n), F.col(n)).alias(n) for n in reps.columns])
    return boot.paired_summary(point, reps, n_boot, alpha)


@dataclass(frozen=True)
class MultiComparison:
    """Comparisons of one estimator by target."""

    estimator: str
    results: dict[str, Comparison]

    def to_dict(self) -> dict:
        return {"estimator": self.estimator, "results": {t: r.to_dict() for t, r in self.results.items()}}


def compare_policies_multi_target(df, policyB: Policy, targets: Sequence[str], estimator: str = RECOMMENDED_ESTIMATOR, **options) -> MultiComparison:
    """One comparison per target. Where the features are given, the propensity doesn't depend on the target: it
    is resolved once for all."""
    names = {"action_col": "a_A", "cluster_col": "user_id", "propensity_col": None, "feature_cols": None} | options
    df, _, action, cluster, propensity_col, features = unwrap(df, "", names["action_col"], names["cluster_col"], names["propensity_col"], names["feature_cols"])
    options |= {"action_col": action, "cluster_col": cluster, "propensity_col": propensity_col, "feature_cols": features}
    shared, source = None, options.get("propensity_source", "auto")
    if estimator in WEIGHTED and not options.get("use_crossfit") and options.get("nuisance_bundle") is None and (features is not None or source == "logged"):
        space = tuple(options.get("action_space") or policyB.action_space)
        shared = resolve_propensity(policyB.prepare(df), source, propensity_col, list(features or ()), action, space)
    return MultiComparison(estimator, {t: compare_policies(df, policyB, estimator, t, **options, _propensity=shared) for t in targets})


def estimate_value_with_ci(df, policyB: Policy, method: str = "dr", **options) -> dict:
    """Value of B with its interval, without comparison."""
    r = compare_policies(df, policyB, method, **options)
    named = {"n_boot": r.n_boot, "alpha": r.alpha, "cluster_col": options.get("cluster_col", "user_id"), "inference_method": "percentile_bootstrap"}
    return {"method": method, "value": r.v_b, "CI": r.v_b_ci} | named


class OPEEvaluator:
    """Facade with fixed column names."""

    def __init__(self, policyB: Policy, estimator: str = RECOMMENDED_ESTIMATOR, target: str = "accept", **options) -> None:
        self.policyB, self.estimator, self.target, self.options = policyB, estimator, target, options

    def evaluate_summary(self, df) -> Comparison:
        return compare_policies(df, self.policyB, self.estimator, self.target, **self.options)

    def evaluate(self, df) -> dict:
        return self.evaluate_summary(df).to_dict()
