"""lodestar: off-policy evaluation of contextual-bandit policies on Spark DataFrames."""

from lodestar.plans.compare import (
    RECOMMENDED_CROSSFIT_ESTIMATORS,
    RECOMMENDED_ESTIMATOR,
    RECOMMENDED_PROPENSITY_SOURCE_FALLBACK,
    RECOMMENDED_PROPENSITY_SOURCE_WITH_LOGGED,
    OPEEvaluator,
    compare_policies,
    compare_policies_multi_target,
    estimate_value_with_ci,
)

__version__ = "0.2.0"
__all__ = [
    "RECOMMENDED_CROSSFIT_ESTIMATORS",
    "RECOMMENDED_ESTIMATOR",
    "RECOMMENDED_PROPENSITY_SOURCE_FALLBACK",
    "RECOMMENDED_PROPENSITY_SOURCE_WITH_LOGGED",
    "OPEEvaluator",
    "compare_policies",
    "compare_policies_multi_target",
    "estimate_value_with_ci",
]
