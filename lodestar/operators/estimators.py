"""Value estimators as finalisers over additive statistics.

Every estimator is a function of a few sums, so the point estimate, a replicate of the bootstrap and a
streaming total share one code path: sums per cluster are added with multiplicities and finalised.

Scored columns: r (reward), w (importance weight, unclipped), dm (sum over actions of pB mu), res
(r - mu at the logged action), match (the logged action is B's best). A null reward makes sums of
products null, as a mean over missing values is undefined; on_policy and replay skip nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12
METHODS = ("on_policy", "replay", "ips", "snips", "dm", "dr", "sndr", "switch_dr")
WEIGHTED = ("ips", "snips", "dr", "sndr", "switch_dr")
MODELLED = ("dm", "dr", "sndr", "switch_dr")


def check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unsupported method: {method}; one of {METHODS}")


def clean(c: Column) -> Column:
    """NaN as null."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def clipped(w: Column, clip: float | None) -> Column:
    return F.least(w, F.lit(float(clip))) if clip is not None else w


def dm_term(pb: Column, mu: Column) -> Column:
    return F.aggregate(F.zip_with(pb, mu, lambda p, m: p * m), F.lit(0.0), lambda a, x: a + x)


def statistics(method: str, clip: float | None = None, tau: float = 20.0) -> dict[str, Column]:
    """Row-level addends of the sums that the method's finaliser needs."""
    check_method(method)
    r, w = F.col("r"), F.col("w")
    one = F.lit(1.0)
    strict = {"n": one, "missing": r.isNull().cast("double")}
    v = clipped(w, clip)
    if method == "on_policy":
        return {"n": r.isNotNull().cast("double"), "s": F.coalesce(r, F.lit(0.0))}
    if method == "replay":
        hit = F.col("match") & r.isNotNull()
        return {"n": hit.cast("double"), "s": F.when(hit, r).otherwise(0.0)}
    if method == "ips":
        return strict | {"wr": v * r}
    if method == "snips":
        return strict | {"w": v, "wr": v * r}
    if method == "dm":
        return {"n": one, "dm": F.col("dm")}
    if method == "dr":
        return strict | {"dm": F.col("dm"), "c": v * F.col("res")}
    if method == "sndr":
        return strict | {"dm": F.col("dm"), "c": v * F.col("res"), "w": v}
    return strict | {"dm": F.col("dm"), "c": F.when(w <= tau, w).otherwise(0.0) * F.col("res")}


def finalise(method: str, s: dict[str, Column]) -> Column:
    """The estimate from the sums; null where it is undefined."""
    n = F.nullif(s["n"], F.lit(0.0))
    value = {
        "on_policy": lambda: s["s"] / n,
        "replay": lambda: s["s"] / n,
        "ips": lambda: s["wr"] / n,
        "snips": lambda: s["wr"] / (s["w"] + TINY),
        "dm": lambda: s["dm"] / n,
        "dr": lambda: (s["dm"] + s["c"]) / n,
        "sndr": lambda: s["dm"] / n + s["c"] / n / (s["w"] / n + TINY),
        "switch_dr": lambda: (s["dm"] + s["c"]) / n,
    }[method]()
    return F.when(s["missing"] == 0, value) if "missing" in s else value


def estimate_column(method: str, clip: float | None = None, tau: float = 20.0) -> Column:
    """One aggregate expression over scored rows."""
    return finalise(method, {k: F.sum(v) for k, v in statistics(method, clip, tau).items()})


def effective_sample_size(w: Column) -> Column:
    """(sum w)^2 / sum w^2; 0 without weights."""
    return F.coalesce(F.sum(w) * F.sum(w) / F.nullif(F.sum(w * w), F.lit(0.0)), F.lit(0.0))


def score_rows(df: DataFrame, *, reward: Column, action: Column, pb: Column, space: Sequence, pa: Column | None = None, mu: Column | None = None) -> DataFrame:
    """df with r, pb, pb_taken, match and, where pa and mu are given, w, mu_logged, dm and res."""
    from lodestar.functions.policies import argmax_action, take_probability

    out = df.withColumn("r", clean(reward)).withColumn("pb", pb)
    out = out.withColumn("pb_taken", take_probability(F.col("pb"), action, space)).withColumn("match", F.coalesce(action == argmax_action(F.col("pb"), space), F.lit(False)))
    if pa is not None:
        out = out.withColumn("pa", pa.cast("double")).withColumn("w", F.col("pb_taken") / F.nullif(F.col("pa"), F.lit(0.0)))
    if mu is not None:
        out = out.withColumn("mu", mu).withColumn("mu_logged", take_probability(F.col("mu"), action, space))
        out = out.withColumn("dm", dm_term(F.col("pb"), F.col("mu"))).withColumn("res", F.col("r") - F.col("mu_logged"))
    return out


def estimate(scored: DataFrame, methods: Sequence[str] = METHODS, clip: float | None = None, tau: float = 20.0) -> DataFrame:
    """One row with a column per method, in one pass."""
    return scored.agg(*[estimate_column(m, clip, tau).alias(m) for m in methods])
