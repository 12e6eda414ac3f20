"""Bootstrap as weighted aggregation: per-cluster sums times multiplicities, never copies of rows.

Draws are hashes of (replicate, slot), so they don't depend on partitioning and SQL can repeat them:
slot s of replicate b draws the cluster whose rank (in sorted order) is v mod m, v being the first 32
bits of md5("b|s"), after "seed|" where a seed is given. The multinomial table has B * m rows before
grouping, which are shuffled: exact resampling, for up to some 10^9 draws. ``poisson`` draws a Poisson(1)
multiplicity per (replicate, cluster) instead, by a hash beside each cluster's sums: it needs no ranks and
moves nothing but one partial sum per task and replicate, so it is the choice for very many clusters.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators.estimators import finalise, statistics

RULE = "centered_paired_bootstrap_p_value_lt_alpha"
METHOD = "paired_percentile_bootstrap+centered_delta_test"
FEW_REPLICATES = "low_n_boot_p_value_may_be_unstable"


def hash32(text: Column) -> Column:
    """First 32 bits of md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share: the one the caller set, else ``spark.checkpoint.dir``.

    Where neither is set and all of Spark is one local process (tests), it is a temporary folder of this
    machine, removed at exit; on a cluster that would lose rows, so there it is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            local = tempfile.mkdtemp(prefix="lodestar-")
            atexit.register(shutil.rmtree, local, True)
            folder = "file://" + local
        context.setCheckpointDir(folder)
    return df.checkpoint()


def placed(df: DataFrame, key: str) -> DataFrame:
    """df sorted by range, with ``__part`` (the range) and ``__at`` (the place in it)."""
    out = cut(df.orderBy(key).withColumn("__at", F.monotonically_increasing_id()))
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    return out.withColumn("__part", part).withColumn("__at", at)


def ranked(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """df with the rank from 0 of each row in the order of key: sorted by range, plus one offset per partition."""
    rows = placed(df, key)
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))  # a row per partition
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def cumulative(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before each in the order of key; no task sees more than one range."""
    rows = placed(df, key)
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("__part").agg(F.sum(value).alias("t"))
    offsets = totals.select("__part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("__before"))  # a row per partition
    inside = F.coalesce(F.sum(value).over(W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    summed = rows.withColumn("__inside", inside).join(F.broadcast(offsets), "__part")
    return summed.withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__at", "__before", "__inside")


def quantiles(df: DataFrame, value: Column, points: Sequence[float]) -> list[float | None]:
    """Exact linear-interpolated quantiles: equal values are counted first, then ranked by range."""
    counted = df.select(value.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    below = cut(cumulative(counted, "v", "n", "below"))
    total = below.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(points)
    ranks = sorted({r for p in points for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))})
    needed = reduce(lambda a, b: a | b, [(F.col("below") <= r) & (F.col("below") + F.col("n") > r) for r in ranks])
    found = below.filter(needed).collect()  # at most two values a point
    at = {r: next(x["v"] for x in found if x["below"] <= r < x["below"] + x["n"]) for r in ranks}
    place = [p * (total - 1) for p in points]
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in place]


def multinomial_counts(spark, m: int, n_boot: int, salt: str = "") -> DataFrame:
    """(b, rank, cnt): how often each replicate draws each of m clusters."""
    draws = spark.range(0, m * n_boot).select((F.floor(F.col("id") / m) + 1).alias("b"), F.pmod("id", F.lit(m)).alias("slot"))
    rank = F.pmod(hash32(F.concat(F.lit(salt), F.col("b").cast("string"), F.lit("|"), F.col("slot").cast("string"))), F.lit(m))
    return draws.select("b", rank.alias("rank")).groupBy("b", "rank").agg(F.count(F.lit(1)).alias("cnt"))


def poisson_counts(stats: DataFrame, key: str, n_boot: int, salt: str = "") -> DataFrame:
    """stats per replicate with a Poisson(1) multiplicity by inversion of a hashed uniform; rows of multiplicity 0 are absent."""
    each = stats.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    u = hash32(F.concat(F.lit(f"{salt}p"), F.col("b").cast("string"), F.lit("|"), F.col(key).cast("string"))) / float(1 << 32)
    total, cnt = 0.0, F.lit(0)
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cnt = cnt + (u >= total).cast("int")
    return each.withColumn("cnt", cnt).filter("cnt > 0")


def cluster_sums(scored: DataFrame, cluster: str | None, sums: dict[str, Column], row_key: str | None = None) -> DataFrame:
    """(key, the sums) per cluster, or per row where there is no cluster column. Rows without a row key are
    ordered by hashes of their sums: rows that tie have the same sums, so draws don't depend on partitioning."""
    if cluster is None or cluster not in scored.columns:
        rows = scored.select(*([F.col(row_key).alias("key")] if row_key else []), *[v.alias(k) for k, v in sums.items()])
        return rows if row_key else rows.withColumn("key", F.struct(F.xxhash64(*sums), F.xxhash64(F.lit(1), *sums)))
    return scored.filter(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("key")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def replicates(stats: DataFrame, names: Sequence[str], n_boot: int, kind: str = "multinomial", salt: str = "") -> DataFrame:
    """(b, the sums) of each replicate; stats: one row per key."""
    if kind == "poisson":
        if dict(stats.dtypes)["key"].startswith("struct"):
            raise ValueError("Poisson multiplicities of rows need a row_key that tells rows apart")
        drawn = poisson_counts(stats, "key", n_boot, salt)
    else:
        indexed = ranked(stats, "key")
        drawn = indexed.join(multinomial_counts(stats.sparkSession, stats.count(), n_boot, salt), "rank")
    return drawn.groupBy("b").agg(*[F.sum(F.col(c) * F.col("cnt")).alias(c) for c in names])


def percentile_interval(values: Column, alpha: float) -> Column:
    """Linear-interpolated quantiles; null if a replicate is undefined."""
    return F.when(F.count(values) == F.count(F.lit(1)), F.percentile(values, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))))


def salted(seed: int | None) -> str:
    """What a seed puts before the text of every draw; none for the default draws."""
    return "" if seed is None else f"{seed}|"


def scalar_bootstrap(scored: DataFrame, method: str, cluster: str | None, n_boot: int = 300, alpha: float = 0.05, clip: float | None = None, tau: float = 20.0, kind: str = "multinomial", row_key: str | None = None, seed: int | None = None) -> DataFrame:
    """One row: value, ci_low, ci_high of one estimator with fixed nuisances."""
    sums = statistics(method, clip, tau)
    stats = cut(cluster_sums(scored, cluster, sums, row_key))
    point = stats.agg(*[F.sum(k).alias(k) for k in sums]).select(finalise(method, {k: F.col(k) for k in sums}).alias("value"))
    reps = replicates(stats, list(sums), n_boot, kind, salted(seed)).select(finalise(method, {k: F.col(k) for k in sums}).alias("v"))
    ci = reps.agg(percentile_interval(F.col("v"), alpha).alias("ci"))
    return point.crossJoin(ci).select("value", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))  # one row each


def paired_bootstrap(scored: DataFrame, method: str, cluster: str | None, n_boot: int = 300, alpha: float = 0.05, clip: float | None = None, tau: float = 20.0, kind: str = "multinomial", row_key: str | None = None, seed: int | None = None, point: DataFrame | None = None) -> DataFrame:
    """One row: v_a, v_b, delta with intervals from the same resamples, p_value and significance.

    point: (v_a, v_b, delta) if the values aren't those of the scored rows."""
    parts = {"a": statistics("on_policy"), "b": statistics(method, clip, tau)}
    sums = {f"{p}_{k}": v for p, own in parts.items() for k, v in own.items()}
    stats = cut(cluster_sums(scored, cluster, sums, row_key))

    def values(df: DataFrame) -> DataFrame:
        own = {p: {k: F.col(f"{p}_{k}") for k in parts[p]} for p in parts}
        out = df.select(finalise("on_policy", own["a"]).alias("v_a"), finalise(method, own["b"]).alias("v_b"))
        return out.withColumn("delta", F.col("v_b") - F.col("v_a"))

    point = values(stats.agg(*[F.sum(k).alias(k) for k in sums])) if point is None else point
    return paired_summary(point, values(replicates(stats, list(sums), n_boot, kind, salted(seed))), n_boot, alpha)


def paired_summary(point: DataFrame, reps: DataFrame, n_boot: int, alpha: float) -> DataFrame:
    joined = reps.toDF("ra", "rb", "rd").crossJoin(F.broadcast(point))  # one point row
    far = (F.abs(F.col("rd") - F.col("delta")) >= F.abs("delta")).cast("int")
    defined = (F.count("rd") == F.count(F.lit(1))) & F.first("delta").isNotNull()
    out = joined.withColumn("far", far).groupBy("v_a", "v_b", "delta").agg(
        *[percentile_interval(F.col(c), alpha).alias(f"ci_{n}") for c, n in (("ra", "a"), ("rb", "b"), ("rd", "d"))],
        F.when(defined, F.least((F.sum("far") + 1) / F.lit(n_boot + 1.0), F.lit(1.0))).alias("p_value"),
    )
    flat = [F.col(f"ci_{n}")[i].alias(f"{'v_' if n != 'd' else ''}{'delta' if n == 'd' else n}_{s}") for n in "abd" for i, s in enumerate(("low", "high"))]
    return out.select("v_a", "v_b", "delta", *flat, "p_value", (F.col("p_value") < alpha).alias("is_significant"))


def _resampled(df: DataFrame, estimator: Callable[[pd.DataFrame], Sequence[float]], names: Sequence[str], cluster: str | None, n_boot: int, max_rows: int, seed: int | None) -> tuple[DataFrame, DataFrame]:
    """(the values of the table, those of each replicate) of a function of a pandas frame; NaN becomes null."""
    if df.count() > max_rows:
        raise ValueError(f"opaque estimators need whole resamples in memory; the table has more than {max_rows} rows")
    key = cluster if cluster in df.columns else "__row"
    rows = cut(df if key == cluster else df.withColumn("__row", F.monotonically_increasing_id()))  # numbered once
    keys = ranked(rows.select(key).distinct(), key)
    counts = multinomial_counts(df.sparkSession, keys.count(), n_boot, salted(seed)).join(keys, "rank").select("b", key, "cnt")
    whole = keys.select(F.lit(0).cast("long").alias("b"), key, F.lit(1).cast("long").alias("cnt"))
    columns = df.columns

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.loc[pdf.index.repeat(pdf["cnt"]), columns].reset_index(drop=True)
        return pd.DataFrame([[int(pdf["b"].iloc[0]), *map(float, estimator(own))]], columns=["b", *names])

    reps = cut(rows.join(whole.union(counts), key).groupBy("b").applyInPandas(one, "b long, " + ", ".join(f"{n} double" for n in names)))
    values = [F.when(~F.isnan(n), F.col(n)).alias(n) for n in names]
    return reps.filter("b = 0").select(*values), reps.filter("b > 0").select(*values)


def bootstrap_callable(df: DataFrame, estimator: Callable[[pd.DataFrame], float], cluster: str | None, n_boot: int = 300, alpha: float = 0.05, max_rows: int = 5_000_000, seed: int | None = None) -> DataFrame:
    """Value and interval of an arbitrary function of a pandas frame: one task per replicate, so the
    table must be small (at most ``max_rows`` rows, else ValueError)."""
    point, reps = _resampled(df, lambda x: [estimator(x)], ["v"], cluster, n_boot, max_rows, seed)
    ci = reps.agg(percentile_interval(F.col("v"), alpha).alias("ci"))
    return point.select(F.col("v").alias("value")).crossJoin(ci).select("value", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def cluster_bootstrap_ci(df: DataFrame, estimator: Callable[[pd.DataFrame], float], cluster_col: str | None = "user_id", n_boot: int = 300, alpha: float = 0.05, rng_seed: int = 1234) -> tuple:
    """(value, low, high) of an arbitrary function of a pandas frame."""
    return tuple(bootstrap_callable(df, estimator, cluster_col, n_boot, alpha, seed=rng_seed).first())


def paired_bootstrap_ci(df: DataFrame, estimator_pair: Callable[[pd.DataFrame], Sequence[float]], cluster_col: str | None = "user_id", n_boot: int = 300, alpha: float = 0.05, rng_seed: int = 4321) -> dict:
    """The paired comparison of an arbitrary function of a pandas frame that gives (V_A, V_B, Delta), as a flat dict."""
    point, reps = _resampled(df, estimator_pair, ["v_a", "v_b", "delta"], cluster_col, n_boot, 5_000_000, rng_seed)
    r = paired_summary(point, reps, n_boot, alpha).first()
    pair = lambda c: (r[f"{c}_low"], r[f"{c}_high"]) if r[f"{c}_low"] is not None else None
    out = {"V_A": r["v_a"], "V_A_CI": pair("v_a"), "V_B": r["v_b"], "V_B_CI": pair("v_b"), "Delta": r["delta"], "Delta_CI": pair("delta")}
    out |= {"p_value": r["p_value"], "is_significant": r["is_significant"], "significance_rule": RULE, "alpha": alpha, "n_boot": n_boot}
    return out | {"inference_method": METHOD, "inference_warnings": [FEW_REPLICATES] if n_boot < 200 else []}
