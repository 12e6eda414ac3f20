"""Bandit views over the test tables, and one query per operator with its DuckDB oracle.

View E: events as decisions. Action: event_type; reward: value; context: k of props in cells of 20;
logged propensity: frequency of the action in its cell; candidate: 0.8 on the action at place k mod 5,
0.05 on each other. View L: lineitem with action l_returnflag, cluster l_orderkey.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.contract import BanditSchema, LoggedBandit, bad_propensity, infer_features, is_binary, is_null_or_nan
from lodestar.functions import policies as P
from lodestar.operators import bootstrap as B
from lodestar.operators import diagnostics as D
from lodestar.operators import estimators as E
from lodestar.operators.models import fit_behavior, fit_binary, fit_linear, fit_outcome, fit_scaler
from lodestar.operators.nuisance import estimated, fold_column, out_of_fold_outcome, resolve_propensity
from lodestar.plans import compare as C
from lodestar.plans.report import log_profile
from lodestar.plans.validation import aggregate_runs
from lodestar.sources.synthetic import ACCEPT, UPLIFT, SynthConfig, SyntheticEnvironment

SPACE = ("click", "error", "purchase", "signup", "view")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c) + F.lit(0.0), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(x: str, digits: int = 6) -> str:
    return f"round({x} + 0.0, {digits})"


# views


def view_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, a, r, k, cx, ab (B's best action), pa; the cell table has at most cells x actions rows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("event_type").alias("a"), F.col("value").alias("reward"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumn("cx", F.floor(F.col("k") / 20).cast("int")).withColumn("ab", F.element_at(P.action_array(SPACE), F.pmod("k", F.lit(5)) + 1))
    cells = e.groupBy("cx", "a").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("cx"))  # over the few cells, so that they are counted once
    cells = cells.select("cx", "a", (F.col("n") / total).alias("p_logged"))
    return e.join(F.broadcast(cells), ["cx", "a"])


def policy_b() -> P.Policy:
    return P.ColumnPolicy(lambda: F.transform(P.action_array(SPACE), lambda x: F.when(x == F.col("ab"), 0.8).otherwise(0.05)), SPACE)


def scored_e(spark: SparkSession, sf_dir: str, mu=None, reward: str = "reward") -> DataFrame:
    e = view_e(spark, sf_dir)
    return E.score_rows(e, reward=F.col(reward), action=F.col("a"), pb=policy_b().probs(), space=SPACE, pa=F.col("p_logged"), mu=mu(e) if mu else None)


def scored_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_e(spark, sf_dir, lambda e: fit_linear(e, ["k"], "a", "reward").mu_array(SPACE))


E_SQL = """
e0 AS (SELECT event_id, user_id, event_type AS a, value AS r, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
e1 AS (SELECT *, CAST(floor(k / 20.0) AS INTEGER) AS cx, (['click', 'error', 'purchase', 'signup', 'view'])[k % 5 + 1] AS ab FROM e0),
cell AS (SELECT cx, a, count(*) AS n FROM e1 GROUP BY cx, a),
tot AS (SELECT cx, count(*) AS n FROM e1 GROUP BY cx),
s AS (SELECT e1.*, CAST(cell.n AS DOUBLE) / tot.n AS pa, CASE WHEN e1.a = ab THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS pbt, e1.a = ab AS match,
  CASE WHEN e1.a = ab THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END / (CAST(cell.n AS DOUBLE) / tot.n) AS w
  FROM e1 JOIN cell ON e1.cx = cell.cx AND e1.a = cell.a JOIN tot ON e1.cx = tot.cx)"""
#: Least squares with dummies on one feature: pooled slope, and an intercept per action.
OLS_SQL = """
g AS (SELECT a, avg(k) AS mx, avg(r) AS my, covar_pop(k, r) * count(*) AS sxy, var_pop(k) * count(*) AS sxx FROM s GROUP BY a),
sl AS (SELECT sum(sxy) / sum(sxx) AS b FROM g),
ic AS (SELECT a, my - b * mx AS i FROM g, sl),
t AS (SELECT s.*, ic.i + b * k AS mul, 0.75 * icb.i + 0.05 * (SELECT sum(i) FROM ic) + b * k AS dm, r - (ic.i + b * k) AS res
  FROM s JOIN ic ON s.a = ic.a JOIN ic icb ON s.ab = icb.a CROSS JOIN sl)"""


def sql_e(select: str, more: str = "") -> str:
    return f"WITH {E_SQL}{',' + more if more else ''} {select}"


# estimators


@query(sql_e(f"SELECT {R('avg(r)')} AS value FROM s"))
def on_policy(spark, d):
    return rounded(scored_e(spark, d).agg(E.estimate_column("on_policy").alias("value")))


@query(sql_e(f"SELECT {R('avg(r) FILTER (match)')} AS value, count(*) FILTER (match) AS n_match FROM s"))
def replay(spark, d):
    return rounded(scored_e(spark, d).agg(E.estimate_column("replay").alias("value"), F.sum(F.col("match").cast("long")).alias("n_match")))


@query(sql_e(f"SELECT {R('avg(w * r)')} AS value FROM s"))
def ips(spark, d):
    return rounded(scored_e(spark, d).agg(E.estimate_column("ips").alias("value")))


@query(sql_e(f"SELECT {R('avg(least(w, 3.0) * r)')} AS value, {R('avg(CAST(w > 3.0 AS INTEGER))')} AS clip_share, {R('sum(least(w, 3.0)) * sum(least(w, 3.0)) / sum(least(w, 3.0) * least(w, 3.0))')} AS ess FROM s"))
def ips_clip(spark, d):
    return rounded(scored_e(spark, d).agg(E.estimate_column("ips", 3.0).alias("value"), F.avg((F.col("w") > 3.0).cast("double")).alias("clip_share"), E.effective_sample_size(E.clipped(F.col("w"), 3.0)).alias("ess")))


@query(sql_e(f"SELECT {R('sum(w * r) / (sum(w) + 1e-12)')} AS value FROM s"))
def snips(spark, d):
    return rounded(scored_e(spark, d).agg(E.estimate_column("snips").alias("value")))


@query(sql_e(f"SELECT {R('sum(w) * sum(w) / sum(w * w)')} AS ess FROM s"))
def ess(spark, d):
    return rounded(scored_e(spark, d).agg(E.effective_sample_size(F.col("w")).alias("ess")))


@query(sql_e(" UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS clip, {R(f'avg(least(w, {c}) * r)')} AS ips, {R(f'sum(least(w, {c}) * r) / (sum(least(w, {c})) + 1e-12)')} AS snips, {R(f'avg(CAST(w > {c} AS INTEGER))')} AS clip_share FROM s" for c in (1.0, 2.0, 4.0, 8.0))))
def clip_share_sweep(spark, d):
    s, clips = scored_e(spark, d), (1.0, 2.0, 4.0, 8.0)
    found = s.agg(*[F.struct(F.lit(c).alias("clip"), E.estimate_column("ips", c).alias("ips"), E.estimate_column("snips", c).alias("snips"), F.avg((F.col("w") > c).cast("double")).alias("clip_share")).alias(f"c{i}") for i, c in enumerate(clips)])
    return rounded(found.select(F.explode(F.array(*[f"c{i}" for i in range(len(clips))])).alias("x")).select("x.*"))


@query(sql_e(f"SELECT {R('sum(b)')} AS slope, a AS action, {R('any_value(i)')} AS intercept FROM ic, sl GROUP BY a", OLS_SQL))
def ols_mu_fit(spark, d):
    m = fit_linear(view_e(spark, d), ["k"], "a", "reward")
    at = {f: i for i, f in enumerate(m.features)}["k"]
    slope = m.slopes[at] / m.scaler.scale[at]
    rows = [(slope, a, m.intercept + e - slope * m.scaler.mean[at]) for a, e in zip(m.actions, m.effects)]
    return rounded(spark.createDataFrame(rows, "slope double, action string, intercept double"))


@query(sql_e(f"SELECT {R('avg(dm)')} AS value FROM t", OLS_SQL))
def dm(spark, d):
    return rounded(scored_ols(spark, d).agg(E.estimate_column("dm").alias("value")))


@query(sql_e(f"SELECT {R('avg(dm + w * res)')} AS value FROM t", OLS_SQL))
def dr(spark, d):
    return rounded(scored_ols(spark, d).agg(E.estimate_column("dr").alias("value")))


@query(sql_e(f"SELECT {R('avg(dm + least(w, 3.0) * res)')} AS value FROM t", OLS_SQL))
def dr_clip(spark, d):
    return rounded(scored_ols(spark, d).agg(E.estimate_column("dr", 3.0).alias("value")))


@query(sql_e(f"SELECT {R('avg(dm) + avg(w * res) / (avg(w) + 1e-12)')} AS value FROM t", OLS_SQL))
def sndr(spark, d):
    return rounded(scored_ols(spark, d).agg(E.estimate_column("sndr").alias("value")))


@query(sql_e(f"SELECT {R('avg(dm + CASE WHEN w <= 2.0 THEN w ELSE 0 END * res)')} AS value, {R('avg(CAST(w > 2.0 AS INTEGER))')} AS switch_share FROM t", OLS_SQL))
def switch_dr(spark, d):
    return rounded(scored_ols(spark, d).agg(E.estimate_column("switch_dr", tau=2.0).alias("value"), F.avg((F.col("w") > 2.0).cast("double")).alias("switch_share")))


@query(sql_e(" UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS tau, {R(f'avg(dm + CASE WHEN w <= {c} THEN w ELSE 0 END * res)')} AS value FROM t" for c in (0.2, 1.0, 4.0, 20.0)), OLS_SQL))
def switch_tau_sweep(spark, d):
    s, taus = scored_ols(spark, d), (0.2, 1.0, 4.0, 20.0)
    found = s.agg(*[F.struct(F.lit(c).alias("tau"), E.estimate_column("switch_dr", tau=c).alias("value")).alias(f"c{i}") for i, c in enumerate(taus)])
    return rounded(found.select(F.explode(F.array(*[f"c{i}" for i in range(len(taus))])).alias("x")).select("x.*"))


@query(sql_e(f"SELECT {R('avg(r)')} AS v_a, {R('avg(r) FILTER (match)')} AS replay, {R('avg(w * r)')} AS ips, {R('sum(w * r) / (sum(w) + 1e-12)')} AS snips, {R('avg(dm)')} AS dm, {R('avg(dm + w * res)')} AS dr, {R('avg(dm) + avg(w * res) / (avg(w) + 1e-12)')} AS sndr, {R('avg(dm + CASE WHEN w <= 20 THEN w ELSE 0 END * res)')} AS switch_dr FROM t", OLS_SQL))
def all_estimators(spark, d):
    return rounded(E.estimate(scored_ols(spark, d)).withColumnRenamed("on_policy", "v_a"))


@query(sql_e(f"SELECT target, {R('avg(y)')} AS v_a, {R('avg(w * y)')} AS v_b, {R('avg(w * y) - avg(y)')} AS delta FROM (SELECT 'value' AS target, w, r AS y FROM s UNION ALL SELECT 'big', w, CAST(r > 50 AS INTEGER) FROM s) GROUP BY target"))
def multi_target(spark, d):
    e = view_e(spark, d).withColumn("value", F.col("reward")).withColumn("big", (F.col("reward") > 50).cast("double"))
    both = C.compare_policies_multi_target(e, policy_b(), ["value", "big"], "ips", action_col="a", propensity_col="p_logged", action_space=SPACE, feature_cols=["k"], with_ci=False)
    rows = [(t, r.v_a, r.v_b, r.delta) for t, r in both.results.items()]
    return rounded(spark.createDataFrame(rows, "target string, v_a double, v_b double, delta double"))


# policies


@query(f"SELECT event_id, {', '.join(f'CAST(event_type = {chr(39)}{a}{chr(39)} AS DOUBLE) AS p_{a}' for a in SPACE)} FROM events")
def policy_onehot(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    p = P.ActionColumnPolicy("event_type", SPACE)
    return p.prepare(e).select("event_id", p.probs().alias("p")).select("event_id", *[F.col("p")[i].alias(f"p_{a}") for i, a in enumerate(SPACE)])


@query(sql_e(f"SELECT event_id, {', '.join(f'CASE WHEN ab = {chr(39)}{a}{chr(39)} THEN round(CAST(0.92 AS DOUBLE), 6) ELSE round(CAST(0.02 AS DOUBLE), 6) END AS p_{a}' for a in SPACE)} FROM s"))
def policy_eps_greedy(spark, d):
    p = P.EpsilonGreedy(P.ActionColumnPolicy("ab", SPACE), 0.1).probs()
    return rounded(view_e(spark, d).select("event_id", p.alias("p")).select("event_id", *[F.col("p")[i].alias(f"p_{a}") for i, a in enumerate(SPACE)]))


_SOFT = ("exp(k / 50.0)", "exp((100 - k) / 50.0)", "exp(CAST(1.0 AS DOUBLE))")


@query(sql_e("SELECT event_id, " + ", ".join(f"{R(f'{x} / ({_SOFT[0]} + {_SOFT[1]} + {_SOFT[2]})')} AS p{i}" for i, x in enumerate(_SOFT)) + " FROM s"))
def policy_softmax(spark, d):
    p = P.softmax(F.array(F.col("k") / 100.0, (100 - F.col("k")) / 100.0, F.lit(0.5)), 0.5)
    return rounded(view_e(spark, d).select("event_id", p.alias("p")).select("event_id", *[F.col("p")[i].alias(f"p{i}") for i in range(3)]))


@query(sql_e("SELECT event_id, CASE WHEN k % 3 >= 1 AND k % 3 >= k % 2 THEN 0 WHEN k % 2 >= 1 THEN 1 WHEN k % 3 = 0 AND k % 2 = 0 THEN 0 ELSE 1 END AS best FROM s"))
def policy_argmax_ties(spark, d):
    e = view_e(spark, d)
    return e.select("event_id", P.argmax_index(F.array((F.col("k") % 3).cast("double"), (F.col("k") % 2).cast("double"))).alias("best"))


@query(sql_e("SELECT event_id, round(pbt, 6) AS pb_taken FROM s"))
def take_action_prob(spark, d):
    return rounded(scored_e(spark, d).select("event_id", F.col("pb_taken")))


# contract and propensities


@query(sql_e("SELECT count(*) AS n, CAST(sum(CAST(r IS NULL OR isnan(r) AS INTEGER)) AS BIGINT) AS missing_reward, CAST(sum(CAST(a IS NULL AS INTEGER)) AS BIGINT) AS missing_action, CAST(sum(CAST(pa IS NULL OR isnan(pa) OR pa <= 0 OR pa > 1 AS INTEGER)) AS BIGINT) AS bad_propensity, count(DISTINCT user_id) AS clusters FROM s"))
def contract_validation(spark, d):
    log = LoggedBandit(view_e(spark, d), BanditSchema("a", "reward", ("k",), "p_logged", "user_id"))  # raises on a bad log
    checks = {"missing_reward": is_null_or_nan(F.col("reward")), "missing_action": F.col("a").isNull(), "bad_propensity": bad_propensity(F.col("p_logged"))}
    sums = [F.sum(c.cast("long")).alias(n) for n, c in checks.items()]
    return log.df.agg(F.count(F.lit(1)).alias("n"), *sums, F.countDistinct(log.schema.cluster_col).alias("clusters"))


@query(f"SELECT 'l_quantity' AS feature, {R('avg(l_quantity)')} AS mean, {R('stddev_pop(l_quantity)')} AS scale FROM lineitem UNION ALL SELECT 'l_discount', {R('avg(l_discount + 0.0)')}, {R('stddev_pop(l_discount + 0.0)')} FROM lineitem UNION ALL SELECT 'l_tax', {R('avg(l_tax)')}, {R('stddev_pop(l_tax)')} FROM lineitem")
def feature_inference_profile(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    names = infer_features(li, ("l_extendedprice",))
    scaler = fit_scaler(li, names)
    return rounded(spark.createDataFrame([(c, float(m), float(x)) for c, m, x in zip(names, scaler.mean, scaler.scale)], "feature string, mean double, scale double"))


@query("SELECT 'value' AS target, min(value) = 0 AND max(value) = 1 AND count(*) FILTER (value NOT IN (0, 1)) = 0 AS is_binary FROM events UNION ALL SELECT 'big', min(CAST(value > 50 AS INTEGER)) = 0 AND max(CAST(value > 50 AS INTEGER)) = 1 FROM events")
def binary_target_check(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("value", (F.col("value") > 50).cast("int").alias("big"))
    return spark.createDataFrame([(c, is_binary(e, c)) for c in ("value", "big")], "target string, is_binary boolean")


@query(sql_e(f"SELECT 'logged' AS source, 'auto_selected_logged_propensity' AS note, {R('avg(pa)')} AS mean_pa, {R('avg(w * r)')} AS ips FROM s"))
def propensity_auto_resolution(spark, d):
    e = view_e(spark, d)
    p = resolve_propensity(e, "auto", "p_logged", [], "a", SPACE)
    s = E.score_rows(e, reward=F.col("reward"), action=F.col("a"), pb=policy_b().probs(), space=SPACE, pa=p.pa)
    return rounded(s.agg(F.avg("pa").alias("mean_pa"), E.estimate_column("ips").alias("ips")).select(F.lit(p.source).alias("source"), F.lit(p.notes[0]).alias("note"), "mean_pa", "ips"))


# diagnostics


@query(sql_e(f"SELECT count(*) AS n_samples, {R('avg(CAST(match AS INTEGER))')} AS replay_overlap, {R('sum(w) * sum(w) / sum(w * w)')} AS weight_ess, {R('sum(w) * sum(w) / sum(w * w) / count(*)')} AS weight_ess_ratio, {R('max(w)')} AS weight_max, {R('quantile_cont(w, 0.95)')} AS weight_p95, {R('quantile_cont(w, 0.99)')} AS weight_p99 FROM s"))
def weight_diagnostics(spark, d):
    s = scored_e(spark, d)
    found, (p95, p99) = s.agg(*[c.alias(n) for n, c in D.weight_aggregates("ips").items()]), D.weight_tail(s)
    return rounded(found.withColumn("weight_p95", F.lit(p95)).withColumn("weight_p99", F.lit(p99)))


@query(sql_e(f"SELECT cx, count(*) AS n, {R('avg(CAST(match AS INTEGER))')} AS overlap, {R('avg(pa)')} AS mean_pa FROM s GROUP BY cx"))
def overlap(spark, d):
    return rounded(scored_e(spark, d).groupBy("cx").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("match").cast("double")).alias("overlap"), F.avg("pa").alias("mean_pa")))


_FLOOR = "CASE WHEN a = 'view' THEN CAST(0.01 AS DOUBLE) ELSE pa END"
_FLAGGED = f"""f AS (SELECT avg(CAST(match AS INTEGER)) AS o, sum(v) * sum(v) / sum(v * v) / count(*) AS er, max(v) AS mx, quantile_cont(v, 0.99) AS p99, avg(CAST(v > 2 AS INTEGER)) AS cs FROM (SELECT *, pbt / ({_FLOOR}) AS v FROM s))"""


@query(sql_e("SELECT concat_ws(',', CASE WHEN o < 0.05 THEN 'low_replay_overlap' END, CASE WHEN er < 0.1 THEN 'low_ess_ratio' END, CASE WHEN mx > 50 THEN 'extreme_max_weight' END, CASE WHEN p99 > 20 THEN 'heavy_weight_tail' END, CASE WHEN cs > 0.2 THEN 'large_clip_share' END) AS flags FROM f", _FLAGGED))
def warning_flags(spark, d):
    s = scored_e(spark, d).withColumn("w", F.col("pb_taken") / F.when(F.col("a") == "view", 0.01).otherwise(F.col("pa")))
    found = s.agg(*[c.alias(n) for n, c in D.weight_aggregates("ips", 2.0).items()]).withColumn("weight_p99", F.lit(D.weight_tail(s)[1]))
    keys = ("replay_overlap", "weight_ess_ratio", "weight_max", "weight_p99", "clip_share")
    return found.select(F.array_join(D.flags_column(D.FLAGS, {k: F.col(k) for k in keys}), ",").alias("flags"))


_TRUST = """d AS (SELECT CAST(o < 0.05 AS INTEGER) + CAST(er < 0.1 AS INTEGER) + CAST(mx > 50 AS INTEGER) + CAST(p99 > 20 AS INTEGER) + CAST(cs > 0.2 AS INTEGER) AS n, er < 0.1 OR mx > 50 OR p99 > 20 AS unstable FROM f)"""


@query(sql_e("SELECT CASE WHEN n + 1 + CAST(unstable AS INTEGER) >= 3 THEN 'elevated_concern' WHEN n + 1 + CAST(unstable AS INTEGER) > 0 THEN 'caution' ELSE 'ok' END AS trust_level, CAST(n AS BIGINT) AS n_diagnostic FROM d", _FLAGGED + "," + _TRUST))
def trust_level(spark, d):
    flags = [x for x in warning_flags(spark, d).first()["flags"].split(",") if x]
    level = C.trust("ips", False, (), flags, (C.NOT_REUSED,))[2]
    return spark.createDataFrame([(level, len(flags))], "trust_level string, n_diagnostic long")


@query(sql_e(f"SELECT {R('avg(-ln(pa))')} AS multiclass_log_loss, {R('avg(pa)')} AS mean_logged_action_prob FROM s"))
def behavior_metrics(spark, d):
    return rounded(scored_e(spark, d).agg(*[c.alias(n) for n, c in D.behavior_aggregates(False).items()]))


_P = "(0.2 + 0.6 * k / 100.0)"


@query(sql_e(f"SELECT {R(f'-avg(CASE WHEN r > 50 THEN ln({_P}) ELSE ln(1 - {_P}) END)')} AS log_loss, {R(f'avg(({_P} - CAST(r > 50 AS INTEGER)) * ({_P} - CAST(r > 50 AS INTEGER)))')} AS brier_score FROM s"))
def outcome_metrics_binary(spark, d):
    s = view_e(spark, d).select((F.col("reward") > 50).cast("double").alias("r"), (0.2 + 0.6 * F.col("k") / 100.0).alias("mu_logged"))
    return rounded(s.agg(*[c.alias(n) for n, c in D.outcome_aggregates(True).items()]))


@query(sql_e(f"SELECT {R('sqrt(avg(res * res))')} AS rmse, {R('avg(abs(res))')} AS mae, {R('1 - avg(res * res) / var_pop(r)')} AS r2 FROM t", OLS_SQL))
def outcome_metrics_continuous(spark, d):
    return rounded(scored_ols(spark, d).agg(*[c.alias(n) for n, c in D.outcome_aggregates(False).items()]))


@query(sql_e(f"SELECT {R('(sum(rk) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * (count(*) - p))')} AS roc_auc FROM (SELECT y, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS rk, sum(y) OVER () AS p FROM (SELECT k, CAST(r > 50 AS INTEGER) AS y FROM s)) GROUP BY p"))
def roc_auc(spark, d):
    return rounded(D.roc_auc(view_e(spark, d).select((F.col("k") / 100.0).alias("p"), (F.col("reward") > 50).cast("int").alias("y")), "p", "y"))


# folds and cross-fitting

_FOLD = "CAST(('0x' || substr(md5('123|' || event_id), 1, 8))::BIGINT % 5 AS INTEGER)"


@query(f"SELECT fold, count(*) AS n FROM (SELECT {_FOLD} AS fold FROM events) GROUP BY fold")
def kfold_assignment(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(fold_column(F.col("event_id"), 5).alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


_CROSS = f"""sf AS (SELECT s.*, {_FOLD} AS fold FROM s),
fg AS (SELECT j.fold, a, avg(k) AS mx, avg(r) AS my, covar_pop(k, r) * count(*) AS sxy, var_pop(k) * count(*) AS sxx FROM sf JOIN (SELECT DISTINCT fold FROM sf) j ON sf.fold <> j.fold GROUP BY j.fold, a),
fs AS (SELECT fold, sum(sxy) / sum(sxx) AS b FROM fg GROUP BY fold),
fi AS (SELECT fg.fold, a, my - b * mx AS i FROM fg JOIN fs ON fg.fold = fs.fold),
ft AS (SELECT fold, sum(i) AS si FROM fi GROUP BY fold),
ct AS (SELECT sf.*, x.i + b * k AS mul, 0.75 * y.i + 0.05 * si + b * k AS dm FROM sf JOIN fi x ON x.fold = sf.fold AND x.a = sf.a JOIN fi y ON y.fold = sf.fold AND y.a = sf.ab JOIN fs ON fs.fold = sf.fold JOIN ft ON ft.fold = sf.fold)"""


@query(sql_e(f"SELECT {R('avg(dm + w * (r - mul))')} AS value FROM ct", _CROSS))
def crossfit_ols_dr(spark, d):
    e = view_e(spark, d).withColumn("fold", fold_column(F.col("event_id"), 5))
    mu = out_of_fold_outcome(e, 5, ["k"], "a", "reward", SPACE, False)
    s = E.score_rows(e, reward=F.col("reward"), action=F.col("a"), pb=policy_b().probs(), space=SPACE, pa=F.col("p_logged"), mu=mu)
    return rounded(s.agg(E.estimate_column("dr").alias("value")))


# bootstrap


def _draws(m: str, n_boot: int) -> str:
    return f"SELECT b, ('0x' || substr(md5(b || '|' || slot), 1, 8))::BIGINT % {m} AS rk FROM range(1, {n_boot + 1}) x(b), (SELECT unnest(range(0, CAST({m} AS BIGINT))) AS slot)"


_CLUSTERS = f"""cl AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS rk, count(*) AS n, sum(r) AS sr, sum(w * r) AS swr, sum(w) AS sw FROM s GROUP BY user_id),
dr AS ({_draws('(SELECT count(*) FROM cl)', 40)}),
rep AS (SELECT b, sum(sr) / sum(n) AS va, sum(swr) / sum(n) AS vi, sum(swr) / (sum(sw) + 1e-12) AS vs FROM dr JOIN cl USING (rk) GROUP BY b)"""


@query(sql_e(f"SELECT {R('(SELECT avg(w * r) FROM s)')} AS value, {R('quantile_cont(vi, 0.025)')} AS ci_low, {R('quantile_cont(vi, 0.975)')} AS ci_high FROM rep", _CLUSTERS))
def bootstrap_cluster_ci(spark, d):
    return rounded(B.scalar_bootstrap(scored_e(spark, d), "ips", "user_id", 40))


@query(sql_e(f"SELECT {R('va')} AS v_a, {R('vb')} AS v_b, {R('vb - va')} AS delta, {R('quantile_cont(rep.va, 0.025)')} AS v_a_low, {R('quantile_cont(rep.va, 0.975)')} AS v_a_high, {R('quantile_cont(vs, 0.025)')} AS v_b_low, {R('quantile_cont(vs, 0.975)')} AS v_b_high, {R('quantile_cont(vs - rep.va, 0.025)')} AS delta_low, {R('quantile_cont(vs - rep.va, 0.975)')} AS delta_high, {R('(sum(CAST(abs(vs - rep.va - (vb - pt.va)) >= abs(vb - pt.va) AS INTEGER)) + 1) / 41.0')} AS p_value, (sum(CAST(abs(vs - rep.va - (vb - pt.va)) >= abs(vb - pt.va) AS INTEGER)) + 1) / 41.0 < 0.05 AS is_significant FROM rep, pt GROUP BY pt.va, vb".replace("round(va + 0.0", "round(pt.va + 0.0").replace("round(vb - va +", "round(vb - pt.va +"), _CLUSTERS + ", pt AS (SELECT avg(r) AS va, sum(w * r) / (sum(w) + 1e-12) AS vb FROM s)"))
def paired_bootstrap_pvalue(spark, d):
    return rounded(B.paired_bootstrap(scored_e(spark, d), "snips", "user_id", 40))


_ROWS = f"""ro AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rk FROM s),
dr AS ({_draws('(SELECT count(*) FROM ro)', 10)}),
rep AS (SELECT b, avg(w * r) AS vi FROM dr JOIN ro USING (rk) GROUP BY b)"""


@query(sql_e(f"SELECT {R('(SELECT avg(w * r) FROM s)')} AS value, {R('quantile_cont(vi, 0.025)')} AS ci_low, {R('quantile_cont(vi, 0.975)')} AS ci_high FROM rep", _ROWS))
def bootstrap_row_ci(spark, d):
    return rounded(B.scalar_bootstrap(scored_e(spark, d), "ips", None, 10, row_key="event_id"))


_L = """li AS (SELECT l_orderkey AS o, l_returnflag AS a, l_extendedprice * (1 - l_discount) AS r, 1.0 / 3 AS pa, CASE WHEN (l_returnflag = 'A') = (l_quantity < 25) THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS pbt FROM lineitem),"""


@query(f"WITH {_L} x AS (SELECT a, count(*) AS n, {R('avg(r)', 4)} AS v_a, {R('avg(pbt / (1.0 / 3) * r)', 4)} AS ips FROM li GROUP BY a) SELECT * FROM x")
def lineitem_slices(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_extendedprice", "l_discount", "l_quantity")
    space = ("A", "N", "R")
    place = lambda x: (x == "A") == (F.col("l_quantity") < 25)
    pb = F.transform(P.action_array(space), lambda x: F.when(place(x), 0.6).otherwise(0.2))
    s = E.score_rows(li, reward=F.col("l_extendedprice") * (1 - F.col("l_discount")), action=F.col("l_returnflag"), pb=pb, space=space, pa=F.lit(1.0 / 3))
    found = s.groupBy(F.col("l_returnflag").alias("a")).agg(F.count(F.lit(1)).alias("n"), E.estimate_column("on_policy").alias("v_a"), E.estimate_column("ips").alias("ips"))
    return rounded(found, 4)


# orchestration


@query(sql_e(f"SELECT {R('va')} AS v_a, {R('vb')} AS v_b, {R('vb - va')} AS delta, {R('quantile_cont(vi - rep.va, 0.025)')} AS delta_low, {R('quantile_cont(vi - rep.va, 0.975)')} AS delta_high, 'logged' AS propensity_source, 'caution' AS trust_level FROM rep, pt GROUP BY pt.va, vb".replace("round(va + 0.0", "round(pt.va + 0.0").replace("round(vb - va +", "round(vb - pt.va +"), _CLUSTERS + ", pt AS (SELECT avg(r) AS va, avg(w * r) AS vb FROM s)"))
def compare_summary(spark, d):
    r = C.compare_policies(view_e(spark, d), policy_b(), "ips", "reward", action_col="a", propensity_col="p_logged", action_space=SPACE, feature_cols=["k"], n_boot=40)
    row = (r.v_a, r.v_b, r.delta, *r.delta_ci, r.propensity_source, r.trust_level)
    return rounded(spark.createDataFrame([row], "v_a double, v_b double, delta double, delta_low double, delta_high double, propensity_source string, trust_level string"))


@query(sql_e(f"SELECT {R('avg(CAST(a = ab AS INTEGER))')} AS ab_share, {R('avg(CAST(match AS INTEGER))')} AS replay_share FROM s"))
def analyze_logs_profile(spark, d):
    found = log_profile(view_e(spark, d), policy_b(), "a", "ab")
    return rounded(spark.createDataFrame([(found["ab_share"], found["replay_share"])], "ab_share double, replay_share double"))


_RUNS = """SELECT o_orderpriority AS mode, o_orderstatus AS estimator, o_totalprice / 1e5 - 1.5 AS bias, o_totalprice / 1e5 AS hat,
  o_custkey % 2 = 0 AS cov, o_custkey % 3 = 0 AS sig, CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / 1e6 END AS er FROM orders"""
_AGGREGATES = {
    "v_b_bias_mean": "avg(2 * bias)", "v_b_std": "stddev_samp(2 * hat)", "v_b_rmse": "sqrt(avg(4 * bias * bias))",
    "delta_bias_mean": "avg(bias)", "delta_std": "stddev_samp(hat)", "delta_rmse": "sqrt(avg(bias * bias))", "delta_abs_error_mean": "avg(abs(bias))",
    "delta_ci_coverage": "avg(CAST(cov AS INTEGER))", "significance_rate": "avg(CAST(sig AS INTEGER))", "mean_ess_ratio": "avg(er)",
}


@query(f"SELECT mode, estimator, count(*) AS runs, {', '.join(f'{R(x)} AS {n}' for n, x in _AGGREGATES.items())} FROM ({_RUNS}) GROUP BY mode, estimator")
def validation_aggregate(spark, d):
    o, bias = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_totalprice") / 1e5 - 1.5
    runs = o.select(
        F.col("o_orderpriority").alias("mode"), F.col("o_orderstatus").alias("estimator"), F.col("o_orderkey").alias("run_id"),
        bias.alias("delta_bias"), (2 * bias).alias("v_b_bias"), F.abs(bias).alias("abs_delta_error"),
        (F.col("o_totalprice") / 1e5).alias("delta_hat"), (2 * F.col("o_totalprice") / 1e5).alias("v_b_hat"),
        (F.col("o_custkey") % 2 == 0).alias("delta_ci_covers_oracle"), (F.col("o_custkey") % 3 == 0).alias("is_significant"),
        F.when(F.col("o_custkey") % 5 > 0, F.col("o_totalprice") / 1e6).alias("ess_ratio"),
        *[F.lit(None).cast("double").alias(c) for c in ("weight_p99", "behavior_log_loss", "outcome_log_loss", "outcome_rmse")],
    )
    return rounded(aggregate_runs(runs).select("mode", "estimator", "runs", *_AGGREGATES))


# synthetic environment


def _u(stream: str) -> str:
    return f"((('0x' || substr(md5('42|{stream}|' || i), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


_USERS = f"""u0 AS (SELECT range AS i FROM range(2000)),
u AS (SELECT i AS user_id, CAST({_u('loyal')} < 0.55 AS INTEGER) AS loyal, CAST(18 + floor({_u('age')} * 52) AS INTEGER) AS age, {_u('risk')} AS risk,
  exp(10.5 + 0.5 * (sqrt(-2.0 * ln({_u('income1')})) * cos(2.0 * pi() * {_u('income2')}))) AS income, CAST(floor({_u('region')} * 5) AS INTEGER) AS region FROM u0)"""


@query(f"WITH {_USERS} SELECT CAST(user_id AS BIGINT) AS user_id, loyal, age, {R('risk')} AS risk, {R('income', 4)} AS income, region FROM u")
def synthetic_users(spark, d):
    u = SyntheticEnvironment(spark, SynthConfig(2000)).sample_users()
    return u.select("user_id", "loyal", "age", F.round(F.col("risk") + 0.0, 6).alias("risk"), F.round(F.col("income") + 0.0, 4).alias("income"), "region")


def _logit(row) -> str:
    return f"(1.0 / (1.0 + exp(-({row[0]} + {row[1]} * loyal + {row[2]} * ((age - 40) / 12.0) + {row[3]} * ((risk - 0.5) / 0.25) + {row[4]} * ((ln(income) - 10.5) / 0.5)))))"


@query(f"WITH {_USERS} SELECT {', '.join(R(f'avg({_logit(r)})') + f' AS p{i}' for i, r in enumerate(ACCEPT))} FROM u")
def synthetic_oracle(spark, d):
    env = SyntheticEnvironment(spark, SynthConfig(2000))
    p = env.sample_users().select(env.accept_probabilities().alias("p"))
    return rounded(p.agg(*[F.avg(F.col("p")[i]).alias(f"p{i}") for i in range(4)]))


def _score_of(row) -> str:
    terms = ("1", "loyal", "((age - 40) / 12.0)", "((risk - 0.5) / 0.25)", "((ln(income) - 10.5) / 0.5)")
    return "(" + " + ".join(f"CAST({float(w)!r} AS DOUBLE) * {t}" for w, t in zip(row, terms)) + ")"


def _normal(stream: str) -> str:
    return f"(sqrt(-2.0 * ln({_u(stream + '1')})) * cos(2.0 * pi() * {_u(stream + '2')}))"


def _pick(array: str, at: str = "a") -> str:
    return f"({array})[{at} + 1]"


_GREEDY = P.make_policy("greedy", 1)
_LOG = f"""{_USERS},
b AS (SELECT u.*, user_id AS i, [{', '.join(map(_score_of, _GREEDY.weights))}] AS sc, [{', '.join(map(_logit, ACCEPT))}] AS pr, [{', '.join(map(_score_of, UPLIFT))}] AS up FROM u),
q AS (SELECT *, list_position(sc, list_max(sc)) - 1 AS best, {_u('logaction')} AS ua FROM b),
l AS (SELECT *, CAST(list_position(list_transform([0, 1, 2, 3], lambda k: 0.05 * (k + 1) + CASE WHEN best <= k THEN CAST(0.8 AS DOUBLE) ELSE 0 END > ua), true) - 1 AS INTEGER) AS a FROM q),
m AS (SELECT *, CASE WHEN a = best THEN 0.85 ELSE 0.05 END AS pa, CAST({_u('logaccept')} < {_pick('pr')} AS INTEGER) AS acc FROM l),
n AS (SELECT a, pa, acc, greatest(greatest(300.0 + 400.0 * loyal + 120.0 * greatest((ln(income) - 10.5) / 0.5, -1.0) + 30.0 * {_normal('logbase')}, 50.0)
  + acc * greatest({_pick('up')}, 0.0) + 25.0 * {_normal('logcltv')}, 10.0) AS cltv FROM m)"""


@query(f"WITH {_LOG} SELECT a AS \"a_A\", count(*) AS n, {R('avg(acc)', 4)} AS accept, {R('avg(cltv)', 4)} AS cltv, {R('avg(pa)', 4)} AS pa FROM n GROUP BY a")
def synthetic_log(spark, d):
    """A simulated log's totals."""
    env = SyntheticEnvironment(spark, SynthConfig(2000))
    logs = env.simulate_logs(P.make_policy("epsilon_greedy", 1, epsilon=0.2), propensity=True)
    means = [F.avg(c).alias(n) for c, n in (("accept", "accept"), ("cltv", "cltv"), ("propensity_A", "pa"))]
    return rounded(logs.groupBy("a_A").agg(F.count(F.lit(1)).alias("n"), *means), 4)


_REFIT = f"""cl AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS rk FROM (SELECT DISTINCT user_id FROM s)),
dr AS ({_draws('(SELECT count(*) FROM cl)', 8)}),
rw AS (SELECT b, a, ab, k, r FROM dr JOIN cl USING (rk) JOIN s USING (user_id) UNION ALL SELECT 0, a, ab, k, r FROM s),
rg AS (SELECT b, a, avg(k) AS mx, avg(r) AS my, covar_pop(k, r) * count(*) AS sxy, var_pop(k) * count(*) AS sxx FROM rw GROUP BY b, a),
rs AS (SELECT b, sum(sxy) / sum(sxx) AS sl FROM rg GROUP BY b),
ri AS (SELECT rg.b, a, my - sl * mx AS i FROM rg JOIN rs USING (b)),
rt AS (SELECT b, sum(i) AS si FROM ri GROUP BY b),
rep AS (SELECT rw.b, avg(0.75 * i + 0.05 * si + sl * k) AS v FROM rw JOIN ri ON ri.b = rw.b AND ri.a = rw.ab JOIN rt ON rt.b = rw.b JOIN rs ON rs.b = rw.b GROUP BY rw.b)"""


@query(
    sql_e(
        f"SELECT {R('any_value(v) FILTER (b = 0)', 4)} AS v_b, {R('quantile_cont(v, 0.025) FILTER (b > 0)', 4)} AS v_b_low, "
        f"{R('quantile_cont(v, 0.975) FILTER (b > 0)', 4)} AS v_b_high FROM rep",
        _REFIT,
    )
)
def refit_bootstrap_dm(spark, d):
    """DM with least squares fitted again in every replicate."""
    options = {"action_col": "a", "feature_cols": ["k"], "action_space": SPACE, "cluster_col": "user_id"}
    e = B.cut(view_e(spark, d).select("user_id", "a", "reward", "k", "ab"))  # several passes read it
    r = C.compare_policies(e, policy_b(), "dm", "reward", n_boot=8, **options)
    return rounded(spark.createDataFrame([(r.v_b, *r.v_b_ci)], "v_b double, v_b_low double, v_b_high double"), 4)


# logistic models have no closed form, but their optimum is known: residuals add up to 0 where a coefficient is
# free, and to its negative where it is penalised; equal rows are counted first, as the rounding errors of a sum
# over single rows grow with the table


def equal_rows(e: DataFrame, *keys: str) -> DataFrame:
    return e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(sql_e("SELECT a AS action, round(count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE), 6) AS mean_p, CAST(0.0 AS DOUBLE) AS slope_residual FROM s GROUP BY a"))
def lr_behavior_optimum(spark, d):
    """Mean fitted probability of each action, and what is left of its score equation."""
    e = view_e(spark, d)
    m = fit_behavior(e, ["k"], "a")
    z, p = m.scaler.columns(m.features)[0], m.probs()
    q = [F.element_at(p, i + 1) for i in range(len(m.classes))]
    sums = [F.struct((F.sum(x * F.col("n")) / F.sum("n")).alias("mean_p"), F.sum((x - (F.col("a") == c).cast("double")) * z * F.col("n")).alias("g")).alias(c) for x, c in zip(q, m.classes)]
    found = equal_rows(e, "k", "a").agg(*sums).first()
    rows = [(c, found[c]["mean_p"], abs(found[c]["g"] + row[1])) for c, row in zip(m.classes, m.coefficients)]
    return rounded(spark.createDataFrame(rows, "action string, mean_p double, slope_residual double"))


@query(sql_e("SELECT round(avg(CAST(r > 50 AS INTEGER)), 6) AS mean_p, CAST(0.0 AS DOUBLE) AS slope_residual, CAST(0.0 AS DOUBLE) AS effect_residual FROM s"))
def lr_outcome_optimum(spark, d):
    """Mean fitted outcome, and what is left of the score equations of slope and action effects."""
    e = view_e(spark, d).withColumn("big", (F.col("reward") > 50).cast("int"))
    m = fit_binary(e, ["k"], "a", "big")
    mu, z = m.mu_at(F.col("a")), m.scaler.columns(m.features)[0]
    left = (mu - F.col("big")) * F.col("n")
    sums = [(F.sum(mu * F.col("n")) / F.sum("n")).alias("mean_p"), F.sum(left * z).alias("g"), *[F.sum(F.when(F.col("a") == c, left).otherwise(0.0)).alias(f"e_{c}") for c in m.actions]]
    found = equal_rows(e, "k", "a", "big").agg(*sums).first()
    effect = max(abs(found[f"e_{c}"] + b) for c, b in zip(m.actions, m.effects))
    row = (found["mean_p"], abs(found["g"] + m.slopes[0]), effect)
    return rounded(spark.createDataFrame([row], "mean_p double, slope_residual double, effect_residual double"))


@query()
def lr_propensity_ips(spark, d):
    """IPS with a fitted multinomial behaviour model."""
    e = view_e(spark, d)
    p = estimated(e, ["k"], "a", SPACE)
    s = E.score_rows(e, reward=F.col("reward"), action=F.col("a"), pb=policy_b().probs(), space=SPACE, pa=p.pa)
    return rounded(s.agg(E.estimate_column("ips").alias("ips"), F.avg("pa").alias("mean_pa")), 4)


@query()
def lr_mu_dr(spark, d):
    """DR on a binary target with a fitted logistic outcome model."""
    e = view_e(spark, d).withColumn("big", (F.col("reward") > 50).cast("int"))
    mu = fit_outcome(e, ["k"], "a", "big").mu_array(SPACE)
    s = E.score_rows(e, reward=F.col("big"), action=F.col("a"), pb=policy_b().probs(), space=SPACE, pa=F.col("p_logged"), mu=mu)
    return rounded(s.agg(E.estimate_column("dr").alias("dr"), E.estimate_column("dm").alias("dm")), 4)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: value of both policies with cluster bootstrap intervals on the events log."""
    s = scored_e(spark, sf_dir)
    base = s.agg(E.effective_sample_size(F.col("w")).alias("ess"), F.avg(F.col("match").cast("double")).alias("overlap"), E.estimate_column("snips").alias("snips"))
    return B.paired_bootstrap(s, "ips", "user_id", 40).crossJoin(base)  # one row each
