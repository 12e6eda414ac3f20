"""Contract, policies, estimators, inference, diagnostics and reports on small frames."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestar
from lodestar.contract import BanditSchema, LoggedBandit, is_binary, resolve_features
from lodestar.functions import policies as P
from lodestar.operators import bootstrap as B
from lodestar.operators import diagnostics as D
from lodestar.operators import estimators as E
from lodestar.operators import models as M
from lodestar.operators import nuisance as N
from lodestar.operators.models import Moments, behavior_from, fit_behavior, fit_binary, fit_linear
from lodestar.operators.nuisance import balanced_folds, fold_column, resolve_propensity
from lodestar.operators.refit import refit_replicates
from lodestar.plans import compare as C
from lodestar.plans import report as R
from lodestar.plans.report import analyze_logs, decision_summary, dump_json, write_artifacts
from lodestar.plans.validation import ValidationMode, run_simulation_validation
from lodestar.sources.synthetic import SynthConfig, SyntheticEnvironment
from lodestar.streaming.running import finalised, windowed_sums
from refit_one import refit_value


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(1, 0, 1, 0.1, 10.0, 0.5), (1, 1, 0, 0.2, 11.0, 0.8), (2, 0, 1, 0.3, 12.0, 1.0)], "user_id long, a_A int, accept int, f1 double, f2 double, propensity_A double")


@pytest.fixture(scope="module")
def logs(spark):
    env = SyntheticEnvironment(spark, SynthConfig(300, seed=5))
    return env.simulate_logs(P.make_policy("epsilon_greedy", 5, epsilon=0.4), propensity=True).cache()


def test_contract(spark, base):
    s = BanditSchema(feature_cols=["f1", "f2"], propensity_col="propensity_A")
    d = LoggedBandit(base, s)
    assert d.features.columns == ["f1", "f2"] and d.logged_propensity.count() == 3 and d.clusters.columns == ["user_id"]
    for df, schema, text in (
        (base.drop("a_A"), s, "action"),
        (base.drop("accept"), s, "reward"),
        (base, BanditSchema(feature_cols=["f_missing"]), "feature"),
        (base.withColumn("propensity_A", F.lit(0.0)), s, "propensity"),
        (base.withColumn("propensity_A", F.lit(float("nan"))), s, "propensity"),
        (base.filter("false"), s, "non-empty"),
        (base.drop("user_id"), s, "cluster"),
    ):
        with pytest.raises(ValueError, match=text):
            LoggedBandit(df, schema)
    LoggedBandit(base.drop("user_id"), BanditSchema(cluster_col=None))


def test_feature_inference(base):
    assert resolve_features(base, None, action_col="a_A", target="accept") == ["f1", "f2"]
    assert resolve_features(base.withColumn("age", F.lit(3)), None, action_col="a_A", target="accept") == ["age"]
    assert resolve_features(base.withColumn("cltv", F.lit(3.0)), None, action_col="a_A", target="accept") == ["f1", "f2"]
    with pytest.raises(ValueError):
        resolve_features(base, ["nope"], action_col="a_A")
    with pytest.raises(ValueError):
        resolve_features(base.select("user_id", "a_A", "accept"), None, action_col="a_A", target="accept")


def test_binary(spark, base):
    assert is_binary(base, "accept") and not is_binary(base, "f1")
    assert not is_binary(base.withColumn("one", F.lit(1)), "one")


def test_policies(spark, base):
    df = spark.createDataFrame([(1,), (0,), (2,), (1,)], "action_B int")
    p = P.ActionColumnPolicy("action_B", [0, 1, 2])
    rows = p.prepare(df).select(p.probs().alias("p"), p.argmax().alias("i")).collect()
    assert [r["i"] for r in rows] == [1, 0, 2, 1] and all(sum(r["p"]) == 1 for r in rows)
    with pytest.raises(ValueError, match="Unknown actions"):
        P.ActionColumnPolicy("action_B", [0, 1]).prepare(df)
    for bad in ([], [0, 0]):
        with pytest.raises(ValueError):
            P.ActionColumnPolicy("action_B", bad)
    with pytest.raises(ValueError):
        P.make_policy("other")
    tie = spark.range(1).select(P.argmax_index(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))).alias("i")).first()["i"]
    assert tie == 0
    soft = spark.range(1).select(P.softmax(F.array(F.lit(1000.0), F.lit(0.0)), 0.0).alias("p")).first()["p"]
    assert soft == [1.0, 0.0]
    with pytest.raises(Exception, match="not in the action space"):
        spark.range(1).select(P.take_probability(F.array(F.lit(1.0)), F.lit(7), [0])).collect()


def scored(spark, w=None):
    rows = [(i, i % 7, float(i % 5), 0.2 + 0.1 * (i % 3), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, c int, r0 double, p double, a int")
    pb = F.array(F.when(F.col("i") % 3 == 0, 0.7).otherwise(0.4), F.when(F.col("i") % 3 == 0, 0.3).otherwise(0.6))
    return df, pb


def test_identities(spark):
    """w = 1 makes IPS and SNIPS the mean; mu = 0 makes DR IPS; an infinite tau makes Switch-DR DR; a tiny one DM."""
    df, pb = scored(spark)
    taken = P.take_probability(pb, F.col("a"), [0, 1])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    one = E.estimate(E.score_rows(df, reward=F.col("r0"), action=F.col("a"), pb=pb, space=[0, 1], pa=taken, mu=zero)).first()
    assert math.isclose(one["ips"], one["on_policy"]) and math.isclose(one["snips"], one["on_policy"]) and math.isclose(one["dr"], one["ips"])
    mu = F.array(F.col("r0"), F.col("r0") + 1)
    s = E.score_rows(df, reward=F.col("r0"), action=F.col("a"), pb=pb, space=[0, 1], pa=F.col("p"), mu=mu)
    big, small = E.estimate(s, tau=1e9).first(), E.estimate(s, tau=1e-9).first()
    assert math.isclose(big["switch_dr"], big["dr"]) and math.isclose(small["switch_dr"], small["dm"])
    n = s.agg(E.effective_sample_size(F.col("w")).alias("e")).first()["e"]
    assert 0 < n <= 60


def test_estimators_against_numpy(spark):
    df, pb = scored(spark)
    mu = F.array(F.col("r0") * 0.5, F.col("r0") * 0.25 + 1)
    s = E.score_rows(df, reward=F.col("r0"), action=F.col("a"), pb=pb, space=[0, 1], pa=F.col("p"), mu=mu)
    x = s.toPandas()
    pbm, m = np.stack(x.pb), np.stack(x.mu)
    w = pbm[np.arange(60), x.a] / x.p
    dm, res = (pbm * m).sum(1), x.r0 - m[np.arange(60), x.a]
    v = np.minimum(w, 1.5)
    expected = {"on_policy": x.r0.mean(), "replay": x.r0[x.a == pbm.argmax(1)].mean(), "ips": (v * x.r0).mean(), "snips": (v * x.r0).sum() / v.sum(), "dm": dm.mean(), "dr": (dm + v * res).mean(), "sndr": dm.mean() + (v * res).mean() / v.mean(), "switch_dr": (dm + np.where(w <= 1.5, w, 0) * res).mean()}
    got = E.estimate(s, clip=1.5, tau=1.5).first().asDict()
    assert all(math.isclose(got[k], expected[k], rel_tol=1e-9) for k in expected)


def test_missing_values(spark):
    df, pb = scored(spark)
    s = E.score_rows(df.withColumn("r0", F.when(F.col("i") == 3, float("nan")).otherwise(F.col("r0"))), reward=F.col("r0"), action=F.col("a"), pb=pb, space=[0, 1], pa=F.col("p"))
    r = E.estimate(s, ("on_policy", "ips", "replay")).first()
    assert r["on_policy"] is not None and r["ips"] is None
    empty = E.estimate(s.filter("false"), ("on_policy", "replay", "ips", "snips")).first()
    assert empty["on_policy"] is None and empty["replay"] is None


def test_ols_is_minimum_norm(spark):
    rng = np.random.default_rng(0)
    x, a = rng.normal(size=(80, 2)), rng.integers(0, 3, 80)
    y = x @ [1.5, -2.0] + np.array([0.0, 1.0, 3.0])[a] + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(float(p), float(q), int(b), float(t)) for (p, q), b, t in zip(x, a, y)], "x double, z double, a int, y double")
    m = fit_linear(df, ["x", "z"], "a", "y")
    assert abs(sum(m.effects)) < 1e-9
    z = np.hstack([np.ones((80, 1)), (x - x.mean(0)) / x.std(0), np.eye(3)[a]])
    fit = z @ np.linalg.lstsq(z, y, rcond=None)[0]
    got = df.select(m.mu_at(F.col("a")).alias("m")).toPandas()["m"]
    assert np.abs(got - fit).max() < 1e-8


def test_logistic_gradients_vanish(spark, logs):
    names = ["loyal", "age", "risk", "income"]
    m = fit_binary(logs, names, "a_A", "accept")
    x = logs.select(*names, "a_A", "accept", m.mu_at(F.col("a_A")).alias("p")).toPandas()
    z = (x[names] - x[names].mean()) / x[names].std(ddof=0)
    gradient = z.T @ (x.p - x.accept) + np.array(m.slopes)
    assert np.abs(gradient).max() < 1e-4 and abs((x.p - x.accept).sum()) < 1e-4
    b = fit_behavior(logs, names, "a_A")
    p = np.stack(logs.select(b.probs().alias("p")).toPandas()["p"])
    assert np.abs(p.sum(1) - 1).max() < 1e-3 and abs(p[:, 0].sum() - (x.a_A == 0).sum()) < 1e-2


def test_folds(spark):
    df = spark.range(41)
    n = [r["count"] for r in balanced_folds(df, "id", 5).groupBy("fold").count().collect()]
    assert sum(n) == 41 and max(n) - min(n) <= 1 and len(n) == 5
    with pytest.raises(ValueError):
        fold_column(F.col("id"), 1)


def test_propensity_modes(logs):
    names, space = ["loyal", "age", "risk", "income"], [0, 1, 2, 3]
    assert resolve_propensity(logs, "logged", "propensity_A", names, "a_A", space).source == "logged"
    assert resolve_propensity(logs, "auto", "propensity_A", names, "a_A", space).notes == ("auto_selected_logged_propensity",)
    bad = logs.withColumn("bad_p", F.lit(1.5))
    with pytest.raises(ValueError, match="bad_p"):
        resolve_propensity(bad, "logged", "bad_p", names, "a_A", space)
    assert resolve_propensity(bad, "auto", "bad_p", names, "a_A", space).notes[0] == "logged_propensity_invalid_fallback_to_estimated"
    assert resolve_propensity(logs, "auto", None, names, "a_A", space).notes[0] == "logged_propensity_missing_fallback_to_estimated"


def test_bootstrap(spark):
    df = spark.createDataFrame([(c, float(v)) for c in range(4) for v in (c, c + 1)], "user_id int, r double").withColumn("match", F.lit(True)).withColumn("w", F.lit(1.0))
    r = B.scalar_bootstrap(df, "on_policy", "user_id", 200).first()
    assert r["value"] == 2.0 and r["ci_low"] <= 2.0 <= r["ci_high"]
    narrow = B.scalar_bootstrap(df, "on_policy", "user_id", 200, alpha=0.2).first()
    assert narrow["ci_high"] - narrow["ci_low"] <= r["ci_high"] - r["ci_low"]
    again = B.scalar_bootstrap(df.repartition(3), "on_policy", "user_id", 200).first()
    assert again == r
    null = B.paired_bootstrap(df, "ips", "user_id", 100).first()
    assert null["delta"] == 0 and null["p_value"] == 1.0 and not null["is_significant"]
    big = B.paired_bootstrap(df.withColumn("w", F.lit(4.0)), "ips", "user_id", 300).first()
    assert big["delta"] == 6.0 and big["p_value"] < 0.05 and big["is_significant"]
    other = B.scalar_bootstrap(df, "on_policy", "user_id", 200, seed=7).first()
    assert other["value"] == 2.0 and other != r and other == B.scalar_bootstrap(df, "on_policy", "user_id", 200, seed=7).first()
    rows = df.select("r", "match", "w")
    by_row = B.scalar_bootstrap(rows, "ips", None, 100).first()
    assert by_row == B.scalar_bootstrap(rows.repartition(3), "ips", None, 100).first()
    with pytest.raises(ValueError, match="row_key"):
        B.scalar_bootstrap(rows, "ips", None, 10, kind="poisson")
    poisson = B.scalar_bootstrap(df, "on_policy", "user_id", 200, kind="poisson").first()
    assert poisson["ci_low"] <= 2.0 <= poisson["ci_high"]
    opaque = B.bootstrap_callable(df, lambda x: x["r"].mean(), "user_id", 20).first()
    assert opaque["value"] == 2.0
    value, low, high = B.cluster_bootstrap_ci(df, lambda x: x["r"].mean(), n_boot=20)
    assert value == 2.0 and low <= 2.0 <= high
    flat = B.paired_bootstrap_ci(df, lambda x: (x["r"].mean(), 2 * x["r"].mean(), x["r"].mean()), n_boot=20)
    assert flat["Delta"] == 2.0 and flat["V_B_CI"][0] <= 4.0 and flat["inference_warnings"] == [B.FEW_REPLICATES]
    with pytest.raises(ValueError, match="more than 3 rows"):
        B.bootstrap_callable(df, lambda x: 0.0, "user_id", 5, max_rows=3)


def test_ranges_of_order(spark):
    rnd = np.random.default_rng(1)
    v = np.concatenate([rnd.normal(size=300), np.zeros(100), [5.0]])
    df = spark.createDataFrame([(float(x), int(y)) for x, y in zip(v, rnd.integers(0, 2, len(v)))], "v double, y int")
    points = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    assert np.allclose(B.quantiles(df, F.col("v"), points), np.quantile(v, points), rtol=1e-12)
    assert B.quantiles(df.limit(0), F.col("v"), (0.5,)) == [None]
    rows = df.collect()
    pos, neg = ([r["v"] for r in rows if r["y"] == y] for y in (1, 0))
    brute = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert math.isclose(D.roc_auc(df, "v", "y").first()["roc_auc"], brute)
    assert D.roc_auc(df.filter("y = 1"), "v", "y").first()["roc_auc"] is None


def test_undefined_replicates(spark):
    df = spark.createDataFrame([(0, 1.0, True), (1, 2.0, False)], "user_id int, r double, match boolean").withColumn("w", F.lit(1.0))
    r = B.paired_bootstrap(df, "replay", "user_id", 50).first()
    assert r["p_value"] is None and r["is_significant"] is None and r["delta_low"] is None


def test_auc(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.random(200), 1), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    brute = np.mean([(p > q) + 0.5 * (p == q) for p in s[y == 1] for q in s[y == 0]])
    assert math.isclose(D.roc_auc(df, "s", "y").first()["roc_auc"], brute)
    assert D.roc_auc(df.filter("y = 1"), "s", "y").first()["roc_auc"] is None


def test_flags():
    values = {"replay_overlap": 0.05, "weight_ess_ratio": 0.09, "weight_max": 50.0, "weight_p99": 21.0, "clip_share": None}
    assert D.raised(D.FLAGS, values) == ["low_ess_ratio", "heavy_weight_tail"]
    info, about, level, advice = C.trust("dr", False, ("n", "n"), ["low_ess_ratio", "heavy_weight_tail"], [])
    assert level == "elevated_concern" and advice == C.CONCERN and info == ("n", C.CROSSFIT_NOTE) and C.UNSTABLE_NOTE in about
    assert C.trust("ips", False, (), [], ["x"])[2] == "caution" and C.trust("ips", False, (), [], [])[2] == "ok"


@pytest.mark.parametrize("method", ["replay", "ips", "dm", "dr", "switch_dr"])
def test_compare(logs, method, tmp_path):
    b = P.make_policy("softmax", 6, tau=0.8)
    r = C.compare_policies(logs, b, method, propensity_col="propensity_A", n_boot=6)
    d = r.to_dict()
    assert {"V_A", "V_B", "Delta", "V_B_CI", "Delta_CI", "p_value", "diagnostics", "trust_level"} <= set(d)
    assert math.isclose(r.delta, r.v_b - r.v_a) and math.isfinite(r.v_b) and B.FEW_REPLICATES in r.inference_warnings
    assert r.trust_level in ("caution", "elevated_concern")
    dump_json(r, str(tmp_path / "s.json"))
    assert json.load(open(tmp_path / "s.json"))["estimator"] == method
    assert "Метрика: x" in decision_summary(r, "x")


@pytest.mark.parametrize("per_group", [12_000, 72_000])  # 500 groups: 6 and 36 million rows
def test_behavior_fit_of_many_rows_in_any_order(per_group):
    rnd = np.random.default_rng(3)
    a, x = (v.ravel() for v in np.indices((5, 100)))
    n = rnd.poisson(per_group, len(a)).astype(float)
    of = lambda own: Moments(n[own].sum(), np.array([n[own] @ x[own] / n[own].sum()]), np.array([[n[own] @ (x[own] - n[own] @ x[own] / n[own].sum()) ** 2]]))
    by_action = {c: of(a == c) for c in range(5)}
    for _ in range(20):
        order, passes = rnd.permutation(len(a)), []

        class Held:
            def total(self, classes, size, of_rows, without):
                passes.append(1)
                return of_rows(x[order, None].astype(float), a[order], n[order], np.zeros(len(n)))

        m = behavior_from(["x"], by_action, Held())
        z, coef = (x - m.scaler.mean[0]) / m.scaler.scale[0], np.array(m.coefficients)
        p = np.exp(coef[:, :1] + coef[:, 1:] * z)
        away = (p / p.sum(0) - np.eye(5)[:, a]) * n
        assert len(passes) < 12 and np.abs(away @ z + coef[:, 1]).max() < 1e-7 and np.abs(away.sum(1)).max() < 1e-7


@pytest.mark.parametrize("method, target, estimated", [("dm", "cltv", False), ("dr", "accept", True), ("sndr", "cltv", True), ("switch_dr", "accept", False), ("snips", "accept", True)])
def test_refitted_replicates_equal_single_fits(spark, logs, method, target, estimated):
    n_boot = 3
    rnd = np.random.default_rng(2)
    pdf = logs.toPandas()
    space = sorted(pdf["a_A"].unique())
    k = len(space)
    x = pdf[["age", "loyal"]].to_numpy(float)
    x = (x - x.mean(0)) / x.std(0)
    a, y = np.searchsorted(space, pdf["a_A"]), pdf[target].to_numpy(float)
    pb, pa_ = rnd.dirichlet(np.ones(k), len(y)), pdf["propensity_A"].to_numpy(float)
    counts = rnd.poisson(1, (len(y), n_boot))
    counts[a == 0, 1] = 0  # an action that one replicate doesn't see
    y[7], counts[7] = np.nan, [0, 0, 1]  # a missing reward that only one replicate draws
    rows = spark.createDataFrame([(x[i].tolist(), int(a[i]), float(y[i]), pb[i].tolist(), float(pa_[i]), bytes(counts[i].astype(np.uint8))) for i in range(len(y))], "x array<double>, a int, y double, pb array<double>, pa double, counts binary")
    binary = target == "accept"
    got = np.stack(refit_replicates(rows, n_boot, k, 2, method, binary, estimated, 5.0, 4.0), 1)
    assert np.isnan(got[2]).all()
    for b in range(2):
        c = counts[:, b] > 0
        want = refit_value(x[c], a[c], y[c], pb[c], pa_[c], counts[c, b].astype(float), method, binary, estimated, 5.0, 4.0)
        assert np.allclose(got[b], want, rtol=1e-6, atol=1e-8)


def test_refit_at_every_size(logs, monkeypatch):
    b = P.make_policy("softmax", 6, tau=0.8)
    run = lambda: C.compare_policies(logs, b, "dm", "cltv", propensity_col="propensity_A", n_boot=4)
    small = run()
    monkeypatch.setattr(C, "MAX_REFIT_ROWS", 10, raising=False)  # as if the table were past any former limit
    monkeypatch.setattr(C, "MAX_REFIT", 10, raising=False)
    large = run()
    assert C.FIXED_NUISANCE not in large.info_notes and np.allclose(large.v_b_ci, small.v_b_ci)


def test_compare_estimated_and_crossfit(logs):
    b = P.make_policy("softmax", 6, tau=0.8)
    r = C.compare_policies(logs, b, "dr", propensity_source="estimated", with_ci=False)
    assert r.propensity_source == "estimated" and r.nuisance_diagnostics.behavior.applicable and r.p_value is None
    x = C.compare_policies(logs, b, "dr", use_crossfit=True, crossfit_k=2, propensity_source="logged", propensity_col="propensity_A", with_ci=False, row_key="user_id")
    assert C.CROSSFIT_OVERRIDES in x.notes and x.nuisance_diagnostics.outcome.is_out_of_fold
    both = C.compare_policies_multi_target(logs, b, ["accept", "cltv"], estimator="ips", propensity_col="propensity_A", with_ci=False)
    assert set(both.results) == {"accept", "cltv"} and both.results["cltv"].v_a > 10
    assert set(both.to_dict()["results"]["accept"]["notes"]) >= set(both.results["accept"].info_notes)
    alone = C.compare_policies(logs, b, "ips", "accept", propensity_col="propensity_A", with_ci=False)
    assert alone.v_b == both.results["accept"].v_b
    d = LoggedBandit(logs, BanditSchema(propensity_col="propensity_A"))
    assert C.OPEEvaluator(b, "ips", with_ci=False).evaluate(d)["propensity_source"] == "logged"
    with pytest.raises(ValueError, match="unsupported"):
        C.compare_policies(logs, b, "magic")


def test_decision_text():
    d = {"V_A": 0.1, "V_B": 0.15, "Delta": 0.05, "Delta_CI": (0.02, 0.08)}
    assert "B лучше A" in decision_summary(d, "m", 0.01)
    assert "A лучше B" in decision_summary(d | {"Delta_CI": (-0.08, -0.02)}, "m", 0.01)
    assert "не обнаружено" in decision_summary(d | {"Delta_CI": (-0.03, 0.04)}, "m", 0.01)
    assert "CI не передан" in decision_summary({"V_A": 0.1, "V_B": 0.2, "Delta": 0.1}, "m")


def test_analyze_logs(logs):
    text = analyze_logs(logs.drop("propensity_A"))
    assert all(x in text for x in (R.ENTRY, R.AUTO_PATH, R.STRICT_PATH, R.FAMILY, "user_id"))
    text = analyze_logs(logs, P.make_policy("greedy", 5))
    assert "%" in text and "propensity_A" in text and "replay overlap" in text


def test_artifacts(logs, tmp_path):
    r = C.compare_policies(logs, P.make_policy("softmax", 6, tau=0.8), "ips", propensity_col="propensity_A", with_ci=False)
    paths = write_artifacts(str(tmp_path / "out"), r, "accept", logs)
    assert len(paths) == 4 and json.load(open(paths[0]))["estimator"] == "ips" and "weight_max" in json.load(open(paths[1]))["diagnostics"]
    assert logs.sparkSession.read.option("header", True).csv("file://" + paths[3]).count() == logs.count()


def test_external_nuisances(logs):
    """Predictions of a caller stand for the values; replicates fit their own, and say so."""
    b, space = P.make_policy("softmax", 6, tau=0.8), (0, 1, 2, 3)
    flat = F.array(*[F.lit(0.5)] * 4)
    bundle = N.NuisanceBundle(N.logged(logs, "propensity_A"), N.OutcomePredictions("accept", flat, space))
    plain = C.compare_policies(logs, b, "ips", propensity_col="propensity_A", with_ci=False)
    r = C.compare_policies(logs, b, "ips", nuisance_bundle=bundle, propensity_col="propensity_A", n_boot=10)
    assert r.v_b == plain.v_b and C.NOT_REUSED in r.inference_warnings and r.notes[-1] in r.trust_notes
    assert set(r.notes) == {*r.info_notes, *r.diagnostic_warnings, *r.inference_warnings, *r.trust_notes}
    dr = C.compare_policies(logs, b, "dm", nuisance_bundle=bundle, feature_cols=["age"], n_boot=4)
    assert math.isclose(dr.v_b, 0.5) and dr.v_b_ci[0] != 0.5 and C.NOT_REUSED in dr.inference_warnings
    other = N.NuisanceBundle(None, N.OutcomePredictions("cltv", flat, space))
    with pytest.raises(ValueError, match="cltv"):
        C.compare_policies(logs, b, "dm", nuisance_bundle=other, with_ci=False)
    few = N.NuisanceBundle(None, N.OutcomePredictions("accept", F.array(F.lit(0.5)), (0,)))
    with pytest.raises(ValueError, match="missing actions"):
        C.compare_policies(logs, b, "dm", nuisance_bundle=few, with_ci=False)
    with pytest.raises(ValueError, match="every row"):
        N.validate_outcome_predictions(logs, N.OutcomePredictions("accept", F.array(F.lit(0.5)), space))
    with pytest.raises(ValueError, match="can't be read"):
        N.validate_behavior_predictions(logs, N.Propensity(F.col("absent"), None, "external"))
    with pytest.raises(ValueError, match="required columns are missing"):
        C.compare_policies(logs, b, "ips", target="absent")
    assert C.recommended_defaults("dr")["crossfit_recommended_for_estimator"] and lodestar.__version__
    value = C.estimate_value_with_ci(logs, b, "ips", propensity_col="propensity_A", n_boot=10)
    assert value["value"] == plain.v_b and value["CI"][0] <= value["CI"][1]


def test_out_of_fold_fits_equal_separate_ones(logs):
    """One pass by fold gives what a fit on the other folds gives; on the driver or distributed."""
    names, folded = ["loyal", "age", "risk"], logs.withColumn("fold", N.fold_column(F.col("user_id"), 3))
    for target, binary in (("accept", True), ("cltv", False)):
        for j, m in enumerate(M.fit_outcomes(folded, names, "a_A", target, 3, binary)):
            own = M.fit_outcome(folded.filter(F.col("fold") != j), names, "a_A", target, binary)
            assert np.allclose([m.intercept, *m.slopes, *m.effects], [own.intercept, *own.slopes, *own.effects], rtol=1e-6, atol=1e-8)
    for j, m in enumerate(M.fit_behaviors(folded, names, "a_A", 3)):
        own = M.fit_behavior(folded.filter(F.col("fold") != j), names, "a_A")
        assert np.allclose(m.coefficients, own.coefficients, rtol=1e-6, atol=1e-7)
    spread, held = M.fit_behavior(logs, names[:1], "a_A", driver_rows=0), M.fit_behavior(logs, names[:1], "a_A")
    assert np.allclose(spread.coefficients, held.coefficients, atol=1e-7)
    spread, held = M.fit_binary(logs, names[:1], "a_A", "accept", driver_rows=0), M.fit_binary(logs, names[:1], "a_A", "accept")
    assert np.allclose([spread.intercept, *spread.slopes], [held.intercept, *held.slopes], atol=1e-7)


def test_synthetic_oracle(spark):
    env = SyntheticEnvironment(spark, SynthConfig(4000, seed=3))
    p = P.make_policy("softmax", 1)
    exact, simulated = env.exact_accept_value(p), env.oracle_value(p, n_mc=2)
    assert abs(exact - simulated) < 0.03
    a = env.sample_users().agg(F.avg("loyal"), F.avg("age")).first()
    assert abs(a[0] - 0.55) < 0.03 and abs(a[1] - 43.5) < 1


def test_validation_harness(spark):
    r = run_simulation_validation(spark, estimators=("ips", "snips"), modes=(ValidationMode("logged", "auto", "propensity_A"),), n_runs=2, n_users=80, n_boot=5)
    assert r.run_rows.count() == 4 and r.aggregate.count() == 2 and len(r.to_dict()["run_rows"]) == 4


def test_streaming_sums(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 1.0 + i % 2, f"2026-01-01 00:{i:02d}:00") for i in range(30)], "r double, w double, t string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("t"))
    q = windowed_sums(stream, "ips", "ts", "10 minutes").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = df.agg(F.avg(F.col("r") * F.col("w"))).first()[0]
    assert math.isclose(finalised(spark.table("sums"), "ips").first()["value"], whole)
