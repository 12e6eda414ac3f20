"""Synthetic decision logs with a known oracle, from hashes of the user id: independent of partitioning."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.policies import Policy, scores_of, standard_features
from lodestar.operators.bootstrap import hash32

#: Coefficients per action of acceptance (logit) and of uplift, over (1, loyal, age_z, risk_z, income_z).
ACCEPT = (
    (-0.2, 0.8, 0.2, -0.4, 0.1),
    (-0.4, 0.5, -0.1, -0.2, 0.4),
    (-0.1, 0.3, 0.1, -0.1, 0.2),
    (-0.3, 0.4, 0.2, 0.1, -0.1),
)
UPLIFT = (
    (200.0, 120.0, 80.0, -60.0, 50.0),
    (300.0, 180.0, -30.0, -90.0, 70.0),
    (150.0, 90.0, 40.0, -20.0, 30.0),
    (100.0, 50.0, 60.0, 30.0, -10.0),
)


@dataclass(frozen=True)
class SynthConfig:
    n_users: int = 50_000
    horizon_days: int = 90
    seed: int = 42


def uniform(seed: int, stream: str, key: Column) -> Column:
    """A uniform in (0, 1) by hash of (seed, stream, key)."""
    return (hash32(F.concat(F.lit(f"{seed}|{stream}|"), key.cast("string"))) + 0.5) / float(1 << 32)


def normal(seed: int, stream: str, key: Column) -> Column:
    """A standard normal by Box and Muller's transform."""
    return F.sqrt(-2.0 * F.log(uniform(seed, stream + "1", key))) * F.cos(2.0 * math.pi * uniform(seed, stream + "2", key))


class SyntheticEnvironment:
    """Users, logs of a policy, and values of a policy under the true model."""

    def __init__(self, spark: SparkSession, config: SynthConfig = SynthConfig()) -> None:
        self.spark, self.config = spark, config

    def sample_users(self, n: int | None = None) -> DataFrame:
        s, i = self.config.seed, F.col("user_id")
        users = self.spark.range(n or self.config.n_users).withColumnRenamed("id", "user_id")
        return users.select(
            "user_id",
            (uniform(s, "loyal", i) < 0.55).cast("int").alias("loyal"),
            (18 + F.floor(uniform(s, "age", i) * 52)).cast("int").alias("age"),
            uniform(s, "risk", i).alias("risk"),
            F.exp(10.5 + 0.5 * normal(s, "income", i)).alias("income"),
            F.floor(uniform(s, "region", i) * 5).cast("int").alias("region"),
        )

    def accept_probabilities(self) -> Column:
        """Array of the true acceptance probability of each action."""
        return F.transform(scores_of(ACCEPT, standard_features()), lambda z: F.greatest(F.least(1.0 / (1.0 + F.exp(-z)), F.lit(1 - 1e-6)), F.lit(1e-6)))

    def uplifts(self) -> Column:
        return F.transform(scores_of(UPLIFT, standard_features()), lambda z: F.greatest(z, F.lit(0.0)))

    def base_cltv(self, noise: Column) -> Column:
        income = (F.log("income") - 10.5) / 0.5
        return F.greatest(300.0 + 400.0 * F.col("loyal") + 120.0 * F.greatest(income, F.lit(-1.0)) + 30.0 * noise, F.lit(50.0))

    def act(self, users: DataFrame, policy: Policy, stream: str) -> DataFrame:
        """users with a_A drawn by the policy, its propensity, accept and cltv."""
        s, i = self.config.seed, F.col("user_id")
        p = policy.probs()
        u = uniform(s, stream + "action", i)
        places = F.sequence(F.lit(1), F.size(p))
        reached = F.filter(places, lambda k: F.aggregate(F.slice(p, F.lit(1), k), F.lit(0.0), lambda a, x: a + x) > u)
        drawn = users.withColumn("__p", p).withColumn("a_A", F.coalesce(F.element_at(reached, F.when(F.size(reached) > 0, 1).otherwise(F.lit(None).cast("int"))), F.size("__p")) - 1)
        drawn = drawn.withColumn("propensity_A", F.greatest(F.element_at("__p", F.col("a_A") + 1), F.lit(1e-6)))
        drawn = drawn.withColumn("accept", (uniform(s, stream + "accept", i) < F.element_at(self.accept_probabilities(), F.col("a_A") + 1)).cast("int"))
        cltv = self.base_cltv(normal(s, stream + "base", i)) + F.col("accept") * F.element_at(self.uplifts(), F.col("a_A") + 1) + 25.0 * normal(s, stream + "cltv", i)
        return drawn.withColumn("cltv", F.greatest(cltv, F.lit(10.0))).drop("__p")

    def simulate_logs(self, policy: Policy, users: DataFrame | None = None, propensity: bool = False) -> DataFrame:
        out = self.act(self.sample_users() if users is None else users, policy, "log")
        return out if propensity else out.drop("propensity_A")

    def oracle_value(self, policy: Policy, users: DataFrame | None = None, target: str = "accept", n_mc: int = 1) -> float:
        """Mean target under the policy: ``n_mc`` simulated passes over the users."""
        users = self.sample_users() if users is None else users
        runs = [self.act(users, policy, f"oracle{k}").agg(F.avg(target).alias("v")) for k in range(n_mc)]
        out = runs[0]
        for r in runs[1:]:
            out = out.union(r)
        return out.agg(F.avg("v")).first()[0]

    def exact_accept_value(self, policy: Policy, users: DataFrame | None = None) -> float:
        """Mean over users of the sum over actions of probability times acceptance, without simulation."""
        users = self.sample_users() if users is None else users
        return users.agg(F.avg(F.aggregate(F.zip_with(policy.probs(), self.accept_probabilities(), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))).first()[0]
