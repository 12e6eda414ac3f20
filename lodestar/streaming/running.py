"""Running estimates over a stream of scored decisions, an extension: the sums of the estimators are
additive, so a stream keeps them per window and a batch job may finalise any union of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.estimators import finalise, statistics


def windowed_sums(scored: DataFrame, method: str, time_col: str, window: str = "1 hour", watermark: str = "10 minutes", clip: float | None = None, tau: float = 20.0) -> DataFrame:
    """Sums of the method per event-time window; late rows beyond the watermark are left out of closed windows."""
    sums = statistics(method, clip, tau)
    return scored.withWatermark(time_col, watermark).groupBy(F.window(time_col, window).alias("window")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])


def finalised(sums: DataFrame, method: str, clip: float | None = None, tau: float = 20.0) -> DataFrame:
    """The estimate over all windows given."""
    names = list(statistics(method, clip, tau))
    return sums.agg(*[F.sum(c).alias(c) for c in names]).select(finalise(method, {c: F.col(c) for c in names}).alias("value"))
