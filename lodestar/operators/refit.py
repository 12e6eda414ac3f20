"""Bootstrap replicates with nuisance models fitted again, from sums over the rows where they lie.

Rows stand once, each with the counts of its cluster in all replicates (one byte a replicate). A pass adds
up small dense matrices for every replicate at once: the first gives means, deviations and the least-squares
matrices, each Newton step of a logistic model is one more, the last gives the estimators' sums. No task
holds a replicate; the driver holds matrices of (features x classes) squared for each.

Features are standardised within each replicate by a change of coordinates of the summed matrices.
A replicate that draws a row with a missing reward, feature or weight is undefined (NaN).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import bootstrap as boot
from lodestar.operators.estimators import MODELLED, TINY, WEIGHTED
from lodestar.operators.models import LOW, min_norm

#: Numbers that a block of rows times replicates times classes may have.
BLOCK = 1 << 20
_UNSEEN = -1e30


def draws(keys: DataFrame, n_boot: int, salt: str = "") -> DataFrame:
    """(__key, counts): how often each replicate draws the key, a byte each (beyond 255, a chance below 10^-500, does not occur)."""
    counts = boot.multinomial_counts(keys.sparkSession, keys.count(), n_boot, salt).groupBy("rank").agg(F.collect_list("b").alias("b"), F.collect_list("cnt").alias("n"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                b, n = part.column("b"), part.column("n")
                out = np.zeros((part.num_rows, n_boot), np.uint8)
                out[np.repeat(np.arange(part.num_rows), b.value_lengths().to_numpy()), b.flatten().to_numpy() - 1] = n.flatten().to_numpy()
                yield pa.RecordBatch.from_pydict({"rank": part.column("rank"), "counts": pa.array([r.tobytes() for r in out], pa.binary())})

    return counts.mapInArrow(dense, "rank long, counts binary").join(keys, "rank").select(F.col("key").alias("__key"), "counts")


class Block:
    """Some rows: design z = (1, x, dummies), action, reward, policy, weight and (rows, replicates) counts."""

    def __init__(self, part: pa.RecordBatch, n_boot: int, weighted: bool) -> None:
        n = part.num_rows
        table = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
        x, self.pb = table("x"), table("pb")
        self.a = part.column("a").to_numpy(zero_copy_only=False).astype(int)
        self.y = part.column("y").to_numpy(zero_copy_only=False).astype(float)
        self.taken = self.pb[np.arange(n), self.a]
        with np.errstate(divide="ignore", invalid="ignore"):
            self.w = self.taken / part.column("pa").to_numpy(zero_copy_only=False).astype(float)
        no_y = ~np.isfinite(self.y)
        bad = no_y | ~np.isfinite(x).all(1) | ~np.isfinite(self.pb).all(1) | (np.isnan(self.w) & weighted)
        self.missing = np.stack([no_y, bad], 1).astype(float)
        self.y[no_y], x[bad], self.pb[bad], self.taken[bad], self.w[bad | np.isnan(self.w)] = 0, 0, 0, 0, 0
        self.z = np.hstack([np.ones((n, 1)), x, np.eye(self.pb.shape[1])[self.a]])
        self.features = 1 + x.shape[1]
        counts = part.column("counts").cast(pa.binary(n_boot))
        self.c = np.frombuffer(counts.buffers()[1], np.uint8)[counts.offset * n_boot :][: n * n_boot].reshape(n, n_boot).astype(float)


def _squares(z: np.ndarray) -> np.ndarray:
    return (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)


def summed(rows: DataFrame, n_boot: int, classes: int, weighted: bool, of_block: Callable[[Block], np.ndarray], size: int, which: np.ndarray | None = None) -> np.ndarray:
    """(replicates, size): the sums of of_block over all rows; which: only these replicates' counts."""
    most = max(1, BLOCK // (n_boot * classes))
    which = np.arange(n_boot) if which is None else which

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(which), size))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                block = Block(batch.slice(at, most), n_boot, weighted)
                block.c = block.c[:, which]
                total += of_block(block)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(which))), "v": pa.array([r.tobytes() for r in total], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [sum(np.frombuffer(v) for v in pdf["v"]).tobytes()]})

    out = np.zeros((len(which), size))
    for r in rows.mapInArrow(partial, "i long, v binary").groupBy("i").applyInPandas(add, "i long, v binary").collect():
        out[r["i"]] = np.frombuffer(r["v"])
    return out


def newtons(step, size: int, shift: np.ndarray, penalised: np.ndarray, free: np.ndarray, max_iter: int = 50, tol: float = 1e-9) -> np.ndarray:
    """models.newton for many problems at once; step(b, which) -> (losses, gradients, Hessians) of the problems named.

    free: (problems, size), coordinates that move. shift: coordinates whose common shift changes nothing.
    """
    n = len(free)
    b, move, t, turns = np.zeros((n, size)), np.zeros((n, size)), np.ones(n), np.zeros(n, int)

    def aim(i: int, g: np.ndarray, h: np.ndarray) -> None:
        own = np.flatnonzero(free[i])
        s = shift[own].astype(float)
        h = h[np.ix_(own, own)] + np.diag(penalised[own]) + 1e-10 * np.eye(len(own))
        h += np.outer(s, s) * max(np.trace(h) / len(own), 1e-10)
        move[i], t[i] = 0.0, 1.0
        move[i, own] = np.linalg.solve(h, (g + penalised * b[i])[own])

    active = np.arange(n)
    if not n:
        return b
    value, g, h = step(b, active)
    for i in active:
        aim(i, g[i], h[i])
    while len(active):
        trial = b[active] - t[active, None] * move[active]
        loss, g, h = step(trial, active)
        new = loss + 0.5 * (penalised * trial * trial).sum(1)
        left = []
        for at, i in enumerate(active):
            if not (new[at] <= value[i] + 1e-12 * abs(value[i]) or t[i] < 1e-4):
                t[i] /= 2
                left.append(i)
                continue
            small = np.abs(trial[at] - b[i]).max() < tol
            b[i], value[i] = trial[at], new[at]
            turns[i] += 1
            if not small and turns[i] < max_iter:
                aim(i, g[at], h[at])
                left.append(i)
        active = np.array(left, int)
    return b


def _softmax(z: np.ndarray, coef: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, scores less the log of the sum of their exponentials) as (rows, replicates, classes); coef (replicates, classes, features)."""
    s = np.einsum("nd,bkd->nbk", z, coef, optimize=True)
    s -= s.max(2, keepdims=True)
    e = np.exp(s)
    total = e.sum(2, keepdims=True)
    return e / total, s - np.log(total)


def refit_replicates(rows: DataFrame, n_boot: int, k: int, features: int, method: str, binary: bool, fit_propensity: bool, clip: float | None, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """(V_A, V_B) of every replicate; rows: x, a, y, pb, pa, counts."""
    fit_propensity = fit_propensity and method in WEIGHTED
    logged = method in WEIGHTED and not fit_propensity
    d, p = 1 + features, 1 + features + k

    def first(r: Block) -> np.ndarray:
        return r.c.T @ np.hstack([_squares(np.hstack([r.z, r.y[:, None]])), r.missing])

    total = summed(rows, n_boot, k, logged, first, (p + 1) ** 2 + 2)
    gram = total[:, : (p + 1) ** 2].reshape(n_boot, p + 1, p + 1)
    lost_a, lost_b = total[:, -2] > 0, total[:, -1] > 0
    n, sum_y = gram[:, 0, 0], gram[:, 0, p]
    mean, square = gram[:, 0, 1:d] / n[:, None], np.diagonal(gram, axis1=1, axis2=2)[:, 1:d] / n[:, None]
    variance = square - mean**2
    scale = np.sqrt(np.where(variance > 1e-13 * np.maximum(square, 1.0), variance, 1.0))
    seen = np.diagonal(gram, axis1=1, axis2=2)[:, d:p] > 0
    #: z of the standardised features is z @ turn.
    turn = np.tile(np.eye(p), (n_boot, 1, 1))
    for j in range(features):
        turn[:, 0, 1 + j], turn[:, 1 + j, 1 + j] = -mean[:, j] / scale[:, j], 1 / scale[:, j]

    coef = np.zeros((n_boot, k, d))
    alone = seen.sum(1) < 2
    if fit_propensity and not alone.all():
        fits = np.flatnonzero(~alone)
        inner = turn[:, :d, :d]

        def raw(b: np.ndarray, own: np.ndarray) -> np.ndarray:
            out = np.einsum("bij,bkj->bki", inner[own], b.reshape(-1, k, d))
            out[..., 0][~seen[own]] = _UNSEEN
            return out

        def multinomial(b: np.ndarray, which: np.ndarray):
            own = fits[which]
            c = raw(b, own)

            def batch(r: Block) -> np.ndarray:
                z = r.z[:, :d]
                q, low = _softmax(z, c)
                at = (np.arange(len(z)), slice(None), r.a)
                loss = -(r.c * np.where(r.c > 0, low[at], 0.0)).sum(0)
                away = q.copy()
                away[at] -= 1
                g = np.einsum("nb,nbk,nd->bkd", r.c, away, z, optimize=True)
                h, zz = np.zeros((len(own), k, d, k, d)), _squares(z)
                for i in range(k):
                    for j in range(i, k):
                        part = ((r.c * q[:, :, i] * ((i == j) - q[:, :, j])).T @ zz).reshape(-1, d, d)
                        h[:, i, :, j, :] = part
                        h[:, j, :, i, :] = part
                return np.hstack([loss[:, None], g.reshape(len(own), -1), h.reshape(len(own), -1)])

            m = k * d
            t = summed(rows, n_boot, k, logged, batch, 1 + m + m * m, own)
            g = np.einsum("bji,bkj->bki", inner[own], t[:, 1 : 1 + m].reshape(-1, k, d)).reshape(-1, m)
            h = np.einsum("bui,bkuqv,bvj->bkiqj", inner[own], t[:, 1 + m :].reshape(-1, k, d, k, d), inner[own], optimize=True)
            return t[:, 0], g, h.reshape(-1, m, m)

        intercepts = np.tile(np.arange(d) == 0, k)
        b = newtons(multinomial, k * d, intercepts, np.where(intercepts, 0.0, 1.0), np.repeat(seen[fits], d, 1))
        coef[fits] = raw(b, fits)

    beta = np.zeros((n_boot, p))
    logistic = np.zeros(n_boot, bool)
    if method in MODELLED:
        logistic = (sum_y > 0) & (sum_y < n) & ~lost_b if binary else logistic
        for i in np.flatnonzero(~logistic & ~lost_b):
            beta[i] = turn[i] @ min_norm(turn[i].T @ gram[i, :p, :p] @ turn[i], turn[i].T @ gram[i, :p, p])
        fits_y = np.flatnonzero(logistic)

        def bernoulli(b: np.ndarray, which: np.ndarray):
            own = fits_y[which]
            c = np.einsum("bij,bj->bi", turn[own], b)

            def batch(r: Block) -> np.ndarray:
                m = r.z @ c.T
                q = 1 / (1 + np.exp(-m))
                y = r.y[:, None]
                return np.hstack([(r.c * (np.logaddexp(0, m) - y * m)).sum(0)[:, None], (r.c * (q - y)).T @ r.z, (r.c * q * (1 - q)).T @ _squares(r.z)])

            t = summed(rows, n_boot, k, logged, batch, 1 + p + p * p, own)
            g = np.einsum("bji,bj->bi", turn[own], t[:, 1 : 1 + p])
            return t[:, 0], g, np.einsum("bui,buv,bvj->bij", turn[own], t[:, 1 + p :].reshape(-1, p, p), turn[own], optimize=True)

        start = np.concatenate([[0.0], np.ones(p - 1)])
        b = newtons(bernoulli, p, np.zeros(p, bool), start, np.ones((len(fits_y), p), bool))
        beta[fits_y] = np.einsum("bij,bj->bi", turn[fits_y], b)
        beta[:, d:] = np.where(seen, beta[:, d:], 0.0)

    def last(r: Block) -> np.ndarray:
        def mean_of(effect: np.ndarray) -> np.ndarray:
            m = base + effect
            return np.where(logistic, np.clip(1 / (1 + np.exp(-m)), LOW, 1 - LOW), m) if binary else m

        y = r.y[:, None]
        w = r.w[:, None]
        if fit_propensity:
            q = _softmax(r.z[:, :d], coef)[0][np.arange(len(y)), :, r.a]
            w = r.taken[:, None] / np.where(alone, 1.0, np.clip(q, LOW, 1 - LOW))
        v = np.minimum(w, clip) if clip is not None else w
        base = r.z[:, :d] @ beta[:, :d].T
        dm = sum(r.pb[:, [i]] * mean_of(beta[:, d + i]) for i in range(k))
        res = y - mean_of(beta[:, d:].T[r.a])
        with np.errstate(invalid="ignore"):
            parts = (dm, v, v * y, v * res, np.where(w <= tau, w, 0.0) * res)
            return np.stack([np.where(r.c > 0, r.c * x, 0.0).sum(0) for x in parts], 1)

    dm, v, vy, vr, sr = summed(rows, n_boot, k, logged, last, 5).T
    with np.errstate(invalid="ignore", divide="ignore"):
        v_b = {"ips": vy / n, "snips": vy / (v + TINY), "dm": dm / n, "dr": (dm + vr) / n, "sndr": dm / n + vr / n / (v / n + TINY), "switch_dr": (dm + sr) / n}[method]
    return np.where(lost_a, np.nan, sum_y / n), np.where(lost_a | lost_b, np.nan, v_b)
