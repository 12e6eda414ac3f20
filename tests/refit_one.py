"""One weighted resample with its models fitted to it, by plain arrays: what the summed replicates are held against."""

import numpy as np

from lodestar.operators.estimators import WEIGHTED
from lodestar.operators.models import min_norm, newton


def _standardised(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    mean = c @ x / c.sum()
    scale = np.sqrt(c @ (x - mean) ** 2 / c.sum())
    return (x - mean) / np.where(scale > 0, scale, 1.0)


def _newton(z: np.ndarray, y: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Weighted multinomial (k > 1) or binary (k = 1) logistic coefficients, unit L2 penalty apart from the intercept."""
    d = z.shape[1]
    if k == 1:

        def step(b):
            m = z @ b
            q = 1 / (1 + np.exp(-m))
            return c @ (np.logaddexp(0, m) - y * m), z.T @ (c * (q - y)), (z * (c * q * (1 - q))[:, None]).T @ z

    else:

        def step(b):
            s = z @ b.reshape(k, d).T
            s = s - s.max(1, keepdims=True)
            e = np.exp(s)
            q = e / e.sum(1, keepdims=True)
            h = np.zeros((k, d, k, d))
            for i in range(k):
                for j in range(k):
                    h[i, :, j, :] = (z * (c * q[:, i] * ((i == j) - q[:, j]))[:, None]).T @ z
            return c @ (np.log(e.sum(1)) - s[np.arange(len(y)), y]), ((q - np.eye(k)[y]) * c[:, None]).T.dot(z).ravel(), h.reshape(k * d, k * d)

    return newton(step, max(k, 1) * d, np.tile(np.concatenate([[0.0], np.ones(d - 1)]), max(k, 1)))


def refit_value(x, a, y, pb, pa, c, method: str, binary: bool, fit_propensity: bool, clip: float | None, tau: float) -> tuple[float, float]:
    """(V_A, V_B) of one weighted resample with its models fitted to it."""
    x = _standardised(x, c)
    n, k = c.sum(), pb.shape[1]
    seen = np.unique(a)
    v_a = float(c @ y / n)
    taken = pb[np.arange(len(a)), a]
    w = taken / pa
    if fit_propensity and method in WEIGHTED:
        z = np.hstack([np.ones((len(x), 1)), x])
        own = np.searchsorted(seen, a)
        if len(seen) > 1:
            s = z @ _newton(z, own, c, len(seen)).reshape(len(seen), -1).T
            e = np.exp(s - s.max(1, keepdims=True))
            q = np.clip(e / e.sum(1, keepdims=True), 1e-6, 1 - 1e-6)[np.arange(len(a)), own]
        else:
            q = np.ones(len(a))
        w = taken / q
    v = np.minimum(w, clip) if clip is not None else w
    if method == "ips":
        return v_a, float(c @ (v * y) / n)
    if method == "snips":
        return v_a, float(c @ (v * y) / (c @ v + 1e-12))
    z = np.hstack([np.ones((len(x), 1)), x, np.eye(k)[a]])
    logistic = binary and len(np.unique(y)) == 2
    if logistic:
        beta = _newton(z, y, c, 1)
    else:
        beta = min_norm((z * c[:, None]).T @ z, z.T @ (c * y))
    base = z[:, : 1 + x.shape[1]] @ beta[: 1 + x.shape[1]]
    effects = np.where(np.isin(np.arange(k), seen), beta[1 + x.shape[1] :], 0.0)
    mu = base[:, None] + effects[None, :]
    if logistic:
        mu = np.clip(1 / (1 + np.exp(-mu)), 1e-6, 1 - 1e-6)
    dm = (pb * mu).sum(1)
    res = y - mu[np.arange(len(a)), a]
    total = c @ dm
    if method == "dm":
        return v_a, float(total / n)
    if method == "dr":
        return v_a, float((total + c @ (v * res)) / n)
    if method == "sndr":
        return v_a, float(total / n + c @ (v * res) / n / (c @ v / n + 1e-12))
    return v_a, float((total + c @ (np.where(w <= tau, w, 0.0) * res)) / n)
