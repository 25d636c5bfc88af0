"""Direct single-recording formulas the distributed operators are compared with."""

import numpy as np


def zscore(x, ref=None):
    ref = x if ref is None else ref
    sd = np.maximum(ref.std(axis=1, keepdims=True), 1e-8)
    return np.clip((x - ref.mean(axis=1, keepdims=True)) / sd, -10, 10)


def design(x, lap, P, K):
    n, t = x.shape
    powers = [np.linalg.matrix_power(lap, k) for k in range(K + 1)]
    cols = [(powers[k] @ x[:, P - p:t - p]).T.ravel() for p in range(1, P + 1)
            for k in range(K + 1)]
    return np.stack(cols, axis=1), x[:, P:].T.ravel()


def fit(x, lap, P, K, ridge=5e-3):
    r, y = design(x, lap, P, K)
    return np.linalg.solve(r.T @ r + ridge * np.eye(r.shape[1]), r.T @ y)


def radius(h, lap, P, K):
    n = len(lap)
    blocks = [sum(h[p * (K + 1) + k] * np.linalg.matrix_power(lap, k) for k in range(K + 1))
              for p in range(P)]
    c = np.zeros((n * P, n * P))
    c[:n] = np.hstack(blocks)
    c[n:, :-n] = np.eye(n * (P - 1)) if P > 1 else c[n:, :-n]
    return np.abs(np.linalg.eigvals(c)).max()


def score(h, x, lap, P, K):
    r, y = design(x, lap, P, K)
    rss = ((y - r @ h) ** 2).sum()
    mse = rss / len(y)
    return (rss, 1 - rss / (((y - y.mean()) ** 2).sum() + 1e-10), mse,
            len(y) * np.log(mse + 1e-10) + len(h) * np.log(len(y)))


def gain(h, lam, P, K, n_omega):
    w = np.linspace(0, np.pi, n_omega)
    taps = np.stack([sum(h[p * (K + 1) + k] * lam ** k for k in range(K + 1)) for p in range(P)])
    z = np.exp(-1j * np.outer(w, np.arange(1, P + 1)))
    den = 1 - z @ taps
    den = np.where(np.abs(den) < 1e-3, den + 1e-3, den)
    return np.abs(1 / den)
