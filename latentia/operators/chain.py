"""Hidden Markov kernels over batches of equally long sequences: numpy, scaled probabilities, no loop over sequences."""

from __future__ import annotations

import numpy as np

from latentia.operators.params import Params


def project(v: np.ndarray, k: int) -> np.ndarray:
    """Keeps the k greatest of the last axis and the sum; k = 0 keeps all."""
    n = v.shape[-1]
    if k <= 0 or k >= n:
        return v
    kept = np.zeros_like(v)
    at = np.argpartition(-v, k - 1, axis=-1)[..., :k]
    np.put_along_axis(kept, at, np.take_along_axis(v, at, -1), -1)
    total = kept.sum(-1, keepdims=True)
    return kept * (v.sum(-1, keepdims=True) / np.where(total > 0, total, 1))


def width(n: int, approx: bool) -> int:
    return n // 8 if approx else 0


def plain(p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return p.pi[:, 0], p.T[:, :, 0], p.f[:, 0], p.E[:, :, 0]


def forward(e: np.ndarray, pi: np.ndarray, T: np.ndarray, f: np.ndarray, k: int = 0):
    """e[B,L,N]: emission probabilities. Scaled alphas, scales and log-likelihoods."""
    B, L, N = e.shape
    alpha, scale = np.empty((B, L, N)), np.empty((B, L))
    a = e[:, 0] * pi
    for t in range(L):
        if t:
            a = (project(a, k) @ T.T) * e[:, t]
        scale[:, t] = a.sum(1)
        a = a / np.where(scale[:, t] > 0, scale[:, t], 1)[:, None]
        alpha[:, t] = a
    end = (project(a, k) * f).sum(1)
    with np.errstate(divide="ignore"):
        return alpha, scale, np.log(scale).sum(1) + np.log(end), end


def backward(e: np.ndarray, T: np.ndarray, f: np.ndarray, scale: np.ndarray, k: int = 0) -> np.ndarray:
    B, L, N = e.shape
    beta = np.empty((B, L, N))
    beta[:, -1] = f
    for t in range(L - 2, -1, -1):
        beta[:, t] = (project(beta[:, t + 1] * e[:, t + 1], k) @ T) / scale[:, t + 1, None]
    return beta


def backward_likelihood(x: np.ndarray, p: Params) -> np.ndarray:
    """Log-likelihoods[B] of x[B,L] from the last position to the first, with scales of their own."""
    pi, T, f, E = plain(p)
    b, total = np.broadcast_to(f, (len(x), p.n)), np.zeros(len(x))
    for t in range(x.shape[1] - 1, -1, -1):
        b = b * E[x[:, t]]
        b = b @ (T if t else pi[:, None])
        scale = b.sum(1)
        with np.errstate(divide="ignore"):
            total += np.log(scale)
        b = b / np.where(scale > 0, scale, 1)[:, None]
    return total


def posteriors(x: np.ndarray, p: Params, approx: bool = False, e: np.ndarray | None = None):
    """x[B,L]: log-likelihoods[B], state posteriors[B,L,N], summed transition posteriors[N,N]."""
    pi, T, f, E = plain(p)
    e, k = E[x] if e is None else e, width(p.n, approx)
    alpha, scale, ll, end = forward(e, pi, T, f, k)
    beta = backward(e, T, f, scale, k)
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    xi = np.zeros_like(T)
    if x.shape[1] > 1:
        right = beta[:, 1:] * e[:, 1:] / (scale[:, 1:, None] * end[:, None, None])
        xi = T * (right.reshape(-1, p.n).T @ alpha[:, :-1].reshape(-1, p.n))
    return ll, gamma, xi


def viterbi(x: np.ndarray, p: Params, e: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best paths[B,L] and their log scores; the lowest state wins ties."""
    with np.errstate(divide="ignore"):
        pi, T, f, E = (np.log(a) for a in plain(p))
        e = E[x] if e is None else np.log(e)
    return best_path(pi, T, f, e)


def best_path(pi: np.ndarray, T: np.ndarray, f: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for additive scores."""
    B, L, N = e.shape
    back = np.empty((B, L, N), np.int64)
    d = e[:, 0] + pi
    for t in range(1, L):
        s = d[:, None, :] + T[None]
        back[:, t] = s.argmax(2)
        d = s.max(2) + e[:, t]
    d = d + f
    path = np.empty((B, L), np.int64)
    path[:, -1] = d.argmax(1)
    for t in range(L - 1, 0, -1):
        path[:, t - 1] = back[np.arange(B), t, path[:, t]]
    return path, d.max(1)


def path_score(path: np.ndarray, pi: np.ndarray, T: np.ndarray, f: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Score of given paths[B,L] under additive scores."""
    B, L = path.shape
    rows = np.arange(B)
    s = pi[path[:, 0]] + e[rows[:, None], np.arange(L)[None], path].sum(1) + f[path[:, -1]]
    return s + (T[path[:, 1:], path[:, :-1]].sum(1) if L > 1 else 0)


def merge_losses(x: np.ndarray, p: Params, occupancy: np.ndarray) -> np.ndarray:
    """For each pair of states (2i, 2i + 1) the change of log-likelihood, summed over positions, if they were one:
    forward scores add up, backward scores are averaged by occupancy."""
    pi, T, f, E = plain(p)
    e = E[x]
    alpha, scale, _, end = forward(e, pi, T, f)
    beta = backward(e, T, f, scale)
    both = alpha * beta
    total = both.sum(2, keepdims=True)
    a, b = both[..., 0::2], both[..., 1::2]
    w = occupancy[0::2] / np.maximum(occupancy[0::2] + occupancy[1::2], 1e-300)
    merged = (alpha[..., 0::2] + alpha[..., 1::2]) * (w * beta[..., 0::2] + (1 - w) * beta[..., 1::2])
    return np.log(np.maximum((total - a - b + merged) / total, 1e-300)).sum((0, 1))


def additive_posteriors(pi: np.ndarray, T: np.ndarray, f: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log partition sums[B] and state posteriors[B,L,N] of a linear model's additive scores e[B,L,N]."""
    top = e.max(2, keepdims=True)  # scores are exponentiated relative to their greatest
    a, t, z = pi.max(), T.max(), f.max()
    E, P, M, Z = np.exp(e - top), np.exp(pi - a), np.exp(T - t), np.exp(f - z)
    alpha, scale, ll, _ = forward(E, P, M, Z)
    gamma = alpha * backward(E, M, Z, scale)
    return ll + top.sum((1, 2)) + a + z + t * (e.shape[1] - 1), gamma / gamma.sum(2, keepdims=True)
