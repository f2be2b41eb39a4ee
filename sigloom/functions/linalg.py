"""Batched matrix helpers; arrays have the batch first, matrices last."""

from __future__ import annotations

import warnings

import numpy as np


def covariances(x: np.ndarray) -> np.ndarray:
    """Centred covariance (over n) of batches of channels x times."""
    c = x - x.mean(-1, keepdims=True)
    return c @ c.swapaxes(-1, -2) / x.shape[-1]


def shrink_oas(c: np.ndarray, n: float | np.ndarray) -> np.ndarray:
    """Oracle approximating shrinkage of covariances of ``n`` samples towards a multiple of the identity (Chen et al. 2010)."""
    p = c.shape[-1]
    mu = np.trace(c, axis1=-2, axis2=-1) / p
    alpha = np.square(c).mean((-1, -2))
    below = (n + 1) * (alpha - mu**2 / p)
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = np.where(below == 0, 1.0, np.minimum(1.0, (alpha + mu**2) / below))
    return (1 - rho)[..., None, None] * c + (rho * mu)[..., None, None] * np.eye(p)


def oas(x: np.ndarray) -> np.ndarray:
    return shrink_oas(covariances(x), x.shape[-1])


def spectral(c: np.ndarray, f) -> np.ndarray:
    """A function of symmetric matrices through their eigenvalues."""
    values, vectors = np.linalg.eigh(c)
    return (vectors * f(values)[..., None, :]) @ vectors.swapaxes(-1, -2)


def sqrtm(c: np.ndarray) -> np.ndarray:
    return spectral(c, lambda v: np.sqrt(np.maximum(v, 0)))


def invsqrtm(c: np.ndarray) -> np.ndarray:
    return spectral(c, lambda v: 1 / np.sqrt(np.maximum(v, 1e-300)))


def logm(c: np.ndarray) -> np.ndarray:
    return spectral(c, lambda v: np.log(np.maximum(v, 1e-300)))


def expm(c: np.ndarray) -> np.ndarray:
    return spectral(c, np.exp)


#: Matrices up to this side have their eigenvalues by rotations of many at once.
_ROTATED = 6


def riemann_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Affine-invariant distance: from the eigenvalues of b seen through a's Cholesky factor."""
    factor = np.linalg.cholesky(a)
    half = np.linalg.solve(factor, b)
    seen = np.linalg.solve(factor, half.swapaxes(-1, -2))
    values = np.linalg.eigvalsh((seen + seen.swapaxes(-1, -2)) / 2)
    return np.sqrt(np.square(np.log(np.maximum(values, 1e-300))).sum(-1))


def riemann_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Affine-invariant distance of every matrix of ``a`` (rows) to every one of ``b``; a's Cholesky factors are inverted once."""
    inverse = np.linalg.inv(np.linalg.cholesky(a))
    if a.shape[-1] == 2:
        # The seen matrix in its three entries, and its eigenvalues about their middle.
        w, x, y = (inverse[:, i, j, None] for i, j in ((0, 0), (1, 0), (1, 1)))
        p, q, r = (b[:, i, j] for i, j in ((0, 0), (0, 1), (1, 1)))
        s, t, u = w * w * p, w * (x * p + y * q), x * x * p + 2 * x * y * q + y * y * r
        middle, half = (s + u) / 2, np.hypot((s - u) / 2, t)
        high = middle + half
        low = (w * y) ** 2 * (p * r - q * q) / np.maximum(high, 1e-300)
        values = np.stack([low, high], -1)
    elif a.shape[-1] <= _ROTATED:
        # Entries of the seen matrices, each an array over all pairs, in one product with b's.
        n = a.shape[-1]
        entries = [(i, j) for i in range(n) for j in range(i, n)]
        turn = np.stack([np.stack([inverse[:, i, k] * inverse[:, j, m] + (inverse[:, i, m] * inverse[:, j, k] if k != m else 0) for k, m in entries], -1) for i, j in entries])
        seen = (turn.reshape(-1, len(entries)) @ np.stack([b[:, k, m] for k, m in entries])).reshape(len(entries), len(a), len(b))
        values = np.stack(rotated_values(dict(zip(entries, seen, strict=True)), n), -1)
    else:
        seen = inverse[:, None] @ b[None] @ inverse.swapaxes(-1, -2)[:, None]
        values = np.linalg.eigvalsh((seen + seen.swapaxes(-1, -2)) / 2)
    return np.sqrt(np.square(np.log(np.maximum(values, 1e-300))).sum(-1))


def rotated_values(m: dict[tuple[int, int], np.ndarray], n: int, tolerance: float = 1e-13, sweeps: int = 30) -> list[np.ndarray]:
    """Eigenvalues of many small symmetric matrices at once, given by their entries (i, j), i <= j, which are overwritten: cyclic Jacobi rotations, until no entry beside the middle is above ``tolerance`` of the geometric mean of the two on it."""
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    at = lambda i, j: (i, j) if i < j else (j, i)
    for _ in range(sweeps):
        if not any((m[i, j] * m[i, j] > tolerance**2 * np.abs(m[i, i] * m[j, j])).any() for i, j in pairs):
            break
        for i, j in pairs:
            off, gap = m[i, j], m[j, j] - m[i, i]
            t = 2 * off
            root = np.sqrt(gap * gap + t * t)
            root += np.abs(gap)
            root += 1e-300
            t /= np.copysign(root, gap)
            shift = t * off
            m[i, i] -= shift
            m[j, j] += shift
            off[...] = 0
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            for k in range(n):
                if k not in (i, j):
                    x, y = m[at(k, i)], m[at(k, j)]
                    both = s * x + c * y
                    x *= c
                    x -= s * y
                    y[...] = both
    return [m[i, i] for i in range(n)]


def riemann_mean(c: np.ndarray, weights: np.ndarray | None = None, tolerance: float = 1e-8, most: int = 50) -> np.ndarray:
    """Weighted mean in the affine-invariant metric, by fixed-point steps from the arithmetic mean."""
    w = np.ones(len(c)) if weights is None else np.asarray(weights, float)
    w = w / w.sum()
    mean = np.tensordot(w, c, 1)
    for _ in range(most):
        root, inverse = sqrtm(mean), invsqrtm(mean)
        step = np.tensordot(w, logm(inverse @ c @ inverse), 1)
        mean = root @ expm(step) @ root
        mean = (mean + mean.T) / 2
        if np.linalg.norm(step) < tolerance:
            break
    return mean


def geodesic(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The point at share ``t`` of the way from a to b: the mean of both with weights 1 - t and t."""
    root, inverse = sqrtm(a), invsqrtm(a)
    out = root @ spectral(inverse @ b @ inverse, lambda v: np.maximum(v, 1e-300) ** t) @ root
    return (out + out.T) / 2


def transport_matrix(mean: np.ndarray, general: np.ndarray) -> np.ndarray:
    """E with E mean E' = general (Yair et al. 2019), through symmetric roots only."""
    root, inverse = sqrtm(mean), invsqrtm(mean)
    return root @ sqrtm(inverse @ general @ inverse) @ inverse


def upper(c: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Upper triangles with the diagonal, row by row; off-diagonal entries times ``scale``."""
    i, j = np.triu_indices(c.shape[-1])
    return c[..., i, j] * np.where(i == j, 1.0, scale)


def from_upper(v: np.ndarray) -> np.ndarray:
    p = int((np.sqrt(8 * v.shape[-1] + 1) - 1) / 2)
    i, j = np.triu_indices(p)
    out = np.zeros((*v.shape[:-1], p, p))
    out[..., i, j] = v
    out[..., j, i] = v
    return out


def tangent(c: np.ndarray, reference: np.ndarray) -> np.ndarray:
    inverse = invsqrtm(reference)
    return upper(logm(inverse @ c @ inverse), np.sqrt(2))


def fix_signs(rows: np.ndarray) -> np.ndarray:
    """Turn every row so that its largest entry by size is positive."""
    at = np.abs(rows).argmax(1)
    return rows * np.sign(rows[np.arange(len(rows)), at])[:, None]


def csp(c0: np.ndarray, c1: np.ndarray, filters: int) -> tuple[np.ndarray, np.ndarray]:
    """Spatial filters and patterns of two class means, ordered by how far their eigenvalue is from one half."""
    white = invsqrtm(c0 + c1)
    values, vectors = np.linalg.eigh(white @ c0 @ white)
    order = np.argsort(-np.abs(values - 0.5), kind="stable")
    w = fix_signs((vectors[:, order].T @ white))
    return w[:filters], np.linalg.pinv(w).T[:filters]


def log_variance(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(np.einsum("fi,nij,fj->nf", w, c, w), 1e-300))


def log_variance_each(c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``log_variance`` with filters (flat) of its own for every matrix."""
    f = w.reshape(len(w), -1, c.shape[-1])
    return np.log(np.maximum(np.einsum("nfi,nij,nfj->nf", f, c, f), 1e-300))


def weighted_reference_distance(x: np.ndarray, y: np.ndarray, reference: np.ndarray) -> np.ndarray:
    return np.linalg.norm(upper(reference @ from_upper(x - y)), axis=-1)


def weighted_reference_distances(x: np.ndarray, y: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """``weighted_reference_distance`` of every row of ``x`` to every row of ``y``, summed in the order of the entries."""
    p = len(reference)
    of = {}
    for k, (i, j) in enumerate(zip(*np.triu_indices(p), strict=True)):
        of[i, j] = of[j, i] = x[:, k, None] - y[:, k]
    total = np.zeros((len(x), len(y)))
    for i, j in zip(*np.triu_indices(p), strict=True):
        entry = sum((reference[i, k] * of[k, j] for k in range(1, p)), reference[i, 0] * of[0, j])
        total += entry * entry
    return np.sqrt(total)


def third_moments(x: np.ndarray) -> np.ndarray:
    """Unique entries of the shrunk third central moment tensor of channels x times."""
    c = x - x.mean(-1, keepdims=True)
    d, n = c.shape[-2], c.shape[-1]
    m = np.einsum("bit,bjt,bkt->bijk", c, c, c, optimize=True) / n
    norm, s = np.square(m).sum((1, 2, 3)), np.einsum("biii->b", m)
    below = (n + 1 - 2 / d) * norm + (1 - n / d) * s**2
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = np.clip(np.nan_to_num(((1 - 2 / d) * norm + s**2) / below, nan=1.0), 0, 1)
    keep = [(i, j, k) for i in range(d) for j in range(i, d) for k in range(j, d)]
    i, j, k = np.array(keep).T
    return ((1 - rho)[:, None, None, None] * m)[:, i, j, k]


def independent_components(x: np.ndarray, seed: int = 42, most: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Unmixing matrix by symmetric fixed-point iteration with tanh (FastICA) on channels x times."""
    c = x - x.mean(1, keepdims=True)
    white = invsqrtm(c @ c.T / c.shape[1])
    z = white @ c
    w = np.linalg.qr(np.random.RandomState(seed).normal(size=(len(x), len(x))))[0]
    for _ in range(most):
        g = np.tanh(w @ z)
        new = g @ z.T / z.shape[1] - np.diag((1 - g**2).mean(1)) @ w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max() < tolerance
        w = new
        if done:
            break
    return fix_signs(w @ white)


def majorise(d: np.ndarray, x: np.ndarray, steps: int, tolerance: float) -> tuple[np.ndarray, bool]:
    """Points moved by stress majorisation until a step lowers the stress by ``tolerance`` of itself or less, or it is nothing beside the distances, and whether that came within ``steps``."""
    last, nothing = np.inf, 1e-15 * np.square(d).sum()
    for _ in range(steps):
        now = np.sqrt(np.square(x[:, None] - x[None]).sum(-1))
        stress = np.square(now - d).sum() / 2
        if stress <= nothing or not last - stress > tolerance * stress:
            return x, True
        last = stress
        pull = np.divide(d, now, out=np.zeros(d.shape), where=now > 0)
        x = (pull.sum(1)[:, None] * x - pull @ x) / len(x)
    return x, False


def block_pull(d: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Of points ``a`` and ``b`` at wanted distances ``d``: the squared misfits' sum, and what b pulls a to and a pulls b to, summed. ``room``: two arrays as large as ``d`` or larger, to work in."""
    x, y = (np.empty((2, *d.shape)) if room is None else room)[:, : len(a), : len(b)]
    np.subtract(a[:, 0, None], b[:, 0].copy(), out=x)
    np.subtract(a[:, 1, None], b[:, 1].copy(), out=y)
    x *= x
    y *= y
    x += y
    now = np.sqrt(x, out=x)
    misfit = np.subtract(now, d, out=y)
    stress = float(np.vdot(misfit, misfit))
    if not now.all():
        now[now == 0] = np.inf
    pull = np.divide(d, now, out=now)
    # Vector by vector: a product with three columns takes twice as long.
    at_a, at_b = (np.column_stack([m @ v for v in (np.ones(len(x)), x[:, 0].copy(), x[:, 1].copy())]) for m, x in ((pull, b), (pull.T, a)))
    return stress, at_a[:, :1] * a - at_a[:, 1:], at_b[:, :1] * b - at_b[:, 1:]


def majorise_blocks(blocks: list[tuple[int, int, np.ndarray]], x: dict[int, np.ndarray], steps: int, tolerance: float) -> tuple[dict[int, np.ndarray], bool]:
    """``majorise`` of a matrix in blocks (p, q, distances), p <= q, of chunks ``x`` of the points: the other half is never made."""
    n, last = sum(map(len, x.values())), np.inf
    room = np.empty((2, *[max(map(len, x.values()))] * 2))
    nothing = 1e-15 * sum((1 if p == q else 2) * float(np.vdot(d, d)) for p, q, d in blocks)
    for _ in range(steps):
        stress, moved = 0.0, {p: np.zeros(v.shape) for p, v in x.items()}
        for p, q, d in blocks:
            s, at_p, at_q = block_pull(d, x[p], x[q], room)
            stress += s / 2 if p == q else s
            moved[p] += at_p
            if p != q:
                moved[q] += at_q
        if stress <= nothing or not last - stress > tolerance * stress:
            return x, True
        last = stress
        x = {p: v / n for p, v in moved.items()}
    return x, False


def metric_mds(d: np.ndarray, dims: int = 2, steps: int = 300) -> np.ndarray:
    """Points whose distances fit ``d``: classical start, then stress majorisation."""
    n = len(d)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-centre @ (d**2) @ centre / 2)
    x = fix_signs((vectors[:, ::-1][:, :dims] * np.sqrt(np.maximum(values[::-1][:dims], 0))).T).T
    if x.shape[1] < dims:
        x = np.pad(x, ((0, 0), (0, dims - x.shape[1])))
    x, done = majorise(d, x, steps, 1e-10)
    if not done:
        warnings.warn(f"the stress still falls after {steps} steps", stacklevel=2)
    return x
