"""Small numerics used inside tasks: hashed normals, decayed moments, projections."""

from __future__ import annotations

import math

import numpy as np

TOL = 1e-12
EPS = np.finfo(np.float64).eps


def hashed_units(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """(rows, width) uniforms in (0, 1) from a 64-bit mix of (row id, column, seed)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.arange(1, width + 1, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)
        x = x + np.uint64(seed % (1 << 63)) * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def hashed_normals(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    u = hashed_units(ids, 2 * width, seed)
    return np.sqrt(-2.0 * np.log(u[:, :width])) * np.cos(2.0 * math.pi * u[:, width:])


# ---- decayed moments --------------------------------------------------------------------
# The covariance after n rows is the sum of (1 - decay) decay^(rows after) c c', with c the
# row's distance from the mean before it. So blocks of rows can be summed apart, once each
# knows the mean it starts from.

def mean_share(x: np.ndarray, decay: float, first: bool) -> np.ndarray:
    """What consecutive rows add to the mean at their end; the first row of all counts whole."""
    w = decay ** np.arange(len(x) - 1, -1, -1, dtype=np.float64)
    w[1 if first else 0:] *= 1.0 - decay
    return w @ x


def distances(x: np.ndarray, decay: float, mean: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Every row's distance from the mean before it, and the mean after the last row.
    Distances within the rounding of a settled mean are zero."""
    out = np.zeros_like(x)
    for k, row in enumerate(x):
        if mean is None:
            mean = row
            continue
        out[k] = row - mean
        mean = mean + (1.0 - decay) * out[k]
    settled = EPS * (4.0 + 1.0 / (1.0 - decay))
    out[np.abs(out) <= settled * np.maximum(np.abs(x), np.abs(x - out))] = 0.0
    return out, mean


def outer_sum(c: np.ndarray, decay: float) -> np.ndarray:
    """Decayed sum of outer products of consecutive distances, as of the last one."""
    w = (1.0 - decay) * decay ** np.arange(len(c) - 1, -1, -1, dtype=np.float64)
    return (c * w[:, None]).T @ c


# ---- sketches ---------------------------------------------------------------------------
# Rows whose products add up to nearly the covariance: C - slack <= B'B <= C in every direction.
# Too many rows are turned to their principal axes and the squares of all lengths lowered by that
# of the first axis that goes; ``slack`` is the sum of what was taken off, faded like the rows.

def shrink(rows: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """At most ``size`` rows for many, and the square that was taken off."""
    if len(rows) <= size:
        return rows, 0.0
    _, s, axes = np.linalg.svd(rows, full_matrices=False)
    off = float(s[size]) ** 2 if len(s) > size else 0.0
    return np.sqrt(np.clip(s[:size] ** 2 - off, 0.0, None))[:, None] * axes[:size], off


def fold_rows(sketch: np.ndarray, slack: float, c: np.ndarray, decay: float, size: int) -> tuple[np.ndarray, float]:
    """The sketch after consecutive distances: C <- decay C + (1 - decay) c c'."""
    for at in range(0, len(c), size):
        part = c[at:at + size]
        weight = np.sqrt((1.0 - decay) * decay ** np.arange(len(part) - 1, -1, -1, dtype=np.float64))
        sketch, off = shrink(np.vstack([sketch * decay ** (len(part) / 2.0), part * weight[:, None]]), size)
        slack = slack * decay ** len(part) + off
    return sketch, slack


def leading_rows(sketch: np.ndarray, rank: int, tol: float = TOL) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of B'B and their directions, none below ``tol`` of the largest."""
    _, s, axes = np.linalg.svd(sketch, full_matrices=False) if sketch.any() else (None, np.zeros(0), np.zeros((0, sketch.shape[1])))
    values = np.square(s)
    n = min(rank, int(np.count_nonzero(values > tol * values.max(initial=0.0))))
    return axes[:n].T, values[:n]


def leading(cov: np.ndarray, rank: int, tol: float = TOL) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their directions, none below ``tol`` of the largest."""
    size = float(np.abs(cov).max(initial=0.0))
    if size == 0.0:
        return np.zeros((len(cov), 0)), np.zeros(0)
    lam, vec = np.linalg.eigh((cov + cov.T) / (2.0 * size))
    n = min(rank, int(np.count_nonzero(lam > tol * lam[-1])))
    return vec[:, ::-1][:, :n], lam[::-1][:n] * size


def turnover(old: np.ndarray, new: np.ndarray) -> float:
    """Share of the smaller subspace that the other one does not hold."""
    n = min(old.shape[1], new.shape[1])
    if n == 0:
        return 0.0
    return float(np.clip(1.0 - np.square(np.linalg.svd(old.T @ new, compute_uv=False)).sum() / n, 0.0, 1.0))


def effective_rank(values: np.ndarray) -> float:
    total = float(np.sum(values))
    if total <= 0.0:
        return 0.0
    p = values[values > 0] / total
    return float(np.exp(-np.sum(p * np.log(p))))


def orthogonality_error(basis: np.ndarray) -> float:
    """Largest distance of the basis' singular values, squared, from one."""
    if basis.shape[1] == 0:
        return 0.0
    return float(np.abs(np.square(np.linalg.svd(basis, compute_uv=False)) - 1.0).max())


# ---- projections ------------------------------------------------------------------------

def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def at_length(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows scaled to the wanted lengths; rows of no length stay."""
    own = lengths(x)
    return x * np.divide(wanted, own, out=np.ones_like(own), where=own > TOL)


def project(x: np.ndarray, basis: np.ndarray, mode: str = "top", strength: float = 1.0) -> np.ndarray:
    """Rows of x on a basis: top, remove, remove_renorm, or norm_matched (x scaled to
    the projection's length); blended with x by ``strength``."""
    if strength == 0.0:
        return x
    inside = x @ basis @ basis.T
    made = {
        "top": lambda: inside,
        "remove": lambda: x - inside,
        "remove_renorm": lambda: at_length(x - inside, lengths(x)),
        "norm_matched": lambda: at_length(x, lengths(inside)),
    }
    if mode not in made:
        raise ValueError(f"no such projection: {mode!r}")
    return x + strength * (made[mode]() - x) if strength != 1.0 else made[mode]()


def rank_by_rule(values: np.ndarray, rule: str, most: int, energy: float = 0.9) -> int:
    """Directions kept: 'energy' share, 'entropy' (effective rank) or largest 'gap' (ratio of neighbours)."""
    live = values[values > TOL]
    rules = {
        "energy": lambda: 1 + int(np.searchsorted(np.cumsum(live), energy * live.sum())),
        "entropy": lambda: int(round(effective_rank(live))),
        "gap": lambda: 1 + int(np.argmax(live[:-1] / live[1:])) if len(live) > 1 else 1,
    }
    if rule not in rules:
        raise ValueError(f"no such rule: {rule!r}")
    return int(np.clip(rules[rule](), 1, min(most, len(live)))) if len(live) else 0


def soft_project(x: np.ndarray, basis: np.ndarray, values: np.ndarray, alpha: float = 1.0,
                 keep_rest: bool = True, normalise: str = "none") -> np.ndarray:
    """Directions weighted by (value / largest)^alpha with the length restored; or the
    ridge projection on the basis scaled by variance or degree of the covariance."""
    if normalise == "none":
        weight = np.maximum(values / max(float(values.max()), 1e-30), TOL) ** alpha
        rest = x - x @ basis @ basis.T if keep_rest else 0.0
        return at_length(rest + (x @ basis * weight) @ basis.T, lengths(x))
    root = basis * np.sqrt(values)
    per_row = {"var": lambda: np.square(root).sum(axis=1), "degree": lambda: np.abs(root @ root.sum(axis=0))}
    if normalise not in per_row:
        raise ValueError(f"no such normalisation: {normalise!r}")
    # ridge on the scaled directions, through their singular values
    left, s, _ = np.linalg.svd(root / np.sqrt(np.maximum(per_row[normalise](), TOL))[:, None], full_matrices=False)
    return (x @ left * (s * s / (s * s + 1e-6))) @ left.T
