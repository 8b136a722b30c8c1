"""Lasso and PLS1 from sufficient statistics, many fits of one training set at a time.

The weights of a Lasso are piecewise linear in the penalty, so the fits for all
penalties are read from one exact path of a few dozen pieces. Where a path breaks
off (ties, features that are combinations of others), coordinate descent takes over.
Every fit comes with its optimality gap, by which one that has not converged shows.
"""

from __future__ import annotations

import numpy as np


def subsets(cov: np.ndarray, cross: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded ``(sets, p, p)`` and ``(sets, p)`` of the covariance and cross sums of feature subsets."""
    p = max((len(f) for f in sets), default=0)
    a, b = np.zeros((len(sets), p, p)), np.zeros((len(sets), p))
    for i, f in enumerate(sets):
        a[i, : len(f), : len(f)], b[i, : len(f)] = cov[np.ix_(f, f)], cross[f]
    return a, b


def optimality_gaps(cov: np.ndarray, cross: np.ndarray, n: float, alphas: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How far each row of weights is from the conditions of the minimum, as a share of the largest cross sum.

    Features in use have ``|x'(z - Xw)| = n alpha`` with the weight's sign, others at most that.
    """
    grad, bound = cross - w @ cov, n * np.asarray(alphas)[:, None]
    off = np.where(w != 0, np.abs(grad - bound * np.sign(w)), np.maximum(np.abs(grad) - bound, 0.0))
    off = np.where(np.diag(cov) > 0, off, 0.0)
    return off.max(axis=1, initial=0.0) / max(np.abs(cross).max(initial=0.0), 1e-300)


class Path:
    """Pieces of the Lasso path from the first feature downwards, worked out as far as asked.

    On a piece the features ``used`` have weights ``u - n alpha v``; it holds from the
    penalty ``high`` down to ``low``.
    """

    def __init__(self, cov: np.ndarray, cross: np.ndarray, n: float):
        self.cov, self.cross, self.n = cov, cross, n
        self.fine = np.diag(cov) > 1e-12 * max(np.diag(cov).max(initial=0.0), 1e-300)
        self.top = float(np.abs(cross[self.fine]).max(initial=0.0)) / n
        self.pieces: list[tuple] = []  # (low, used, u, v)
        self.used, self.signs = [], []
        if self.top > 0:
            self._enter(int(np.argmax(np.where(self.fine, np.abs(cross), -1.0))), self.top)

    def _enter(self, j: int, alpha: float) -> None:
        if self.used:
            # A feature that those in use combine to cannot be told from them and stays out.
            at = np.array(self.used, int)
            try:
                own = self.cov[j, j] - self.cov[j, at] @ np.linalg.solve(self.cov[at[:, None], at], self.cov[at, j])
            except np.linalg.LinAlgError:
                own = 0.0
            if not own > 1e-10 * self.cov[j, j]:
                self.fine[j] = False
                return
        self.last = j
        self.used.append(j)
        grad = self.cross[j] - (self.cov[j, self.pieces[-1][1]] @ self._weights(self.pieces[-1], alpha) if self.pieces else 0.0)
        self.signs.append(np.sign(grad))

    def _weights(self, piece: tuple, alpha: float) -> np.ndarray:
        return piece[2] - self.n * alpha * piece[3]

    def _step(self, high: float) -> bool:
        """Add the next piece; false at the end of the path."""
        used, n = np.array(self.used, int), self.n
        try:
            u, v = np.linalg.solve(self.cov[used[:, None], used], np.array([self.cross[used], self.signs]).T).T
        except np.linalg.LinAlgError:
            return False
        below = high * (1 - 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = u / (n * v)
            at = self.cov[:, used]
            c, e = self.cross - at @ u, at @ v
            enter = np.stack([c / (n * (1 - e)), -c / (n * (1 + e))])
        enter[:, used], enter[:, ~self.fine] = -1.0, -1.0
        # What has just come or gone stands at its own event; rounding must not repeat it.
        again = high * (1 - 1e-7)
        leave = np.where((leave > 0) & (leave < np.where(used == self.last, again, below)), leave, -1.0)
        enter = np.where((enter > 0) & (enter < np.where(np.arange(len(c)) == self.last, again, below)), enter, -1.0)
        out, new = leave.max(initial=-1.0), enter.max(initial=-1.0)
        low = max(out, new, 0.0)
        self.pieces.append((low, used, u, v))
        if low <= 0:
            return False
        if new >= out:
            self._enter(int(np.argmax(enter.max(axis=0))), low)
        else:
            i = int(np.argmax(leave))
            self.last = self.used[i]
            del self.used[i], self.signs[i]
        return bool(self.used)

    def weights(self, alphas) -> tuple[np.ndarray, np.ndarray]:
        """Weights and optimality gaps for penalties in descending order."""
        out, at, more = np.zeros((len(alphas), len(self.cross))), 0, bool(self.used)
        for row, alpha in enumerate(alphas):
            if alpha >= self.top:
                continue
            while more and (not self.pieces or self.pieces[-1][0] > alpha) and len(self.pieces) < 20 * len(self.cross) + 20:
                more = self._step(self.pieces[-1][0] if self.pieces else self.top)
            while at + 1 < len(self.pieces) and self.pieces[at][0] > alpha:
                at += 1
            if self.pieces:
                out[row, self.pieces[at][1]] = self._weights(self.pieces[at], alpha)
        return out, optimality_gaps(self.cov, self.cross, self.n, alphas, out)


def descent(cov: np.ndarray, cross: np.ndarray, n: float, alpha: float, start: np.ndarray, sweeps: int = 2000, tol: float = 1e-9) -> np.ndarray:
    """Cyclic coordinate descent for one penalty."""
    w = start.copy()
    grad, diag, bound = cross - cov @ w, np.diag(cov), n * alpha
    limit = tol * max(np.abs(cross).max(initial=0.0), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(diag > 0):
            r = grad[j] + diag[j] * w[j]
            step = np.sign(r) * max(abs(r) - bound, 0.0) / diag[j] - w[j]
            if step:
                grad -= cov[:, j] * step
                w[j] += step
                moved = max(moved, abs(step) * diag[j])
        if moved <= limit:
            break
    return w


def lasso_all(cov: np.ndarray, cross: np.ndarray, n: float, alphas, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Minimise 1/(2n) |z - Xw|^2 + alpha |w|_1 for every penalty, in any order.

    ``cov`` and ``cross`` are centred X'X and X'z. Returns weights, a row per penalty,
    and the optimality gap of each.
    """
    alphas = np.asarray(alphas, float)
    order = np.argsort(-alphas, kind="stable")
    w, gaps = Path(cov, cross, n).weights(alphas[order])
    for i in np.flatnonzero(~(gaps <= tol)):
        again = descent(cov, cross, n, alphas[order[i]], w[i - 1] if i else np.zeros(len(cross)))
        gap = optimality_gaps(cov, cross, n, alphas[order[i : i + 1]], again[None])[0]
        if not gap >= gaps[i]:
            w[i], gaps[i] = again, gap
    back = np.argsort(order)
    return w[back], gaps[back]


def lasso(cov: np.ndarray, cross: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """One fit."""
    return lasso_all(cov, cross, n, [alpha])[0][0]


def lasso_path(cov, cross, n, n_feats: int, steps: int, floor: float = 1e-6, min_weight: float = 1e-5):
    """Penalties, weights and optimality gaps from the first feature down to ``n_feats`` features.

    The upper end is where the first feature enters (max |X'z| / n); the lower end is
    the first of a geometric grid with enough features, or its end at ``floor`` times
    the upper one. ``steps`` log-spaced penalties lie between them.
    """
    path = Path(cov, cross, n)
    if path.top <= 0:
        return [(0.0, np.zeros(len(cross)), 0.0)] * steps
    grid = path.top * 0.8 ** np.arange(1, 1 + int(np.ceil(np.log(floor) / np.log(0.8))))
    low, target = grid[-1], min(n_feats, len(cross))
    for alpha in grid:
        if (np.abs(path.weights([alpha])[0]) > min_weight).sum() >= target:
            low = alpha
            break
    alphas = np.geomspace(path.top, low, steps)
    w, gaps = lasso_all(cov, cross, n, alphas)
    return [(float(a), x, float(g)) for a, x, g in zip(alphas, w, gaps)]


def pls1_batch(cov: np.ndarray, cross: np.ndarray, components: int) -> np.ndarray:
    """Coefficients ``(components, sets, p)`` for 1..components latent variables, without touching the rows again.

    Sets whose remaining cross sums or scores vanish keep the coefficients they have.
    """
    n_sets, p = cross.shape
    rest, deflate, coef = cross.copy(), np.tile(np.eye(p), (n_sets, 1, 1)), np.zeros((n_sets, p))
    first = np.maximum(np.linalg.norm(cross, axis=1), 1e-300)
    size = np.maximum(np.einsum("gjj->g", cov), 1e-300) / np.maximum((np.einsum("gjj->gj", cov) > 0).sum(axis=1), 1)
    out = []
    for _ in range(components):
        norm = np.linalg.norm(rest, axis=1)
        r = np.einsum("gjk,gk->gj", deflate, rest / np.maximum(norm, 1e-300)[:, None])
        cr = np.einsum("gjk,gk->gj", cov, r)
        tt = np.einsum("gj,gj->g", r, cr)
        on = (norm > 1e-12 * first) & (tt > 1e-12 * size)
        safe = np.where(on, tt, 1.0)
        load = np.where(on[:, None], cr / safe[:, None], 0.0)
        inner = np.where(on, np.einsum("gj,gj->g", r, cross) / safe, 0.0)
        coef = coef + r * inner[:, None]
        rest = rest - load * (inner * tt)[:, None]
        deflate = deflate - r[:, :, None] * load[:, None, :]
        out.append(coef)
    return np.array(out).reshape(components, n_sets, p)


def pls1(cov: np.ndarray, cross: np.ndarray, components: int) -> list[np.ndarray]:
    """One training set."""
    return list(pls1_batch(cov[None], cross[None], components)[:, 0])
