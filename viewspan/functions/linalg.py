"""Small dense kernels: extraction, rotation, alignment. Pure functions on arrays."""

from __future__ import annotations

import math

import numpy as np


def signed(loadings: np.ndarray) -> np.ndarray:
    """Columns flipped so that the entry of largest size is positive: eigenvectors have no sign of their own."""
    if not loadings.size:
        return loadings
    top = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return loadings * np.where(top < 0, -1.0, 1.0)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows centred and scaled to length 1; constant rows are 0."""
    x = x - x.mean(axis=1, keepdims=True)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


def correlation(x: np.ndarray) -> np.ndarray:
    """Correlations of rows; 0 where a row is constant, 1 on the diagonal."""
    u = unit_rows(x)
    r = u @ u.T
    np.fill_diagonal(r, 1.0)
    return r


def eigen(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.linalg.eigh(r)
    order = np.argsort(-w, kind="stable")
    return w[order], v[:, order]


def pca(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, all eigenvalues); negative retained eigenvalues count as 0."""
    w, v = eigen(r)
    return signed(v[:, :k] * np.sqrt(np.maximum(w[:k], 0))), w


def pca_of_rows(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``pca(correlation(x), k)`` for complete rows, by the smaller of the two Gram matrices."""
    u = unit_rows(np.asarray(x, float))
    if u.shape[0] <= u.shape[1] or (np.abs(u).sum(axis=1) == 0).any():
        return pca(correlation(x), k)
    w, v = eigen(u.T @ u)
    w = np.maximum(w, 0)
    k = min(k, len(w))
    return signed(u @ v[:, :k]), np.concatenate([w, np.zeros(u.shape[0] - len(w))])


def centroid(r: np.ndarray, k: int, most: int = 100, tol: float = 1e-5) -> np.ndarray:
    """Centroid factors with reflection: communalities are found again and again on the diagonal until they settle."""
    n = len(r)
    residual = r.copy()
    np.fill_diagonal(residual, 0)
    out = np.zeros((n, k))
    for f in range(k):
        sign = np.ones(n)
        work = residual.copy()
        for _ in range(n * n):
            sums = work.sum(axis=0)
            worst = int(sums.argmin())
            if sums[worst] > 0:
                break
            sign[worst] = -sign[worst]
            work[worst] = -work[worst]
            work[:, worst] = -work[:, worst]
        sums = work.sum(axis=0)
        t = sums + sums / (n - 1)
        if t.sum() <= 0:
            out[:, f:] = np.nan
            break
        loading = t / math.sqrt(t.sum())
        for _ in range(most):
            t = sums + loading**2
            if t.sum() <= 0:
                break
            new = t / math.sqrt(t.sum())
            done = np.abs(new**2 - loading**2).max() < tol
            loading = new
            if done:
                break
        out[:, f] = loading * sign
        residual = residual - np.outer(out[:, f], out[:, f])
        np.fill_diagonal(residual, 0)
    return out


def _reflection(x: np.ndarray, scale: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Signs by which every row's sum of ``x * scale @ x.T`` less its entry ``own`` on the diagonal is positive: the least sum's row is mirrored again and again.

    A round finds all sums and takes the ``most`` least as candidates; a flip moves another row's sum by at
    most twice the product of both lengths, so the candidates hold the least one until it could lie outside.
    """
    n = len(x)
    sign = np.ones(n)
    scaled = x * scale
    length = np.sqrt((x * x).sum(axis=1))
    longest = length.max()
    while True:
        total = scaled.T @ sign
        sums = np.round(sign * (x @ total) - own, 9)
        if sums.min() >= 0:
            return sign
        most = min(most, n)
        at = np.sort(np.argpartition(sums, most - 1)[:most]) if most < n else np.arange(n)
        rest = np.inf if most == n else sums[at].max()  # no row outside has less
        near, far = x[at], scaled[at]
        drift, flipped = 0.0, False
        while True:
            now = np.round(sign[at] * (near @ total) - own[at], 9)
            worst = int(now.argmin())
            if now[worst] >= 0 or (flipped and now[worst] >= rest - drift):
                break
            sign[at[worst]] *= -1
            total += 2 * sign[at[worst]] * far[worst]
            drift += 2 * length[at[worst]] * longest
            flipped = True


def centroid_of_rows(x: np.ndarray, k: int, most: int = 100, tol: float = 1e-5, candidates: int = 4096) -> np.ndarray:
    """As ``centroid(correlation(x), k)`` for complete rows of which none is constant, from the unit rows: R is never formed."""
    u = unit_rows(np.asarray(x, float))
    n, j = u.shape
    out = np.zeros((n, k))
    scale = np.ones(j)
    for f in range(k):
        own = (u * u * scale).sum(axis=1)
        sign = _reflection(u, scale, own, candidates)
        sums = sign * (u @ ((u * scale).T @ sign)) - own
        t = sums + sums / (n - 1)
        if t.sum() <= 0:
            out[:, f:] = np.nan
            break
        loading = t / math.sqrt(t.sum())
        for _ in range(most):
            t = sums + loading**2
            if t.sum() <= 0:
                break
            new = t / math.sqrt(t.sum())
            done = np.abs(new**2 - loading**2).max() < tol
            loading = new
            if done:
                break
        out[:, f] = loading * sign
        # what a factor takes away is one more column, of negative scale
        u, scale = np.column_stack([u, out[:, f]]), np.append(scale, -1.0)
    return out


#: Length that a person's loadings are held to.
HEYWOOD = 0.9975


def minres_start(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(z, mu) for ``minres_rows``, those of principal components: z = U'L (J x k) and mu the squared lengths of L's columns, for s = U'U."""
    w, v = eigen(s)
    mu = np.maximum(w[:k], 1e-9)
    return v[:, :k] * mu, mu


def minres_rows(u: np.ndarray, z: np.ndarray, mu: np.ndarray, steps: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loadings, c, d) of unit rows that each fit all others best, in the frame where L'L is diagonal: l = c z'u / (mu + d), d = c - l'l, as a row doesn't fit itself; c < 1 holds it to ``HEYWOOD`` (with such rows loadings follow ``minres`` only nearly)."""
    y = u @ z
    c, d = np.ones((len(u), 1)), np.ones((len(u), 1))
    for _ in range(steps):
        b = y / (mu + d)
        size = np.sqrt((b * b).sum(axis=1, keepdims=True))
        c = np.minimum(1.0, HEYWOOD / np.maximum(size, 1e-300))
        d = c - (c * size) ** 2
    return c * y / (mu + d), c, d


def minres_sums(u: np.ndarray, z: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """What ``minres_step`` needs of these rows: for each factor U'DU with D = c / (mu + d), c / (mu + d)² and its square."""
    _, c, d = minres_rows(u, z, mu)
    return np.stack([(u * w).T @ u for m in mu for w in (c / (m + d), c / (m + d) ** 2, (c / (m + d)) ** 2)])


def minres_step(sums: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next (z, mu): z is an eigenvector of its factor's first sum, whose eigenvalue is to become 1 by mu."""
    k = len(mu)
    columns, new = [], []
    for m, (a, b, q) in enumerate(sums.reshape(k, 3, *sums.shape[1:])):
        w, v = eigen(a)
        at = v[:, m]
        shift = w[m] / (at @ b @ at)  # mu and what d adds to it
        to = max(mu[m] + shift * (w[m] - 1), 1e-9)
        length = (at @ q @ at) * (shift / (shift + to - mu[m])) ** 2
        columns.append(at * math.sqrt(to / length))
        new.append(to)
    return np.stack(columns, axis=1), np.array(new)


def minres(r: np.ndarray, k: int, most: int = 500, tol: float = 1e-7) -> np.ndarray:
    """Least-squares loadings of the off-diagonal (Harman & Jones), one person at a time."""
    n = len(r)
    load = pca(r, k)[0] * 0.9
    for _ in range(most):
        before = load.copy()
        for i in range(n):
            others = np.delete(load, i, axis=0)
            target = np.delete(r[i], i)
            b = np.linalg.lstsq(others.T @ others + 1e-10 * np.eye(k), others.T @ target, rcond=None)[0]
            size = math.sqrt(b @ b)
            load[i] = b / size * HEYWOOD if size > HEYWOOD else b
        if np.abs(load @ load.T - before @ before.T).max() < tol:
            break
    w, v = eigen(load.T @ load)
    return signed(load @ v)


#: Rotations that work on rows scaled to a communality of 1, and those with correlated factors.
NORMALISED, OBLIQUE = ("varimax", "promax"), ("oblimin", "promax")


def kaiser(loadings: np.ndarray) -> np.ndarray:
    h = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    return np.divide(loadings, h, out=np.zeros_like(loadings), where=h > 1e-12)


def moments(x: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of two and of four columns, each row ``w`` times; all that the rotations below need, and additive over rows."""
    k = x.shape[1]
    pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), k * k)
    left = pairs if w is None else pairs * w[:, None]
    return left.sum(axis=0).reshape(k, k), (left.T @ pairs).reshape(k, k, k, k)


def _cubes(m4: np.ndarray, t: np.ndarray) -> np.ndarray:
    """X' Z³ of Z = X T."""
    k = len(t)
    triples = t[:, None, None, :] * t[None, :, None, :] * t[None, None, :, :]
    return m4.reshape(k, -1) @ triples.reshape(-1, k)


def _varimax_turn(m2: np.ndarray, m4: np.ndarray, rows: int, eps: float = 1e-5, most: int = 1000) -> np.ndarray:
    t, d = np.eye(len(m2)), 0.0
    for _ in range(most):
        squares = np.einsum("bc,bm,cm->m", m2, t, t)
        u, s, vt = np.linalg.svd(_cubes(m4, t) - m2 @ t * squares / rows)
        t, old, d = u @ vt, d, s.sum()
        if d < old * (1 + eps):
            break
    return t


def _gradient_projection(k: int, criterion, orthogonal: bool, most: int = 1000, eps: float = 1e-6) -> np.ndarray:
    """Rotation that lowers ``criterion(T) -> (value, its gradient by T)`` (Jennrich; Bernaards & Jennrich 2005)."""
    t, step = np.eye(k), 1.0
    f, grad = criterion(t)
    for _ in range(most):
        if orthogonal:
            m = t.T @ grad
            proj = grad - t @ (m + m.T) / 2
        else:
            proj = grad - t * (t * grad).sum(axis=0)
        size = np.linalg.norm(proj)
        if size < eps:
            break
        step *= 2
        for _ in range(12):
            x = t - step * proj
            if orthogonal:
                u, _, vt = np.linalg.svd(x)
                new = u @ vt
            else:
                new = x / np.sqrt((x**2).sum(axis=0))
            fn, gn = criterion(new)
            if f - fn > 0.5 * size**2 * step:
                break
            step /= 2
        t, f, grad = new, fn, gn
    return t


def _quartimax_turn(m4: np.ndarray) -> np.ndarray:
    def criterion(t):
        cubes = _cubes(m4, t)
        return -(t * cubes).sum() / 4, -cubes

    return _gradient_projection(len(m4), criterion, True)


def _oblimin_axes(m4: np.ndarray) -> np.ndarray:
    """T of quartimin: the loadings are A inv(T)'."""

    def criterion(t):
        inv = np.linalg.inv(t)
        w = inv.T
        four = np.einsum("abcd,ai,bj,ck,dl->ijkl", m4, w, w, w, w, optimize=True)
        both = np.einsum("abcc->abc", four)
        others = both.sum(axis=2) - np.einsum("abb->ab", both)  # L' G: for each column the squares of the other columns
        return np.trace(others) / 4, -(others @ inv).T

    return _gradient_projection(len(m4), criterion, False)


def promax_target(x: np.ndarray, power: int = 4) -> np.ndarray:
    return x * np.abs(x) ** (power - 1)


def promax_turn(t: np.ndarray, xx: np.ndarray, xq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, factor correlations, what is done after varimax) from varimax's rotation and the sums X'X and X'Q of its loadings and their powers."""
    u = np.linalg.lstsq(xx, xq, rcond=None)[0]
    u = u * np.sqrt(np.diag(np.linalg.inv(u.T @ u)))
    inv = np.linalg.inv(t @ u)
    return t @ u, inv @ inv.T, u


def turn_of(method: str, m2: np.ndarray, m4: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotation, factor correlations) from the moments of the loadings (``kaiser`` ones for ``NORMALISED``); of promax the varimax it starts from."""
    if method == "oblimin":
        t = _oblimin_axes(m4)
        return np.linalg.inv(t).T, t.T @ t
    t = _quartimax_turn(m4) if method == "quartimax" else _varimax_turn(m2, m4, rows)
    return t, np.eye(len(t))


def varimax(loadings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rotated, rotation), with Kaiser's normalisation."""
    t, _ = turn_of("varimax", *moments(kaiser(loadings)), len(loadings))
    return loadings @ t, t


def quartimax(loadings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, _ = turn_of("quartimax", *moments(loadings), len(loadings))
    return loadings @ t, t


def oblimin(loadings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, rotation, factor correlations), quartimin."""
    t, phi = turn_of("oblimin", *moments(loadings), len(loadings))
    return loadings @ t, t, phi


def promax(loadings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, rotation, factor correlations) from varimax."""
    x, t = varimax(loadings)
    t, phi, _ = promax_turn(t, x.T @ x, x.T @ promax_target(x))
    return loadings @ t, t, phi


def rotate(loadings: np.ndarray, method: str) -> np.ndarray:
    if loadings.shape[1] < 2 or method == "none":
        return loadings
    return {"varimax": varimax, "quartimax": quartimax, "oblimin": oblimin, "promax": promax}[method](loadings)[0]


def extract(r: np.ndarray, k: int, method: str) -> np.ndarray:
    return {"pca": lambda: pca(r, k)[0], "centroid": lambda: centroid(r, k), "minres": lambda: minres(r, k)}[method]()


def procrustes(loadings: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``loadings`` turned (and mirrored) to be closest to ``target``."""
    u, _, vt = np.linalg.svd(target.T @ loadings)
    return loadings @ vt.T @ u.T


def assignment(score: np.ndarray) -> np.ndarray:
    """For each row of a square matrix the column that makes the sum of the chosen entries largest: shortest augmenting paths over reduced costs."""
    n = len(score)
    cost = score.max() - score
    row_price, column_price = np.zeros(n), np.zeros(n)
    column_of, row_of = np.full(n, -1), np.full(n, -1)
    for start in range(n):
        reach, came, done = np.full(n, np.inf), np.full(n, start), np.zeros(n, bool)
        row, length = start, 0.0
        while True:
            path = length + cost[row] - row_price[row] - column_price
            shorter = ~done & (path < reach)
            reach[shorter], came[shorter] = path[shorter], row
            end = int(np.where(done, np.inf, reach).argmin())
            length = reach[end]
            if row_of[end] < 0:
                break
            done[end] = True
            row = row_of[end]
        row_price[start] += length
        row_price[row_of[done]] += length - reach[done]
        column_price[done] -= length - reach[done]
        while end >= 0:
            row = came[end]
            row_of[end] = row
            column_of[row], end = end, column_of[row]
    return column_of


def signed_turn(c: np.ndarray) -> np.ndarray:
    """The signed permutation T for which the columns of ``loadings @ T`` are most like the target's, from likenesses ``c`` (target's columns by the others)."""
    c = np.nan_to_num(c)
    k = len(c)
    column_of = assignment(np.abs(c))
    turn = np.zeros((k, k))
    turn[column_of, np.arange(k)] = np.where(c[np.arange(k), column_of] < 0, -1.0, 1.0)
    return turn


def cosines(target: np.ndarray, loadings: np.ndarray) -> np.ndarray:
    size = np.outer(np.sqrt((target**2).sum(axis=0)), np.sqrt((loadings**2).sum(axis=0)))
    c = target.T @ loadings
    return np.divide(c, size, out=np.zeros_like(c), where=size > 0)


#: Points of a sorted column that stand for its curve.
CURVE = np.linspace(0, 1, 50)


def curve_turn(target: np.ndarray, curves: np.ndarray) -> np.ndarray:
    """The signed permutation by curves (``CURVE`` quantiles, a row each): a mirrored column has its curve read backwards and negated."""
    k = len(target)
    r = lambda x, y: float(np.corrcoef(x, y)[0, 1]) if np.ptp(x) > 0 and np.ptp(y) > 0 else 0.0
    c = np.zeros((k, k))
    for j in range(k):
        for i in range(k):
            plain, mirrored = r(target[j], curves[i]), r(target[j], -curves[i][::-1])
            # -1..1 moved to 0..1, so that a mirrored column is one of negative likeness
            c[j, i] = 1 + plain if plain >= mirrored else -1 - mirrored
    return signed_turn(c)


def align_by_curves(loadings: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For different people: columns assigned by their sorted curves, with signs."""
    return loadings @ curve_turn(np.quantile(target, CURVE, axis=0).T, np.quantile(loadings, CURVE, axis=0).T)


def align_people(loadings: np.ndarray, people: np.ndarray, target: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """``loadings`` of ``people`` turned to ``target`` of ``targets``: by those in both, each once, where they are more than the columns, else by curves."""
    _, i, j = np.intersect1d(people, targets, return_indices=True)
    if len(i) <= target.shape[1]:
        return align_by_curves(loadings, target)
    u, _, vt = np.linalg.svd(target[j].T @ loadings[i])
    return loadings @ vt.T @ u.T


def match_align(loadings: list[np.ndarray], reference: np.ndarray) -> list[np.ndarray]:
    """A turn for each of many draws of the same loadings that differ in rotation, labels and signs.

    Each draw is turned by varimax; its columns are then assigned, with signs,
    to those of a pivot, the draw of median condition number. The pivot's own
    labels are those of ``reference``, so that chains meet.
    """
    k = reference.shape[1]
    if k < 2:
        return [np.where((reference.T @ x) < 0, -1.0, 1.0) for x in loadings]
    turns, last = [], np.eye(k)
    for x in loadings:
        last = last @ varimax(x @ last)[1]  # from the turn before, which is near
        turns.append(last)
    conditions = np.array([np.linalg.cond(x) for x in loadings])
    at = int(np.argsort(conditions, kind="stable")[(len(loadings) - 1) // 2])
    pivot = loadings[at] @ turns[at]
    pivot = pivot @ signed_turn(cosines(reference, pivot))
    return [t @ signed_turn(cosines(pivot, x @ t)) for x, t in zip(loadings, turns, strict=True)]


def kmo(r: np.ndarray) -> float:
    """Kaiser-Meyer-Olkin measure; nan for a singular matrix."""
    try:
        if np.linalg.cond(r) > 1e12:
            return math.nan
        q = np.linalg.inv(r)
    except np.linalg.LinAlgError:
        return math.nan
    s = 1 / np.sqrt(np.diag(q))
    p = -q * np.outer(s, s)
    off = ~np.eye(len(r), dtype=bool)
    return float((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (p[off] ** 2).sum()))
