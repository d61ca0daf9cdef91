"""Numeric kernels of the correlated methylation model: numpy, log domain, O(N) a chain.

p(x) is proportional to exp(sum alpha_n x_n + sum beta_n x_n x_{n+1}), x in {-1, 1}. All
functions take alpha (..., N) and beta (..., N - 1) and work on all leading axes at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

S = np.asarray([-1.0, 1.0])
SS = np.outer(S, S)


def link(phi, n, rho, d) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = phi
    return n * (a + b * rho), c / np.asarray(d)[..., : len(rho) - 1]


def messages(field: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log messages (..., N, 2) of site potentials ``field`` (..., N, 2)."""
    n = field.shape[-2]
    f, b = np.zeros_like(field), np.zeros_like(field)
    beta = np.broadcast_to(beta, (*field.shape[:-2], n - 1))
    for i in range(n - 1):
        f[..., i + 1, 0], f[..., i + 1, 1] = _passed(f[..., i, :] + field[..., i, :], beta[..., i])
    for i in range(n - 2, -1, -1):
        b[..., i, 0], b[..., i, 1] = _passed(b[..., i + 1, :] + field[..., i + 1, :], beta[..., i])
    return f, b


def _passed(g: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log messages to both states of a neighbour, from a site's log weights (..., 2)."""
    return np.logaddexp(g[..., 0] + beta, g[..., 1] - beta), np.logaddexp(g[..., 0] - beta, g[..., 1] + beta)


def expectations(field: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log Z, P(X_n = s), E[X_n X_{n+1}], forward, backward)."""
    f, b = messages(field, beta)
    log_z = np.logaddexp.reduce(f[..., -1, :] + field[..., -1, :], axis=-1)
    p = np.exp(f + b + field - log_z[..., None, None])
    beta = np.broadcast_to(beta, (*field.shape[:-2], field.shape[-2] - 1))
    left = (f + field)[..., :-1, :, None] + beta[..., None, None] * SS + (b + field)[..., 1:, None, :]
    exx = (np.exp(left - log_z[..., None, None, None]) * SS).sum(axis=(-1, -2))
    return log_z, p, exx, f, b


def fields(alpha: np.ndarray) -> np.ndarray:
    return np.asarray(alpha, float)[..., None] * S


@dataclass
class Summary:
    log_z: float
    ex: np.ndarray
    exx: np.ndarray
    p: np.ndarray
    f: np.ndarray
    b: np.ndarray
    alpha: np.ndarray
    beta: np.ndarray


def summarise(alpha, beta) -> Summary:
    alpha, beta = np.asarray(alpha, float), np.asarray(beta, float)
    log_z, p, exx, f, b = expectations(fields(alpha), beta)
    return Summary(float(log_z), (p * S).sum(-1), exx, p, f, b, alpha, beta)


def summarise_all(alphas, betas, cells: int = 1 << 17) -> list[Summary]:
    """``summarise`` of chains of any lengths, in their order; messages run once for many chains.

    Chains of like lengths are padded to one array of at most ``cells`` sites (a longer chain is alone).
    A padded site is uncoupled and its two states weigh one half each, so it changes nothing before it.
    """
    alphas, betas = ([np.asarray(x, float) for x in xs] for xs in (alphas, betas))
    sizes = np.asarray([len(a) for a in alphas], int)
    out: list = [None] * len(alphas)
    order, at = np.argsort(-sizes, kind="stable"), 0
    while at < len(order):
        own = order[at : at + max(1, cells // max(int(sizes[order[at]]), 1))]
        at += len(own)
        n = max(int(sizes[own].max()), 1)
        field, beta = np.full((len(own), n, 2), -np.log(2.0)), np.zeros((len(own), n - 1))
        for row, i in enumerate(own):
            field[row, : sizes[i]], beta[row, : len(betas[i])] = fields(alphas[i]), betas[i]
        log_z, p, exx, f, b = expectations(field, beta)
        for row, i in enumerate(own):
            k = sizes[i]
            out[i] = Summary(float(log_z[row]), (p[row, :k] * S).sum(-1), exx[row, : max(k - 1, 0)], p[row, :k], f[row, :k], b[row, :k], alphas[i], betas[i])
    return out


def _padded(out: np.ndarray, values: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``out`` with the values of the lists ``own`` at the beginning of its rows; lists are values and offsets."""
    sizes = offsets[own + 1] - offsets[own]
    column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(own)), sizes), column] = values[np.repeat(offsets[own], sizes) + column]
    return out


def read_statistics(alpha: tuple, beta: tuple, site: tuple, log_u: np.ndarray, log_m: np.ndarray, cells: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """(log p(y), E[log p(y | X)] under its posterior) of each read; messages run once for many reads.

    ``alpha``, ``beta``, ``site`` (from 0, of the calls ``log_u``, ``log_m``) are lists of all reads as (values,
    offsets). Reads are padded as in ``summarise_all``; neighbours of one model share its log Z.
    """
    sizes, calls = np.diff(alpha[1]), np.diff(site[1])
    if ((site[0] < 0) | (site[0] >= np.repeat(sizes, calls))).any():
        raise IndexError("a call lies outside of its region's groups")
    log_lik, emission = np.zeros(len(sizes)), np.zeros(len(sizes))
    order, at = np.argsort(-sizes, kind="stable"), 0
    while at < len(order):
        n = max(int(sizes[order[at]]), 1)
        own = order[at : at + max(1, cells // n)]
        at += len(own)
        a = _padded(np.zeros((len(own), n)), *alpha, own)
        field, couple = fields(a), _padded(np.zeros((len(own), max(n - 1, 0))), *beta, own)
        field[np.arange(n) >= sizes[own, None]] = -np.log(2.0)
        new = np.ones(len(own), bool)
        new[1:] = (field[1:] != field[:-1]).any(axis=(1, 2)) | (couple[1:] != couple[:-1]).any(axis=1)
        model = np.cumsum(new) - 1
        k = calls[own]
        row, which = np.repeat(np.arange(len(own)), k), np.repeat(site[1][own] - np.cumsum(k) + k, k) + np.arange(k.sum())
        seen = ~np.isnan(log_u[which])
        evidence = np.zeros_like(field)
        evidence[row, site[0][which]] = np.where(seen[:, None], np.stack([log_u[which], log_m[which]], axis=-1), 0.0)
        whole = field + evidence
        f, b = messages(whole, couple)
        log_z = np.logaddexp(*np.moveaxis((f + whole)[:, -1], -1, 0))
        prior = messages(field[new], couple[new])[0][:, -1] + field[new][:, -1]
        log_lik[own] = log_z - np.logaddexp(prior[:, 0], prior[:, 1])[model]
        emission[own] = (np.exp(f + b + whole - log_z[:, None, None]) * evidence).sum(axis=(-1, -2))
    return log_lik, emission


def _energy(s: Summary, model: Summary, p: int, q: int) -> float:
    """-E_s[log of ``model``'s marginal of sites p..q] (0-based, inclusive)."""
    ends = (s.p[p] * model.f[p]).sum() + (s.p[q] * model.b[q]).sum()
    inner = (model.alpha[p : q + 1] * s.ex[p : q + 1]).sum() + (model.beta[p:q] * s.exx[p:q]).sum()
    return float(model.log_z - ends - inner)


def mml(s: Summary, p: int, q: int) -> float:
    return float(0.5 * (1 + s.ex[p : q + 1].mean()))


def nme(s: Summary, p: int, q: int) -> float:
    """Entropy of sites p..q in bits a site."""
    return _energy(s, s, p, q) / ((q - p + 1) * np.log(2))


def cmd(s1: Summary, s2: Summary, mix: Summary, p: int, q: int) -> float:
    """Divergence coefficient of two models on sites p..q; ``mix`` has their mean parameters."""
    h = _energy(s1, s1, p, q) + _energy(s2, s2, p, q)
    c = _energy(s1, mix, p, q) + _energy(s2, mix, p, q)
    return float("nan") if c == 0 else 1 - h / c


def kl(p: Summary, q: Summary) -> float:
    """Divergence of q from p over the whole chain, in nats."""
    last = len(p.alpha) - 1
    return _energy(p, q, 0, last) - _energy(p, p, 0, last)


def correlations(s: Summary) -> np.ndarray:
    """corr(X_n, X_{n+1})."""
    sd = np.sqrt(1 - s.ex**2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (s.exx - s.ex[:-1] * s.ex[1:]) / (sd[:-1] * sd[1:])


def second_moments(s: Summary) -> np.ndarray:
    """E[X_i X_j] for i < j, the variance on the diagonal, NaN below it.

    A chain is Markov: the conditional means of X_j given X_i are carried on place by place.
    """
    n = len(s.alpha)
    out = np.full((n, n), np.nan)
    field = fields(s.alpha)
    step = np.exp((field + s.b)[1:, None, :] + s.beta[:, None, None] * SS - s.b[:-1, :, None]) if n > 1 else np.zeros((0, 2, 2))
    out[np.arange(n), np.arange(n)] = 1 - s.ex**2
    for i in range(n - 1):
        carry = np.eye(2)  # P(X_j = t | X_i = r)
        for j in range(i + 1, n):
            carry = carry @ step[j - 1]
            out[i, j] = (s.p[i] * S) @ carry @ S
    return out


def read_log_likelihoods(alpha, beta, log_u: np.ndarray, log_m: np.ndarray) -> np.ndarray:
    """log p(y) of each read (row; NaN where a group isn't observed)."""
    field, beta = fields(np.asarray(alpha, float)), np.asarray(beta, float)
    seen = ~np.isnan(log_u)
    evidence = np.where(seen[..., None], np.stack([log_u, log_m], axis=-1), 0.0)
    return expectations(field + evidence, beta)[0] - expectations(field, beta)[0]


def expected_log_emissions(alpha, beta, log_u: np.ndarray, log_m: np.ndarray) -> np.ndarray:
    """E[log p(y | X)] of each read under its own posterior."""
    field, beta = fields(np.asarray(alpha, float)), np.asarray(beta, float)
    seen = ~np.isnan(log_u)
    evidence = np.where(seen[..., None], np.stack([log_u, log_m], axis=-1), 0.0)
    p = expectations(field + evidence, beta)[1]
    return (p * evidence).sum(axis=(-1, -2))


def mixture(s1: Summary, s2: Summary) -> Summary:
    return summarise(0.5 * (s1.alpha + s2.alpha), 0.5 * (s1.beta + s2.beta))


def sample(alpha, beta, size: int, rng: np.random.Generator) -> np.ndarray:
    """(size, N) exact draws: backward messages, then forward sampling."""
    field = fields(np.asarray(alpha, float))
    _, b = messages(field, np.asarray(beta, float))
    n, out = len(field), np.zeros((size, len(field)), np.int8)
    logit = field[0] + b[0]
    p = 1 / (1 + np.exp(logit[0] - logit[1]))
    out[:, 0] = np.where(rng.random(size) < p, 1, -1)
    for i in range(1, n):
        up = field[i, 1] + b[i, 1] + beta[i - 1] * out[:, i - 1]
        down = field[i, 0] + b[i, 0] - beta[i - 1] * out[:, i - 1]
        out[:, i] = np.where(rng.random(size) < 1 / (1 + np.exp(down - up)), 1, -1)
    return out


def metropolis(alpha, beta, sweeps: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """(size, N) approximate draws: ``sweeps`` passes of single-site Metropolis moves over all chains at once."""
    a, b = np.asarray(alpha, float), np.asarray(beta, float)
    x = np.where(rng.random((size, len(a))) < 0.5, 1, -1)
    for _ in range(sweeps):
        for i in range(len(a)):
            pull = a[i] + (b[i - 1] * x[:, i - 1] if i else 0) + (b[i] * x[:, i + 1] if i + 1 < len(a) else 0)
            # flipping changes the exponent by -2 x pull
            flip = np.log(1 - rng.random(size)) < -2 * x[:, i] * pull
            x[flip, i] *= -1
    return x.astype(np.int8)


def emissions(x: np.ndarray, rng: np.random.Generator, sd: float = 2.0, mean: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(log p(y | -1), log p(y | +1)) of Gaussian readings around -mean and +mean."""
    y = x * mean + rng.normal(0, sd, x.shape)
    return -((y + mean) ** 2) / (2 * sd**2), -((y - mean) ** 2) / (2 * sd**2)


@dataclass
class Fit:
    phi: np.ndarray
    q: float
    converged: bool


class Terms:
    """What the sufficient statistics of a region are: its sites or groups n, rho, d."""

    def __init__(self, n, rho, d) -> None:
        self.n, self.rho = np.asarray(n, float), np.asarray(rho, float)
        self.inv_d = 1 / np.asarray(d, float)[: len(self.rho) - 1]
        self.reach = np.asarray([self.n.sum(), np.abs(self.n * self.rho).sum(), self.inv_d.sum()])

    def parameters(self, phis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.n * (phis[:, :1] + phis[:, 1:2] * self.rho), phis[:, 2:] * self.inv_d

    def stats(self, p: np.ndarray, exx: np.ndarray) -> np.ndarray:
        ex = (p * S).sum(-1)
        return np.stack([(self.n * ex).sum(-1), (self.n * self.rho * ex).sum(-1), (exx * self.inv_d).sum(-1)], axis=-1)

    def moments(self, phis: np.ndarray) -> np.ndarray:
        a, b = self.parameters(phis)
        _, p, exx, _, _ = expectations(fields(a), b)
        return self.stats(p, exx)

    def expected(self, phis: np.ndarray, evidence: np.ndarray) -> np.ndarray:
        """Statistics of each read under its posterior: (phis, reads, 3)."""
        a, b = self.parameters(phis)
        _, p, exx, _, _ = expectations(fields(a)[:, None] + evidence, b[:, None])
        return self.stats(p, exx)

    def log_likelihoods(self, phis: np.ndarray, evidence: np.ndarray) -> np.ndarray:
        """log p(y) of each read: (phis, reads)."""
        a, b = self.parameters(phis)
        return expectations(fields(a)[:, None] + evidence, b[:, None])[0] - expectations(fields(a), b)[0][:, None]


def evidence_of(log_u: np.ndarray, log_m: np.ndarray) -> np.ndarray:
    """Reads x groups x 2 log-likelihoods, 0 where a group isn't observed."""
    return np.where(~np.isnan(log_u)[..., None], np.stack([log_u, log_m], axis=-1), 0.0)


def random_starts(starts: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.asarray([[rng.integers(-500, 501) / 100, rng.uniform(-50, 50), rng.uniform(0, 10)] for _ in range(starts)]).reshape(-1, 3)


BOX = (20.0, 150.0, 50.0)


def m_step(terms: Terms, phi: np.ndarray, target: np.ndarray, first: bool, tol: float = 0.03, box=BOX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(new phi, which are done, which go on) of starts whose reads have the mean statistics ``target``.

    The statistics are matched by damped Newton, whose Jacobian is their covariance by differences of
    the exact expectations. A start that no longer moves is done only if its moments match but for
    1 % of their range (a start where all is saturated doesn't move either).
    """
    limit = np.asarray(box)
    new = _match(phi, target, terms.moments, limit)
    if first:
        return new, np.zeros(len(new), bool), np.ones(len(new), bool)
    still = np.linalg.norm(new - phi, axis=1) <= tol
    off = np.abs(_free(new, terms.moments(new) - target, limit)) > 0.01 * terms.reach
    return new, still & ~off.any(axis=1), ~still


def fit_em(log_u: np.ndarray, log_m: np.ndarray, n: np.ndarray, rho: np.ndarray, d: np.ndarray, starts: int = 10, iters: int = 20, seed: int = 0, tol: float = 0.03, box=BOX, most_reads: int = 100) -> Fit:
    """EM for (a, b, c) from reads x groups log-likelihoods (NaN where not observed).

    The best of several random starts counts, by the likelihood of at most ``most_reads`` reads; a
    start must be done within ``iters``. All starts are stepped at once.
    """
    terms, evidence = Terms(n, rho, d), evidence_of(log_u, log_m)
    phi = random_starts(starts, seed)
    done, going = np.zeros(starts, bool), np.arange(starts)
    for it in range(iters):
        target = terms.expected(phi[going], evidence).mean(axis=1)
        phi[going], done[going], on = m_step(terms, phi[going], target, not it, tol, box)
        going = going[on]
        if not len(going):
            break
    if not done.any():
        return Fit(np.full(3, np.nan), -np.inf, False)
    q = terms.log_likelihoods(phi[done], evidence[:most_reads]).mean(axis=1)
    return Fit(phi[done][q.argmax()], float(q.max()), True)


def _free(x: np.ndarray, gap: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """``gap`` without what the box holds back: parameters at a bound that are drawn beyond it."""
    return np.where(((x >= limit) & (gap < 0)) | ((x <= -limit) & (gap > 0)), 0.0, gap)


def _match(phi: np.ndarray, target: np.ndarray, moments, limit: np.ndarray, steps: int = 20, tol: float = 1e-3) -> np.ndarray:
    """Rows of phi whose moments are ``target``'s as far as the box lets them, each by its own damped
    Newton steps of the parameters that aren't held at a bound. No step is longer than the box."""
    x = phi.copy()
    gap = _free(x, moments(x) - target, limit)
    on = np.flatnonzero(np.abs(gap).max(axis=1) >= tol)
    for _ in range(steps):
        if not len(on):
            break
        h = 1e-4 * np.maximum(1, np.abs(x[on]))
        shift = h[:, :, None] * np.eye(3)
        sides = moments(np.concatenate([x[on][:, None] + shift, x[on][:, None] - shift], axis=1).reshape(-1, 3)).reshape(len(on), 6, 3)  # all six of all rows in one batch
        jac = ((sides[:, :3] - sides[:, 3:]) / (2 * h[:, :, None])).transpose(0, 2, 1)
        held = (gap[on] == 0) & (np.abs(x[on]) >= limit)
        jac = np.where(held[:, :, None] | held[:, None, :], held[:, :, None] * np.eye(3), jac)
        step = (np.linalg.pinv(jac + 1e-9 * np.eye(3)) @ gap[on][:, :, None])[:, :, 0]
        step /= np.maximum(1, np.abs(step / limit).max(axis=1))[:, None]
        left, better, scale = np.arange(len(on)), np.zeros(len(on), bool), 1.0
        while len(left) and scale > 1e-4:
            y = np.clip(x[on[left]] - scale * step[left], -limit, limit)
            then = _free(y, moments(y) - target[on[left]], limit)
            good = np.linalg.norm(then, axis=1) < np.linalg.norm(gap[on[left]], axis=1)
            rows = on[left[good]]
            x[rows], gap[rows], better[left[good]] = y[good], then[good], True
            left, scale = left[~good], scale / 2
        on = on[better]
        on = on[np.abs(gap[on]).max(axis=1) >= tol]
    return x
