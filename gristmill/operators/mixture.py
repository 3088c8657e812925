"""Gaussian mixtures of all folds and starts in the same passes of expectation-maximisation.

Rows carry the first fold that may learn from them, so folds are nested sums. A pass is one job: each task adds up,
for every fold, start and component, the responsibilities and the moments they weigh; the driver gets one row of a
fixed size, and makes the next parameters of it. Of the starts of a fold the likeliest wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which the starts are drawn, those with the least hashes; added to variances, so that none vanishes.
DRAWN, LEAST_VARIANCE = 2048, 1e-6


@dataclass
class Mixture:
    """Parameters of one fold and start, of rows scaled by ``centre`` and ``scale``."""

    centre: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    likelihood: float = -np.inf  # mean log likelihood of the rows learned from

    def joint(self, x: np.ndarray) -> np.ndarray:
        """log of weight times density, a column a component."""
        z = (x - self.centre) / self.scale
        out = np.empty((len(z), len(self.weight)))
        for i, (w, m, c) in enumerate(zip(self.weight, self.mean, self.cov, strict=True)):
            root = np.linalg.cholesky(c)
            y = np.linalg.solve(root, (z - m).T)
            out[:, i] = np.log(w) - 0.5 * (y * y).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * len(m) * np.log(2 * np.pi)
        return out

    def posterior(self, x: np.ndarray) -> np.ndarray:
        j = self.joint(x)
        p = np.exp(j - j.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _start(x: np.ndarray, k: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of groups about seeds that lie apart, after some rounds of nearest means."""
    rng = np.random.default_rng(seed)
    means = x[rng.integers(len(x))][None]
    for _ in range(1, k):
        d = ((x[:, None] - means[None]) ** 2).sum(axis=2).min(axis=1)
        means = np.r_[means, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))][None]]
    for _ in range(10):
        own = ((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.stack([x[own == i].mean(axis=0) if (own == i).any() else means[i] for i in range(k)])
    size = np.maximum(np.bincount(own, minlength=k), 1.0)
    spread = np.cov(x.T).reshape(x.shape[1], -1) + LEAST_VARIANCE * np.eye(x.shape[1])
    cov = [np.cov(x[own == i].T).reshape(spread.shape) + LEAST_VARIANCE * np.eye(len(spread)) if (own == i).sum() > x.shape[1] + 1 else spread for i in range(k)]
    return size / size.sum(), means, np.stack(cov)


def fit(rows: DataFrame, columns: list[str], n_folds: int, k: int = 4, starts: int = 4, seed: int = 7, rounds: int = 100, tolerance: float = 1e-3, least: int = 250) -> list[list[Mixture]]:
    """For each fold the mixtures of all starts, the likeliest first; none for a fold with fewer than ``least`` rows.
    ``rows`` has ``first``, the first fold that learns from a row, ``key`` to draw by, and no nulls in ``columns``.
    Give a written frame: each pass reads it once."""
    d = len(columns)
    x_of = lambda batch: np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1)
    sums = rows.where(F.col("first") < n_folds).groupBy("first").agg(F.count("*").alias("n"), *(f(F.col(c) if p == 1 else F.pow(F.col(c), 2)).alias(f"s{p}_{c}") for c in columns for p, f in ((1, F.sum), (2, F.sum)))).collect()  # a row a fold
    found: list[list[Mixture]] = []
    for f in range(n_folds):
        own = [r for r in sums if r["first"] <= f]
        n = sum(r["n"] for r in own)
        if n < max(least, k):
            found.append([])
            continue
        # drawn for each fold by itself: what comes later must not push out what a fold starts from
        drawn = rows.where(F.col("first") <= f).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(DRAWN).select(*columns).collect()
        some = np.array(drawn, float).reshape(-1, d)
        one, two = (np.array([sum(r[f"s{p}_{c}"] for r in own) for c in columns]) for p in (1, 2))
        centre = one / n
        scale = np.sqrt(np.maximum(two / n - centre**2, 0.0))
        scale[scale == 0] = 1.0
        found.append([Mixture(centre, scale, *_start((some - centre) / scale, k, [seed, s])) for s in range(starts)])
    active = {(f, s) for f in range(n_folds) for s in range(len(found[f]))}
    width = 1 + k * (1 + d + d * d)
    for _ in range(rounds):
        if not active:
            break
        todo = sorted(active)

        def one_pass(batches: Iterator[pa.RecordBatch], todo=todo) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(todo), width))
            for batch in batches:
                x, first = x_of(batch), batch.column(d).to_numpy()
                for i, (f, s) in enumerate(todo):
                    model = found[f][s]
                    own = x[first <= f]
                    if len(own):
                        j = model.joint(own)
                        top = j.max(axis=1, keepdims=True)
                        e = np.exp(j - top)
                        r, z = e / e.sum(axis=1, keepdims=True), (own - model.centre) / model.scale
                        total[i, 0] += (top[:, 0] + np.log(e.sum(axis=1))).sum()
                        total[i, 1:] += np.concatenate([r.sum(axis=0), (r.T @ z).reshape(-1), np.einsum("nk,ni,nj->kij", r, z, z).reshape(-1)])
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "v"])

        got = rows.select(*columns, "first").mapInArrow(one_pass, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()
        total = got["v"].to_numpy().reshape(len(todo), width)
        for (f, s), t in zip(todo, total, strict=True):
            model = found[f][s]
            size = np.maximum(t[1 : 1 + k], 1e-10)
            mean = t[1 + k : 1 + k + k * d].reshape(k, d) / size[:, None]
            cov = t[1 + k + k * d :].reshape(k, d, d) / size[:, None, None] - mean[:, :, None] * mean[:, None, :] + LEAST_VARIANCE * np.eye(d)
            now = float(t[0] / t[1 : 1 + k].sum())
            if now - model.likelihood < tolerance:  # what the parameters before this pass gave
                active.discard((f, s))
            found[f][s] = Mixture(model.centre, model.scale, size / size.sum(), mean, (cov + np.swapaxes(cov, 1, 2)) / 2, max(now, model.likelihood))
    return [sorted(own, key=lambda m: -m.likelihood) for own in found]
