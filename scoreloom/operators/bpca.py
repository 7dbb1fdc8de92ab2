"""Bayesian PCA and the imputer built on it.

The variational updates need the data only through row count, column sums and the matrix of
cross products.  Spark adds those up in one pass; the d x d updates run on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import TableEstimator, TableModel
from .matrices import sum_arrays
from .ordering import hash_prefix


class Posterior:
    """Variational posterior of ``x = W z + mu + noise`` with one precision per latent column."""

    def __init__(self, n: float, s: np.ndarray, gram: np.ndarray, prior: float, beta: float):
        d = len(s)
        self.d, self.q, self.prior, self.beta = d, d - 1, prior, beta
        self.mu = s / n
        cov = gram / n - np.outer(self.mu, self.mu)
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
        noise = max(float(values[self.q :].mean()), 1e-12)
        self.w = vectors[:, : self.q] * np.sqrt(np.clip(values[: self.q] - noise, 1e-12, None))
        self.cov_w = np.zeros((self.q, self.q))
        self.tau = 1.0 / noise
        self.alpha = (prior + d / 2) / (prior + 0.5 * (self.w**2).sum(axis=0))

    def update(self, n: float, s: np.ndarray, gram: np.ndarray) -> None:
        """One round of z, mu, W, alpha, tau."""
        d, q, prior = self.d, self.q, self.prior
        ww = self.w.T @ self.w + d * self.cov_w
        cov_z = np.linalg.inv(np.eye(q) + self.tau * ww)
        to_z = self.tau * cov_z @ self.w.T
        center = self.mu
        sum_z = to_z @ (s - n * center)
        shifted = gram - np.outer(s, center) - np.outer(center, s) + n * np.outer(center, center)
        zz = n * cov_z + to_z @ shifted @ to_z.T
        cov_mu = 1.0 / (self.beta + n * self.tau)
        self.mu = self.tau * cov_mu * (s - self.w @ sum_z)
        z_x = to_z @ (gram - np.outer(center, s))
        self.cov_w = np.linalg.inv(np.diag(self.alpha) + self.tau * zz)
        self.w = (self.tau * self.cov_w @ (z_x - np.outer(sum_z, self.mu))).T
        ww = self.w.T @ self.w + d * self.cov_w
        self.alpha = (prior + d / 2) / (prior + 0.5 * np.diag(ww))
        error = (
            np.trace(gram)
            + n * (self.mu @ self.mu + d * cov_mu)
            + np.trace(ww @ zz)
            + 2 * self.mu @ self.w @ sum_z
            - 2 * np.trace(self.w @ z_x)
            - 2 * s @ self.mu
        )
        self.tau = (prior + n * d / 2) / (prior + 0.5 * max(float(error), 1e-12))

    def captured(self) -> list[int]:
        """Latent columns whose variance share is below the mean variance."""
        spread = 1.0 / self.alpha
        return [i for i in range(self.q) if spread[i] < spread.mean()]

    def log_likelihood(self, n: float, s: np.ndarray, gram: np.ndarray) -> float:
        """Gaussian marginal log-likelihood of the data behind the statistics."""
        cov = self.w @ self.w.T + np.eye(self.d) / self.tau
        shifted = (
            gram - np.outer(s, self.mu) - np.outer(self.mu, s) + n * np.outer(self.mu, self.mu)
        )
        _, logdet = np.linalg.slogdet(cov)
        return float(
            -0.5 * (n * (self.d * np.log(2 * np.pi) + logdet) + np.trace(np.linalg.solve(cov, shifted)))
        )


def projection(w: np.ndarray, tau: float) -> np.ndarray:
    """Posterior-mean map from a centred observation to its latent coordinates."""
    return np.linalg.solve(w.T @ w + np.eye(w.shape[1]) / tau, w.T)


class BayesianPCAModel(TableModel):
    """``transform`` adds latent coordinates ``z_i``; ``reconstruct`` maps a frame back."""

    def _matrices(self, full: bool):
        w, mu = np.array(self.info["w"]), np.array(self.info["mu"])
        if not full:
            w = w[:, self.info["captured"]]
        return w, mu, projection(w, self.info["tau"])

    def _transform(self, df: DataFrame, full: bool = True) -> DataFrame:
        _, mu, to_z = self._matrices(full)
        columns = self.info["columns"]
        return df.withColumns({f"z_{i}": _linear(columns, row, -row @ mu) for i, row in enumerate(to_z)})

    def reconstruct(self, df: DataFrame, full: bool = True) -> DataFrame:
        """Add ``<col>_hat``, the observation implied by the latent coordinates."""
        w, mu, to_z = self._matrices(full)
        maps = w @ to_z
        columns = self.info["columns"]
        return df.withColumns(
            {f"{c}_hat": _linear(columns, maps[i], mu[i] - maps[i] @ mu) for i, c in enumerate(columns)}
        )


def _linear(columns: Sequence[str], weights: np.ndarray, constant: float) -> Column:
    total = F.lit(float(constant))
    for c, w in zip(columns, weights):
        total = total + F.lit(float(w)) * F.col(f"`{c}`")
    return total


class BayesianPCA(TableEstimator):
    """Fits the posterior with ``updates`` rounds over hashed ``batches`` of the rows.

    All batches are summed in a single pass; the state is ``batches * d^2`` numbers.
    """

    def __init__(
        self,
        columns: Sequence[str],
        updates: int = 20,
        batches: int = 1,
        id_col: str | None = None,
        seed: int = 0,
        prior: float = 1e-3,
        beta: float = 1e-3,
    ):
        super().__init__()
        if len(columns) < 2:
            raise ValueError("at least two columns are needed")
        if not 1 <= batches <= 200:
            raise ValueError("batches must be between 1 and 200")
        if batches > 1 and not id_col:
            raise ValueError("batches need id_col")
        self.columns, self.updates, self.batches = list(columns), updates, batches
        self.id_col, self.seed, self.prior, self.beta = id_col, seed, prior, beta

    def _fit(self, df: DataFrame) -> BayesianPCAModel:
        d, k = len(self.columns), self.batches
        size = 1 + d + d * d
        batch = F.pmod(hash_prefix(self.id_col, self.seed), F.lit(k)) if k > 1 else F.lit(0)

        def partial(x):
            out = np.zeros((k, size))
            for b in range(k):
                rows = x[x[:, 0] == b, 1:]
                out[b] = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
            return out.ravel()

        values = [F.col(f"`{c}`").cast("double") for c in self.columns]
        stats = sum_arrays(df, [batch.cast("double"), *values], k * size, partial).reshape(k, size)
        split = [(b[0], b[1 : d + 1], b[d + 1 :].reshape(d, d)) for b in stats if b[0] > 0]
        whole = tuple(sum(part[i] for part in split) for i in range(3))
        posterior = Posterior(*whole, self.prior, self.beta)
        likelihood = []
        for _ in range(self.updates):
            for part in split:
                posterior.update(*part)
            likelihood.append(posterior.log_likelihood(*whole))
        return BayesianPCAModel(
            {
                "columns": self.columns,
                "w": posterior.w.tolist(),
                "mu": posterior.mu.tolist(),
                "tau": posterior.tau,
                "alpha": posterior.alpha.tolist(),
                "captured": posterior.captured(),
                "log_likelihood": likelihood,
            }
        )


class BPCAImputerModel(TableModel):
    """Fills missing cells with one reconstruction of the mean-filled row."""

    def _transform(self, df: DataFrame) -> DataFrame:
        columns = self.info["columns"]
        values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns]
        row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
        means = [0.0 if m is None else m for m in row]
        maps, shift = np.array(self.info["maps"]), np.array(self.info["shift"])
        start = {f"_s{i}": F.coalesce(v, F.lit(m)) for i, (v, m) in enumerate(zip(values, means))}
        names = list(start)
        filled = {
            c: F.coalesce(values[i], _linear(names, maps[i], shift[i])) for i, c in enumerate(columns)
        }
        return df.withColumns(start).withColumns(filled).drop(*names)


class BPCAImputer(TableEstimator):
    """Alternates fitting and refilling for at most ``epochs`` rounds.

    A refill is kept only when the squared error on observed cells went down.  A row's current
    values are a function of its original cells and the few accepted maps, so every epoch is one
    pass over the original frame and nothing is cached or written between epochs.
    """

    def __init__(
        self,
        columns: Sequence[str],
        epochs: int = 10,
        early_stopping: int = 20,
        err_threshold: float = 1e-5,
        full: bool = True,
        updates: int = 5,
        prior: float = 1e-3,
        beta: float = 1e-3,
    ):
        super().__init__()
        self.columns, self.epochs, self.early_stopping = list(columns), epochs, early_stopping
        self.err_threshold, self.full, self.updates = err_threshold, full, updates
        self.prior, self.beta = prior, beta

    def _fit(self, df: DataFrame) -> BPCAImputerModel:
        d = len(self.columns)
        values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in self.columns]
        row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
        means = np.array([0.0 if m is None else m for m in row])
        accepted: list[tuple[np.ndarray, np.ndarray]] = []

        def statistics(candidate):
            """Error of the candidate map, and the statistics of the rows it would give."""
            maps = list(accepted)

            def partial(raw):
                missing = np.isnan(raw)
                x = np.where(missing, means, raw)
                for matrix, shift in maps:
                    x = np.where(missing, x @ matrix.T + shift, x)
                error = 0.0
                if candidate is not None:
                    guess = x @ candidate[0].T + candidate[1]
                    error = float((((x - guess) ** 2) * ~missing).sum())
                    x = np.where(missing, guess, x)
                return np.concatenate([[error, len(x)], x.sum(axis=0), (x.T @ x).ravel()])

            t = sum_arrays(df, values, 2 + d + d * d, partial)
            return t[0] / max(t[1], 1.0), (t[1], t[2 : d + 2], t[d + 2 :].reshape(d, d))

        _, current = statistics(None)
        posterior = Posterior(*current, self.prior, self.beta)
        best, still, errors, kept = np.inf, 0, [], []
        for _ in range(self.epochs):
            for _ in range(self.updates):
                posterior.update(*current)
            w = posterior.w if self.full else posterior.w[:, posterior.captured()]
            matrix = w @ projection(w, posterior.tau)
            candidate = (matrix, posterior.mu - matrix @ posterior.mu)
            error, refilled = statistics(candidate)
            change = error - best
            errors.append(error)
            if abs(change) < self.err_threshold:
                still += 1
                if still >= self.early_stopping:
                    break
            else:
                still = 0
            if change < 0:
                accepted.append(candidate)
                kept.append(error)
                current, best = refilled, error
        matrix, shift = candidate
        return BPCAImputerModel(
            {
                "columns": self.columns,
                "maps": matrix.tolist(),
                "shift": shift.tolist(),
                "errors": errors,
                "accepted_errors": kept,
            }
        )


