"""ARIMA(p, 1, 0) for any number of series at once.

The model is an autoregression of first differences, fitted by conditional least squares or by exact
likelihood. Both need only cross-products, which are plain sums over lag columns, and the first p
differences, so the rows stay in the JVM and each series leaves one small row to be solved.
"""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def _products(daily: DataFrame, p: int, target: str, segment) -> DataFrame:
    w = Window.partitionBy(*segment).orderBy("date")
    rows = daily.select(*segment, "date", F.col(target).cast("double").alias("y"))
    rows = rows.withColumn("d0", F.col("y") - F.lag("y").over(w))
    rows = rows.withColumns({f"d{k}": F.lag("d0", k).over(w) for k in range(1, p + 1)})
    rows = rows.withColumn("age", F.row_number().over(Window.partitionBy(*segment).orderBy(F.desc("date"))))
    rows = rows.withColumn("place", F.row_number().over(w))
    usable = F.col(f"d{p}").isNotNull()
    sums = [F.coalesce(F.sum(F.when(usable, F.col(f"d{i}") * F.col(f"d{j}"))), F.lit(0.0))
            for i in range(p + 1) for j in range(i, p + 1)]
    tail = F.transform(F.sort_array(F.collect_list(F.when(F.col("age") <= p + 1, F.struct("date", "y")))),
                       lambda s: s["y"])
    head = F.transform(F.sort_array(F.collect_list(F.when((F.col("place") > 1) & (F.col("place") <= p + 1), F.struct("date", "d0")))),
                       lambda s: s["d0"])
    return rows.groupBy(*segment).agg(F.array(*sums).alias("sums"), F.count_if(usable).alias("n"),
                                      tail.alias("tail"), head.alias("head"), F.max("date").alias("last_date"))


def _products_matrix(p: int, sums) -> np.ndarray:
    m = np.zeros((p + 1, p + 1))
    m[np.triu_indices(p + 1)] = sums
    return m + np.triu(m, 1).T


def _solve(p: int, sums, n: int) -> tuple[np.ndarray, float]:
    m = _products_matrix(p, sums)
    phi = np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0]
    return phi, max(float(m[0, 0] - phi @ m[1:, 0]), 0.0) / n


def _orders(partial: np.ndarray) -> list[np.ndarray]:
    """Coefficients of the best predictors of order 0 to p that partial autocorrelations stand for."""
    found = [np.zeros(0)]
    for r in partial:
        found.append(np.append(found[-1] - r * found[-1][::-1], r))
    return found


def partial_autocorrelations(phi: np.ndarray) -> np.ndarray | None:
    """Of stationary coefficients; None for others."""
    out, phi = [], np.asarray(phi, float)
    while len(phi):
        r, rest = phi[-1], phi[:-1]
        if abs(r) >= 1:
            return None
        out.append(r)
        phi = (rest + r * rest[::-1]) / (1 - r * r)
    return np.array(out[::-1])


def log_likelihood(partial: np.ndarray, products: np.ndarray, head: np.ndarray, n: int) -> tuple[float, float]:
    """(log-likelihood, innovation variance) of differences with these partial autocorrelations, at the best variance.

    ``products`` are the sums over the ``n`` differences that have p earlier ones, ``head`` the first p. The state of p lags
    starts at its stationary law: each of the first p differences is predicted from those before it, with the variance that
    the partial autocorrelations still to come add; from then on the variance is that of the innovations.
    """
    p, orders = len(partial), _orders(partial)
    wide = 1.0 / (1.0 - partial * partial)
    start = np.cumprod(wide[::-1])[::-1]
    missed = np.array([head[t] - orders[t] @ head[:t][::-1] for t in range(p)])
    phi = np.append(1.0, -orders[p])
    total = float(phi @ products @ phi + (missed * missed / start).sum())
    count = n + p
    sigma2 = max(total, 0.0) / count
    return -0.5 * (count * (np.log(2 * np.pi * max(sigma2, 1e-300)) + 1.0) + np.log(start).sum()), sigma2


def _most_likely(p: int, sums, head, n: int) -> tuple[np.ndarray, float, float]:
    """(coefficients, innovation variance, log-likelihood): quasi-Newton steps over unbounded images of the partial
    autocorrelations, from the least-squares solution where that is stationary."""
    products, head = _products_matrix(p, sums), np.asarray(head, float)
    size = np.sqrt(max(products[0, 0], 1e-300) / n)
    loss = lambda u: -log_likelihood(np.tanh(u), products / size ** 2, head / size, n)[0]
    def slope(u):
        step = 1e-5
        return np.array([(loss(u + step * e) - loss(u - step * e)) / (2 * step) for e in np.eye(p)])
    near = partial_autocorrelations(_solve(p, sums, n)[0])
    u = np.arctanh(np.clip(near, -0.99, 0.99)) if near is not None else np.zeros(p)
    at, g, inverse = loss(u), slope(u), np.eye(p) / max(n, 1)
    for _ in range(200):
        move = -inverse @ g
        if g @ move >= 0:
            inverse = np.eye(p) / max(n, 1)
            move = -inverse @ g
        rate = 1.0
        while loss(u + rate * move) > at + 1e-4 * rate * (g @ move) and rate > 1e-8:
            rate /= 2
        if rate <= 1e-8:
            break
        u, old, before = u + rate * move, g, at
        at, g = loss(u), slope(u)
        change, turn = rate * move, g - old
        if change @ turn > 1e-12:
            flat = np.eye(p) - np.outer(change, turn) / (change @ turn)
            inverse = flat @ inverse @ flat.T + np.outer(change, change) / (change @ turn)
        if before - at < 1e-10 * (1 + abs(at)) and np.abs(g).max() < 1e-4 * max(n, 1) ** 0.5:
            break
    best, sigma2 = log_likelihood(np.tanh(u), products, head, n)
    return _orders(np.tanh(u))[p], sigma2, best


def fit(daily: DataFrame, p: int = 5, target: str = "total_revenue", segment: tuple[str, ...] = (), exact: bool = False) -> DataFrame:
    """One row per series: coefficients, innovation variance, AIC, BIC and what a forecast needs.

    ``exact`` maximises the likelihood of all differences, the first ones too, and then counts them all in ``n``; else they
    are taken as given. Series of at most 2 p differences are left out.
    """
    kinds = dict(daily.dtypes)

    def solve(batches):
        for pdf in batches:
            pdf = pdf[pdf["n"] > p]
            if exact:
                fits = [_most_likely(p, *r) for r in zip(pdf["sums"], pdf["head"], pdf["n"])]
                out = pdf[[*segment, "last_date", "tail", "n"]].copy()
                out["n"] += p
                out["phi"], out["sigma2"] = [f[0].tolist() for f in fits], [f[1] for f in fits]
                loglik = np.array([f[2] for f in fits])
                out["aic"], out["bic"] = 2 * (p + 1) - 2 * loglik, (p + 1) * np.log(out["n"].to_numpy(float)) - 2 * loglik
                yield out
                continue
            fits = [_solve(p, s, n) for s, n in zip(pdf["sums"], pdf["n"])]
            out = pdf[[*segment, "last_date", "tail", "n"]].copy()
            out["phi"], out["sigma2"] = [f[0].tolist() for f in fits], [f[1] for f in fits]
            n, s2 = pdf["n"].to_numpy(float), np.maximum(out["sigma2"].to_numpy(float), 1e-300)
            loglik = -0.5 * n * (np.log(2 * np.pi * s2) + 1.0)
            out["aic"], out["bic"] = 2 * (p + 1) - 2 * loglik, (p + 1) * np.log(n) - 2 * loglik
            yield out

    head = ", ".join(f"{c} {kinds[c]}" for c in segment)
    schema = (head + ", " if head else "") + ("last_date date, tail array<double>, n long, phi array<double>, "
                                              "sigma2 double, aic double, bic double")
    return _products(daily, p, target, segment).mapInPandas(solve, schema)


def likelihoods(daily: DataFrame, given: list[list[float]], target: str = "total_revenue", segment: tuple[str, ...] = ()) -> DataFrame:
    """(segment, candidate, n, sigma2, loglik): the exact likelihood of each series for each of the ``given`` lists of stationary
    coefficients, all of one length."""
    kinds, p = dict(daily.dtypes), len(given[0])
    partials = [partial_autocorrelations(g) for g in given]
    if any(r is None or len(r) != p for r in partials):
        raise ValueError("coefficients must be stationary and of one length")

    def run(batches):
        for pdf in batches:
            rows = [(*[getattr(r, c) for c in segment], i, r.n + p, s2, ll) for r in pdf[pdf["n"] > 0].itertuples(index=False)
                    for i, g in enumerate(partials) for ll, s2 in [log_likelihood(g, _products_matrix(p, r.sums), np.asarray(r.head, float), r.n)]]
            yield pd.DataFrame(rows, columns=[*segment, "candidate", "n", "sigma2", "loglik"])

    head = "".join(f"{c} {kinds[c]}, " for c in segment)
    return _products(daily, p, target, segment).mapInPandas(run, head + "candidate int, n long, sigma2 double, loglik double")


def forecast(fitted: DataFrame, horizon: int = 7, segment: tuple[str, ...] = ()) -> DataFrame:
    """Future days of every series with 95 % intervals from the psi weights."""
    kinds = dict(fitted.dtypes)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                phi, tail = np.array(r.phi), np.array(r.tail)
                level, diffs = tail[-1], list(np.diff(tail))
                psi_d, psi, spread = [1.0], [1.0], 0.0
                for step in range(1, horizon + 1):
                    diff = float(np.dot(phi, diffs[::-1][:len(phi)]))
                    level, diffs = level + diff, diffs + [diff]
                    spread += psi[-1] ** 2
                    half = Z * np.sqrt(r.sigma2 * spread)
                    key = [getattr(r, c) for c in segment]
                    rows.append((*key, step, r.last_date + timedelta(days=step), level, level - half, level + half))
                    psi_d.append(float(np.dot(phi[:len(psi_d)], psi_d[::-1][:len(phi)])))
                    psi.append(psi[-1] + psi_d[-1])
            yield pd.DataFrame(rows, columns=[*segment, "step", "date", "value", "confidence_lower", "confidence_upper"])

    head = ", ".join(f"{c} {kinds[c]}" for c in segment)
    schema = (head + ", " if head else "") + ("step int, date date, value double, confidence_lower double, "
                                              "confidence_upper double")
    return fitted.mapInPandas(run, schema).withColumn("model", F.lit("arima"))
