"""Gaussian mixtures of many groups at once by expectation maximisation.

All groups take their steps together: an iteration is one job whatever the number of groups. The expectation is a set
of columns over the rows, the maximisation a grouped sum of moments, and only the few numbers of a group's model pass
through numpy, in batches of models. A group that has settled keeps its model and its rows take no further part.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.readers import small
from .quantiles import exact_quantiles
from .store import stored

RIDGE = 1e-6
_PARTS = "mean array<double>, scale array<double>, lw array<double>, mu array<double>, li array<double>, ll double, was double, n long"


def _scaled(cols: Sequence[str]) -> list[Column]:
    """Columns in units of their group; a constant column is zero."""
    return [(F.col(c) - F.get("mean", F.lit(i))) * F.get("scale", F.lit(i)) for i, c in enumerate(cols)]


def _densities(z: Sequence[Column], k: int) -> list[Column]:
    """Log of weight times density of each component, up to a constant: the inverse Cholesky factor whitens the row."""
    d = len(z)
    out = []
    for c in range(k):
        x = [z[i] - F.get("mu", F.lit(c * d + i)) for i in range(d)]
        sq = F.lit(0.0)
        for i in range(d):
            y = F.lit(0.0)
            for j in range(i + 1):
                y += F.get("li", F.lit((c * d + i) * d + j)) * x[j]
            sq += y * y
        out.append(F.get("lw", F.lit(c)) - sq / 2)
    return out


def _sums(z: Sequence[Column], r: Sequence[Column]) -> list[Column]:
    """Responsibility, first and second moments of each component, in this order."""
    d = len(z)
    out = []
    for w in r:
        out.append(F.sum(w))
        out += [F.sum(w * z[i]) for i in range(d)]
        out += [F.sum(w * z[i] * z[j]) for i in range(d) for j in range(i + 1)]
    return out


def _models(moments: DataFrame, keys: list[str], d: int, k: int) -> DataFrame:
    """Models from grouped moments: a handful of numbers a group, solved in batches."""
    low = np.tril_indices(d)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m = np.stack(b["moments"].to_numpy()).astype(float).reshape(len(b), k, -1)
            w = m[:, :, 0]
            safe = np.maximum(w, 1e-10)[..., None]
            mu = m[:, :, 1:d + 1] / safe
            cov = np.zeros((len(b), k, d, d))
            cov[:, :, low[0], low[1]] = m[:, :, d + 1:] / safe
            cov = np.maximum(np.tril(cov), 0) * np.eye(d) + np.tril(cov, -1) + np.swapaxes(np.tril(cov, -1), -1, -2)
            cov -= mu[..., :, None] * mu[..., None, :]
            # a component that no row belongs to is a unit ball of no weight
            none = (w < 1e-8)[..., None, None]
            value, axes = np.linalg.eigh(np.where(none, np.eye(d), cov))
            cov = (axes * np.maximum(value, RIDGE)[..., None, :]) @ np.swapaxes(axes, -1, -2)
            li = np.linalg.inv(np.linalg.cholesky(cov))
            share = np.maximum(w / np.maximum(w.sum(1, keepdims=True), 1e-10), 1e-300)
            lw = np.log(share) + np.log(np.diagonal(li, axis1=-2, axis2=-1)).sum(-1)
            out = b[keys + ["mean", "scale", "ll", "was", "n"]].copy()
            out["lw"], out["mu"], out["li"] = list(lw), list(mu.reshape(len(b), -1)), list(li.reshape(len(b), -1))
            yield out[keys + ["mean", "scale", "lw", "mu", "li", "ll", "was", "n"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.schema if f.name in keys)
    return moments.mapInPandas(solve, f"{kinds}, {_PARTS}")


def fit(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int = 3, iterations: int = 50, tol: float = 1e-3) -> DataFrame:
    """One model per group of ``keys``: mean and scale of the columns, log weights, means, inverse Cholesky factors.

    It starts from the ``k`` equal parts of the first column and ends, for each group, when the mean log likelihood
    rises by less than ``tol`` divided by the number of columns, or after ``iterations``. The result does not depend on how
    rows are spread, but for rounding. Rows with a null in a column or a null key are left out; no rows, no models; a group
    of equal rows has one ball. A large group is summed in part before the shuffle. One pass over the columns an iteration.
    """
    keys, cols, d = list(keys), list(cols), len(cols)
    rows = stored(rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).na.drop())
    scale = F.array(*[F.coalesce(1 / F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(0.0)) for c in cols])
    units = rows.groupBy(*keys).agg(F.array(*[F.avg(c) for c in cols]).alias("mean"), scale.alias("scale"), F.count(F.lit(1)).alias("n"))
    cuts = exact_quantiles(rows, keys, cols[0], {f"_q{i}": i / k for i in range(1, k)})
    units = stored(units.join(cuts, keys) if k > 1 else units)
    z = [F.col(f"_z{i}") for i in range(d)]
    scaled = {f"_z{i}": c for i, c in enumerate(_scaled(cols))}

    start = rows.join(small(units), keys).withColumns(scaled)
    part = F.lit(0)
    for i in range(1, k):
        part = part + (F.col(cols[0]) >= F.col(f"_q{i}")).cast("int")
    moments = start.withColumn("_part", part).groupBy(*keys).agg(
        F.array(*_sums(z, [(F.col("_part") == c).cast("double") for c in range(k)])).alias("moments"), F.first("mean").alias("mean"),
        F.first("scale").alias("scale"), F.lit(None).cast("double").alias("ll"), F.lit(None).cast("double").alias("was"), F.count(F.lit(1)).alias("n"))
    models = stored(_models(moments, keys, d, k))

    done = []
    for _ in range(iterations):
        e = rows.join(small(models), keys).withColumns(scaled)
        e = e.withColumns({f"_p{c}": p for c, p in enumerate(_densities(z, k))})
        top = F.greatest(*[F.col(f"_p{c}") for c in range(k)]) if k > 1 else F.col("_p0")
        e = e.withColumn("_top", top).withColumns({f"_e{c}": F.exp(F.col(f"_p{c}") - F.col("_top")) for c in range(k)})
        e = e.withColumn("_t", sum((F.col(f"_e{c}") for c in range(1, k)), F.col("_e0")))
        e = e.withColumns({f"_r{c}": F.col(f"_e{c}") / F.col("_t") for c in range(k)})
        moments = e.groupBy(*keys).agg(
            F.array(*_sums(z, [F.col(f"_r{c}") for c in range(k)])).alias("moments"), F.first("mean").alias("mean"),
            F.first("scale").alias("scale"), F.avg(F.col("_top") + F.log("_t")).alias("ll"), F.count(F.lit(1)).alias("n"), F.first("ll").alias("was"))
        step = stored(_models(moments, keys, d, k))
        settled = F.coalesce(F.col("ll") - F.col("was") < tol / d, F.lit(False))
        done.append(step.where(settled))
        models = step.where(~settled)  # the join leaves out the rows of settled groups
        if models.isEmpty():
            break
    for m in done:
        models = models.unionByName(m)
    return models.drop("was")


def decode(rows: DataFrame, models: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int = 3, out: str = "state") -> DataFrame:
    """Likeliest component of each row under the model of its group; ties go to the lower number. Rows of groups without
    a model and rows with a null in a column are left out."""
    cols = list(cols)
    p = F.array(*_densities([F.col(f"_z{i}") for i in range(len(cols))], k))
    d = rows.na.drop(subset=cols).join(small(models.select(*keys, "mean", "scale", "lw", "mu", "li")), list(keys))
    d = d.withColumns({f"_z{i}": c for i, c in enumerate(_scaled(cols))}).withColumn("_p", p)
    return d.withColumn(out, F.array_position("_p", F.array_max("_p")).cast("int") - 1).select(*rows.columns, out)
