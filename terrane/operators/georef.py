"""Georeferencing: thin-plate splines through control points, and least-squares polynomials with outliers refitted away."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import polyval

#: Most control points; the system to solve is of this size.
MOST_POINTS = 2000


def _kernel(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, r2 * np.log(np.maximum(r2, 1e-300)), 0.0)


class ThinPlate:
    """A map of the plane that is exact at its control points (rows x, y) and bends least elsewhere."""

    def __init__(self, source: np.ndarray, target: np.ndarray):
        n = len(source)
        self.source, self.shift = source, source.mean(0)
        self.scale = max(1e-12, np.abs(source - self.shift).max())
        p = self._scaled(source)
        a = np.zeros((n + 3, n + 3))
        a[:n, :n] = _kernel(((p[:, None] - p[None]) ** 2).sum(2))
        a[:n, n:] = np.column_stack([np.ones(n), p])
        a[n:, :n] = a[:n, n:].T
        self.weights = np.linalg.solve(a, np.vstack([target, np.zeros((3, target.shape[1]))]))
        self.points = p

    def _scaled(self, xy: np.ndarray) -> np.ndarray:
        return (xy - self.shift) / self.scale

    def __call__(self, xy: np.ndarray) -> np.ndarray:
        p = self._scaled(xy)
        k = _kernel(((p[:, None] - self.points[None]) ** 2).sum(2))
        return k @ self.weights[: len(self.points)] + np.column_stack([np.ones(len(p)), p]) @ self.weights[len(self.points) :]


def fit_plate(control: DataFrame) -> ThinPlate:
    """From control(px, py, lon, lat)."""
    rows = control.orderBy("px", "py").limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} control points")
    a = np.array([[r["px"], r["py"], r["lon"], r["lat"]] for r in rows], float)
    return ThinPlate(a[:, :2], a[:, 2:])


def warp(points: DataFrame, plate: ThinPlate, x: str = "px", y: str = "py") -> DataFrame:
    """Points with lon and lat."""
    shared = points.sparkSession.sparkContext.broadcast(plate)  # of the size of its control points

    @F.pandas_udf("struct<lon:double,lat:double>")
    def run(px: pd.Series, py: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value(np.column_stack([px, py])), columns=["lon", "lat"])

    return points.withColumn("w", run(x, y)).select(*points.columns, "w.lon", "w.lat")


def fit_poly(rows: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Least-squares coefficients, constant first; Spark sums the moments, the driver solves degree + 1 equations."""
    n = degree + 1
    power = lambda k: F.pow(F.col(x), F.lit(float(k)))
    got = rows.agg(*(F.sum(power(k)).alias(f"m{k}") for k in range(2 * n - 1)), *(F.sum(power(k) * F.col(y)).alias(f"r{k}") for k in range(n))).first()
    a = np.array([[got[f"m{i + j}"] for j in range(n)] for i in range(n)], float)
    return np.linalg.solve(a, np.array([got[f"r{k}"] for k in range(n)], float)).tolist()


def fit_without_outliers(rows: DataFrame, x: str, y: str, degree: int, limits: tuple[float, ...] = (6, 3, 2)) -> tuple[list[float], DataFrame]:
    """Fits again and again without rows whose residual exceeds each limit in turn; coefficients and the rows left."""
    kept = rows
    for limit in limits:
        c = fit_poly(kept, x, y, degree)
        kept = rows.where(F.abs(F.col(y) - polyval(x, c)) < limit)
    return fit_poly(kept, x, y, degree), kept


def residuals(rows: DataFrame, x: str, y: str, coefficients: list[float]) -> DataFrame:
    e = F.abs(F.col(y) - polyval(x, coefficients))
    return rows.agg(F.avg(e).alias("mean_residual"), F.max(e).alias("max_residual"), F.count("*").alias("n"))
