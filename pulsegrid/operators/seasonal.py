"""Seasonal forecaster: linear trend and Fourier terms on log values, per series.

A fit needs only sums: of the products of all terms and of the terms with the value.  They
are taken per (series, cell of time) with time counted from the cell's start, and cells are
added after moving them to a common start: a shift in time rotates the sine and cosine of a
frequency and adds a constant to the trend, so the moved sums are exact.  A stored model keeps
one row of sums a series; new rows are summed alone, added, and the series solved again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.expressions import epoch_micros
from pulsegrid.operators.ordered import join_nullsafe, union_all
from pulsegrid.session import materialize

DAY = 86_400.0
DAY_MICROS = 86_400_000_000
# Period in days and number of harmonics.
DAILY = (1.0, 4)
WEEKLY = (7.0, 3)
YEARLY = (365.25, 10)
# Two-sided 80 % normal interval.
INTERVAL_Z = 1.2815515655446004

Seasons = tuple[tuple[float, int], ...]


@dataclass(frozen=True)
class SeasonalModel:
    """``table``: one row per series with ``coef ARRAY<DOUBLE>``, ``sigma``, ``origin`` and ``last_ts``; ``sums``: what it was solved from."""

    table: DataFrame
    keys: tuple[str, ...]
    seasons: Seasons
    multiplicative: bool
    sums: DataFrame
    ridge: float = 1e-6
    yearly_ridge: float = 1e-2


def frequencies(seasons: Seasons) -> np.ndarray:
    """Angle a day of every harmonic."""
    return np.array([2 * math.pi * k / period for period, harmonics in seasons for k in range(1, harmonics + 1)])


def _features(ts: Column, origin: Column, seasons: Seasons) -> list[Column]:
    days = (epoch_micros(ts) / 1e6 - origin) / DAY
    waves = [wave(days * float(w)) for w in frequencies(seasons) for wave in (F.sin, F.cos)]
    return [F.lit(1.0), days / 30, *waves]


def term_values(days: np.ndarray, seasons: Seasons) -> np.ndarray:
    """The terms of ``_features`` at times in days from the origin, one row each."""
    angles = days[:, None] * frequencies(seasons)
    waves = np.stack((np.sin(angles), np.cos(angles)), axis=2).reshape(len(days), -1)
    return np.concatenate((np.ones((len(days), 1)), days[:, None] / 30, waves), axis=1)


def shift(days: np.ndarray, seasons: Seasons) -> np.ndarray:
    """Per entry the matrix that takes terms (and the value) at time t to those at ``t + days``."""
    angles = days[:, None] * frequencies(seasons)
    size = 2 + 2 * angles.shape[1] + 1
    out = np.tile(np.eye(size), (len(days), 1, 1))
    out[:, 1, 0] = days / 30
    at = 2 + 2 * np.arange(angles.shape[1])
    out[:, at, at] = out[:, at + 1, at + 1] = np.cos(angles)
    out[:, at, at + 1], out[:, at + 1, at] = np.sin(angles), -np.sin(angles)
    return out


def _link(value: Column, multiplicative: bool) -> Column:
    return F.log1p(F.greatest(value, F.lit(0.0))) if multiplicative else value


def _unlink(value: Column, multiplicative: bool) -> Column:
    return F.expm1(value) if multiplicative else value


def _key_fields(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keys)


_SUMS = "base long, n long, first_at long, last_at long, products array<double>"


def _row(of: pa.Table, keys: list[str], base: int, n: int, first: int, last: int, products: np.ndarray) -> pa.Table:
    """One row of sums with the keys of ``of``; ``products`` by its upper triangle."""
    values = [pa.array([v], pa.int64()) for v in (base, n, first, last)]
    flat = pa.array([products[np.triu_indices(len(products))]], pa.list_(pa.float64()))
    columns = [of.column(k).slice(0, 1) for k in keys]
    return pa.Table.from_arrays([*columns, *values, flat], names=[*keys, "base", "n", "first_at", "last_at", "products"])


def _square(flat: np.ndarray, size: int) -> np.ndarray:
    """Full symmetric matrices of rows of upper triangles."""
    out = np.zeros((len(flat), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


def _size(seasons: Seasons) -> int:
    return 3 + 2 * sum(h for _, h in seasons)


def cell_sums(series: DataFrame, keys: list[str], multiplicative: bool, seasons: Seasons, cell_micros: int = DAY_MICROS) -> DataFrame:
    """Sums of every (series, cell) of ``(keys, ts, value)``, from the cell's start ``base``; rows without a value are left out.

    ``products`` holds the upper triangle of the sums of products of all terms and the value.  One shuffle
    on (keys, cell); a group is one cell of one series, so choose shorter cells for very dense series.
    """
    at = epoch_micros(F.col("ts"))
    y = _link(F.col("value").cast("double"), multiplicative)
    rows = series.where(F.col("value").isNotNull()).select(*keys, (at - F.pmod(at, F.lit(cell_micros))).alias("base"), at.alias("at"), y.alias("y"))

    def add(group: pa.Table) -> pa.Table:
        micros, base = group.column("at").to_numpy(), group.column("base")[0].as_py()
        x = np.concatenate((term_values((micros - base) / DAY_MICROS, seasons), group.column("y").to_numpy()[:, None]), axis=1)
        return _row(group, keys, base, len(x), int(micros.min()), int(micros.max()), x.T @ x)

    return rows.groupBy(*keys, "base").applyInArrow(add, _key_fields(series, keys) + _SUMS)


def merge_sums(sums: DataFrame, keys: list[str], seasons: Seasons) -> DataFrame:
    """One row of sums a series, moved to its earliest base.  A group is the cells of one series."""
    size = _size(seasons)

    def merge(group: pa.Table) -> pa.Table:
        held = {c: group.column(c).to_numpy() for c in ("base", "n", "first_at", "last_at")}
        base = int(held["base"].min())
        products = _square(group.column("products").combine_chunks().flatten().to_numpy().reshape(len(held["n"]), -1), size)
        moved = shift((held["base"] - base) / DAY_MICROS, seasons)
        total = (moved @ products @ moved.transpose(0, 2, 1)).sum(axis=0)
        return _row(group, keys, base, int(held["n"].sum()), int(held["first_at"].min()), int(held["last_at"].max()), total)

    return sums.groupBy(*keys).applyInArrow(merge, _key_fields(sums, keys) + _SUMS)


def solve_seasonal(
    sums: DataFrame, keys: list[str], seasons: Seasons, multiplicative: bool, ts_type: str = "timestamp_ntz",
    ridge: float = 1e-6, yearly_ridge: float = 1e-2,
) -> SeasonalModel:
    """Solve every series of merged sums; time counts from a series' first row."""
    penalty = np.full(_size(seasons) - 1, ridge)
    if YEARLY in seasons:
        penalty[-2 * YEARLY[1] :] = yearly_ridge

    @F.pandas_udf("coef array<double>, sigma double")
    def solve(products: pd.Series, n: pd.Series, base: pd.Series, first: pd.Series) -> pd.DataFrame:
        moved = shift((base.to_numpy() - first.to_numpy()) / DAY_MICROS, seasons)
        full = moved @ _square(np.stack(products.to_list()), _size(seasons)) @ moved.transpose(0, 2, 1) if len(n) else []
        out = []
        for square, count in zip(full, n):
            gram, moment, yy = square[:-1, :-1], square[:-1, -1], square[-1, -1]
            coef = np.linalg.solve(gram + count * np.diag(penalty), moment)
            sse = max(yy - 2 * coef @ moment + coef @ gram @ coef, 0.0)
            out.append((coef.tolist(), float(np.sqrt(sse / max(count - len(coef), 1)))))
        return pd.DataFrame(out, columns=["coef", "sigma"])

    solved = sums.withColumn("_s", solve("products", "n", "base", "first_at"))
    last = F.timestamp_micros("last_at").cast(ts_type)
    table = solved.select(*keys, "n", (F.col("first_at") / 1e6).alias("origin"), last.alias("last_ts"), "_s.coef", "_s.sigma")
    return SeasonalModel(table, tuple(keys), seasons, multiplicative, sums, ridge, yearly_ridge)


def fit_seasonal(
    series: DataFrame,
    keys: list[str],
    multiplicative: bool = True,
    yearly: bool = True,
    ridge: float = 1e-6,
    yearly_ridge: float = 1e-2,
    cell_micros: int = DAY_MICROS,
) -> SeasonalModel:
    """Fit every series of ``(keys, ts, value)``, each by its own rows only.

    Time counts from a series' first row.  ``yearly_ridge`` keeps the yearly terms of
    series much shorter than a year near zero.  The sums are written to the shared folder.
    """
    seasons = (DAILY, WEEKLY, YEARLY) if yearly else (DAILY, WEEKLY)
    sums = merge_sums(cell_sums(series, keys, multiplicative, seasons, cell_micros), keys, seasons)
    return solve_seasonal(
        materialize(sums, "seasonal-sums"), keys, seasons, multiplicative, dict(series.dtypes)["ts"], ridge, yearly_ridge
    )


def update_seasonal(model: SeasonalModel, series: DataFrame) -> SeasonalModel:
    """The model with the rows of ``(keys, ts, value)`` that come after the last of their series; nothing is fitted again from old rows.

    Series the model does not know are added.  Rows at or before a series' last time are taken as known.
    """
    keys = list(model.keys)
    known = model.table.select(*keys, F.col("last_ts").alias("_last"), F.lit(True).alias("_known"))
    fresh = join_nullsafe(series, known, keys, "left").where(F.col("_known").isNull() | (F.col("ts") > F.col("_last")))
    new = cell_sums(fresh.select(*keys, "ts", "value"), keys, model.multiplicative, model.seasons)
    sums = materialize(merge_sums(union_all([model.sums, new]), keys, model.seasons), "seasonal-sums")
    ts_type = dict(model.table.dtypes)["last_ts"]
    return solve_seasonal(sums, keys, model.seasons, model.multiplicative, ts_type, model.ridge, model.yearly_ridge)


def predict_at(model: SeasonalModel, times: DataFrame) -> DataFrame:
    """Add ``yhat, yhat_lower, yhat_upper`` to rows ``(keys, ts)``."""
    joined = join_nullsafe(times, model.table.drop("n", "last_ts"), list(model.keys))
    return _predict(joined, model).drop("coef", "sigma", "origin")


def _predict(rows: DataFrame, model: SeasonalModel) -> DataFrame:
    terms = F.array(*_features(F.col("ts"), F.col("origin"), model.seasons))
    fit = F.aggregate(F.zip_with("coef", terms, lambda c, x: c * x), F.lit(0.0), lambda a, v: a + v)
    spread = INTERVAL_Z * F.col("sigma")
    with_fit = rows.withColumn("_fit", fit)
    return with_fit.withColumns(
        {
            "yhat": _unlink(F.col("_fit"), model.multiplicative),
            "yhat_lower": _unlink(F.col("_fit") - spread, model.multiplicative),
            "yhat_upper": _unlink(F.col("_fit") + spread, model.multiplicative),
        }
    ).drop("_fit")


def seasonal_forecast(model: SeasonalModel, horizon: int = 1440, step_minutes: int = 1) -> DataFrame:
    """``horizon`` steps after the last row of every series."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_step")
    future = model.table.select(*model.keys, "coef", "sigma", "origin", "last_ts", steps)
    later = F.col("last_ts") + F.make_dt_interval(mins=F.col("_step") * step_minutes)
    rows = future.withColumn("ts", later).drop("last_ts", "_step")
    return _predict(rows, model).drop("coef", "sigma", "origin")
