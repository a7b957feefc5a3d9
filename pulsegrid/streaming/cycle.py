"""The prediction cycle as the body of a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.seasonal import SeasonalModel, solve_seasonal
from pulsegrid.plans.jobs import aligned_frame
from pulsegrid.plans.training import Models, run_cycle
from pulsegrid.session import held
from pulsegrid.sources.points import duration, in_range


def _latest(model: SeasonalModel, sums_path: str, before: int) -> SeasonalModel:
    """The model of the newest batch before this one; ``model`` itself if none has stored any."""
    stored = model.sums.sparkSession.read.schema(f"{_ddl(model.sums)}, batch int").parquet(sums_path).where(F.col("batch") < before)
    newest = stored.agg(F.max("batch")).first()[0]
    if newest is None:
        return model
    sums = stored.where(F.col("batch") == newest).drop("batch")
    ts_type = dict(model.table.dtypes)["last_ts"]
    return solve_seasonal(sums, list(model.keys), model.seasons, model.multiplicative, ts_type, model.ridge, model.yearly_ridge)


def _time(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def step_start(at: datetime, step: str) -> datetime:
    """Start of the step a time lies in."""
    number, unit = duration(step).split()
    length = timedelta(**{unit.rstrip("s") + "s": int(number)})
    return at - (at - datetime(1970, 1, 1)) % length


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def cycle_writer(
    models: Models,
    fields: list[str],
    points_path: str,
    results_path: str,
    alerts_path: str,
    history: str = "60 minutes",
    step: str = "1 minute",
    rules: DataFrame | None = None,
    smart: DataFrame | None = None,
    smart_features: list[str] | None = None,
    forecasts_path: str | None = None,
    horizon: int = 1440,
    step_minutes: int = 1,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body: store the batch by day, read the recent days, predict, store results.

    The newest time of every batch is kept beside the points, so history is not read for it.

    With a seasonal model and ``forecasts_path``, every cycle adds the steps that ended since the cycle before
    to the model's stored sums and forecasts from them.  A step is added once: points that come later than
    the cycle after its end no longer change it.

    Every write goes to a folder of its batch and replaces it, so a batch that is
    repeated after a failure leaves the same rows once.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        plain = batch.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "day": F.to_date("ts")})
        plain.write.mode("overwrite").partitionBy("day").parquet(f"{points_path}/batch={batch_id}")
        stored = spark.read.parquet(f"{points_path}/batch={batch_id}")
        marks = f"{points_path}-marks"
        stored.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        seen = spark.read.parquet(marks).where(F.col("batch") <= batch_id)  # one row per batch
        newest, before = seen.agg(F.max("newest"), F.max(F.when(F.col("batch") < batch_id, F.col("newest")))).first()

        def between(since: Column | None, until: Column | None) -> DataFrame:
            kept = spark.read.parquet(points_path).where(F.col("batch") <= batch_id)
            days = kept if since is None else kept.where(F.col("day") >= F.to_date(since))
            return aligned_frame(in_range(days, since, until), fields, step)

        current, steps = models, None
        seasonal = models.seasonal is not None and forecasts_path is not None
        if seasonal:
            sums_path = f"{forecasts_path}-sums"
            current = replace(models, seasonal=_latest(models.seasonal, sums_path, batch_id)) if before is not None else models
            # from the start of the step that was open when the cycle before ran, to that of the one open now
            steps = between(None if before is None else _time(step_start(before, step)), _time(step_start(newest, step)))
        else:
            current = replace(models, seasonal=None)
        with held(between(_time(newest) - F.expr(f"INTERVAL {history}"), None), "cycle-grid") as grid:
            found = run_cycle(grid, current, smart, rules, smart_features, horizon, step_minutes, steps)
            found.points.write.mode("overwrite").parquet(f"{results_path}/batch={batch_id}")
            found.alerts.write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")
            if seasonal:
                found.seasonal.sums.write.mode("overwrite").parquet(f"{sums_path}/batch={batch_id}")
                found.forecasts.write.mode("overwrite").parquet(f"{forecasts_path}/batch={batch_id}")

    return cycle
