"""Forecast evaluation on long predictions.

A prediction row is ``symbol, sample_id, step, component, y_true, y_pred, close_now``; ``close_now`` is the
close at the end of the sample's window. Metrics are per symbol; symbols without rows give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import Layout, over, settle, spread
from .clean import valid_pairs

COMPONENTS = ("open", "high", "low", "close")


def step_metrics(predictions: DataFrame) -> DataFrame:
    """``rows, mse, mae, r2`` per symbol, step and component.

    R2 of a constant actual series is 1 if it is met exactly, else 0; of a single row it is NULL.
    """
    error = "(y_true - y_pred)"
    grouped = (
        valid_pairs(predictions)
        .groupBy("symbol", "step", "component")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.expr(f"avg({error} * {error})").alias("mse"),
            F.expr(f"avg(abs({error}))").alias("mae"),
            F.var_pop("y_true").alias("_var"),
        )
    )
    return grouped.selectExpr(
        "symbol",
        "step",
        "component",
        "rows",
        "mse",
        "mae",
        "case when rows < 2 then null when _var = 0 then case when mse = 0 then 1D else 0D end "
        "else 1 - mse / _var end as r2",
    )


def _first_close(predictions: DataFrame) -> DataFrame:
    return predictions.filter("step = 1 and component = 'close'")


def direction_now(predictions: DataFrame) -> DataFrame:
    """Sign of the first step's close against the present close, actual and predicted."""
    signs = _first_close(predictions).selectExpr(
        "symbol",
        "sample_id",
        "signum(y_true - close_now) as actual",
        "signum(y_pred - close_now) as predicted",
    )
    return valid_pairs(signs, "actual", "predicted")


def direction_diff(predictions: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Sign of the change from the sample before, actual and predicted; the first sample has none."""
    rows = _first_close(predictions).selectExpr(
        "symbol",
        "sample_id",
        "y_true",
        "y_pred",
        "sample_id + 1 as rn",
        # the end of the series is not needed here: a copy sent past it is dropped
        f"sample_id + 1 + {layout.chunk_rows} as n",
    )
    before = {c: over(f"lag({c})") for c in ("sample_id", "y_true", "y_pred")}
    return (
        settle(
            spread(rows, layout, back=1).selectExpr(
                "*", *[f"{sql} as _p_{c}" for c, sql in before.items()]
            )
        )
        .filter("_p_sample_id = sample_id - 1")
        .selectExpr(
            "symbol",
            "sample_id",
            "signum(y_true - _p_y_true) as actual",
            "signum(y_pred - _p_y_pred) as predicted",
        )
    )


def direction_accuracy(directions: DataFrame) -> DataFrame:
    return directions.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr("avg(case when actual = predicted then 1D else 0D end)").alias("accuracy"),
    )


def precision_recall(directions: DataFrame) -> DataFrame:
    """Accuracy, and precision and recall of "up" and of "down" (0 where nothing is counted)."""

    def share(hit: str, base: str) -> str:
        return f"coalesce(try_divide(count_if({hit}), count_if({base})), 0D)"

    up, down = "actual = 1 and predicted = 1", "actual = -1 and predicted = -1"
    return directions.groupBy("symbol").agg(
        F.expr("avg(case when actual = predicted then 1D else 0D end)").alias("accuracy"),
        F.expr(share(up, "predicted = 1")).alias("precision_up"),
        F.expr(share(up, "actual = 1")).alias("recall_up"),
        F.expr(share(down, "predicted = -1")).alias("precision_down"),
        F.expr(share(down, "actual = -1")).alias("recall_down"),
    )


def confusion(directions: DataFrame) -> DataFrame:
    """Rows per actual and predicted direction, with all three classes -1, 0, 1."""
    return directions.groupBy("symbol", "actual", "predicted").agg(
        F.count(F.lit(1)).alias("rows")
    )


def confusion_matrix(directions: DataFrame) -> DataFrame:
    """The same as one row per actual direction and columns ``down, flat, up``."""
    return directions.groupBy("symbol", "actual").agg(
        *[
            F.count_if(F.col("predicted") == value).alias(name)
            for name, value in (("down", -1), ("flat", 0), ("up", 1))
        ]
    )


def confusion_rates(directions: DataFrame) -> DataFrame:
    """False positive and false negative rate among rows where both directions are up or down."""
    both = directions.filter("actual in (-1, 1) and predicted in (-1, 1)")
    return both.groupBy("symbol").agg(
        F.expr(
            "coalesce(try_divide(count_if(actual = -1 and predicted = 1), count_if(actual = -1)), 0D)"
        ).alias("false_positive_rate"),
        F.expr(
            "coalesce(try_divide(count_if(actual = 1 and predicted = -1), count_if(actual = 1)), 0D)"
        ).alias("false_negative_rate"),
    )


def metric_rows(steps: DataFrame, signals: DataFrame, signal_step: str = "Timestep 1") -> DataFrame:
    """All metrics as ``symbol, Timestep, Komponen, Metrik, Nilai`` (the report's column names)."""
    regression = (
        steps.unpivot(["symbol", "step", "component"], ["mse", "r2"], "metric", "value")
    ).selectExpr(
        "symbol",
        "cast(step as string) as Timestep",
        "upper(component) as Komponen",
        "upper(metric) as Metrik",
        "value as Nilai",
    )
    names = [c for c in signals.columns if c not in ("symbol", "rows")]
    direction = signals.unpivot("symbol", names, "metric", "value").selectExpr(
        "symbol", f"'{signal_step}' as Timestep", "'Signal' as Komponen", "metric as Metrik", "value as Nilai"
    )
    return regression.unionByName(direction)


def sample_extract(predictions: DataFrame, samples: int = 100) -> DataFrame:
    """Actual and predicted close of the first samples of each symbol (the data of a comparison plot).

    A row-number limit: Spark keeps only the leading rows of each symbol before the exchange.
    """
    return (
        _first_close(predictions)
        .selectExpr(
            "symbol",
            "sample_id",
            "y_true",
            "y_pred",
            "row_number() over (partition by symbol order by sample_id) as place",
        )
        .filter(f"place <= {samples}")
    )


def forecast_band(forecast: DataFrame) -> DataFrame:
    """Date, close and the low-high band (the data of a forecast plot)."""
    return forecast.select("symbol", "ts", "close", "low", "high")
