"""Direct multi-horizon regression and the recursive forecast.

The forecaster is one linear regression per step and component on the flattened, scaled window, trained over the samples
of all symbols in one pass. Its inputs are scaled per symbol, so one model serves every series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import Layout, chunk_sql, ewm, per_chunk, stage
from . import features as feat
from . import indicators as ind
from . import regression
from .blocks import blocks_of_samples
from .prepare import TARGETS


@dataclass
class Forecaster:
    """``coefficients`` has a row for each input of the flattened window and a column for each output."""

    columns: list[str]
    window: int
    horizon: int
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    intercepts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, samples: DataFrame) -> DataFrame:
        """Add ``y_hat``: scaled predictions, ``horizon * 4`` values, step after step."""
        shared = samples.sparkSession.sparkContext.broadcast((self.coefficients, self.intercepts))

        @F.pandas_udf("array<double>")
        def predict(x: pd.Series) -> pd.Series:
            coefficients, intercepts = shared.value
            return pd.Series(list(np.stack(x.to_numpy()) @ coefficients + intercepts) if len(x) else [])

        return samples.withColumn("y_hat", predict(F.flatten("x")))

    def score_blocks(self, blocks: DataFrame) -> DataFrame:
        """The samples of a store with ``y``, ``y_hat`` and ``close_now``, for ``prediction_rows``."""
        model, close = (self.coefficients, self.intercepts), self.columns.index("close")
        return regression.score_blocks(blocks, model, self.window, self.horizon, len(self.columns), len(TARGETS), close)

    def save(self, path: str) -> None:
        """One row for each output, as Parquet."""
        rows = [(k, float(b), list(map(float, self.coefficients[:, k]))) for k, b in enumerate(self.intercepts)]
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, "output int, intercept double, coefficients array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, columns: Sequence[str], window: int, horizon: int) -> Forecaster:
        rows = SparkSession.getActiveSession().read.parquet(path).orderBy("output").collect()
        if len(rows) != horizon * len(TARGETS) or any(len(r.coefficients) != window * len(columns) for r in rows):
            raise ValueError(f"the model in {path} was fitted for another window, horizon or other columns")
        return cls(list(columns), window, horizon, np.array([r.coefficients for r in rows]).T, np.array([r.intercept for r in rows]))


def fit_blocks(
    blocks: DataFrame, columns: Sequence[str], window: int, horizon: int, regs: Sequence[float] = (0.01,)
) -> list[Forecaster]:
    """A forecaster for each regularisation, all from one pass over the samples of a store (see ``blocks``)."""
    sums = regression.moments(blocks, window, horizon, len(columns), len(TARGETS))
    return [Forecaster(list(columns), window, horizon, *sums.solve(reg)) for reg in regs]


def fit_forecaster(
    train: DataFrame, columns: Sequence[str], window: int, horizon: int, reg: float = 0.01
) -> Forecaster:
    """Fit on samples with ``x`` and ``y`` that are already written out; a store of blocks is the cheaper way."""
    return fit_blocks(blocks_of_samples(train), columns, window, horizon, (reg,))[0]


def best_model(metrics: DataFrame) -> DataFrame:
    """The row of ``model_id, val_mse`` with the lowest loss (then the lowest id)."""
    return metrics.agg(
        F.min_by("model_id", F.struct("val_mse", "model_id")).alias("model_id"),
        F.min("val_mse").alias("val_mse"),
    )


def fit_best(
    train: DataFrame,
    val: DataFrame,
    columns: Sequence[str],
    window: int,
    horizon: int,
    regs: Sequence[float] = (0.0001, 0.01, 1.0),
) -> tuple[Forecaster, DataFrame]:
    """Fit a small grid on the blocks of ``train`` and keep the forecaster with the lowest loss on those of ``val``.

    One pass over each. Without validation samples the losses are NULL and the first regularisation is kept.
    """
    fitted = fit_blocks(train, columns, window, horizon, regs)
    models = [(f.coefficients, f.intercepts) for f in fitted]
    losses = regression.validation_losses(val, models, window, horizon, len(columns), len(TARGETS))
    losses = stage(losses, "losses")
    best = best_model(losses).first()["model_id"]
    return fitted[best or 0], losses


def prediction_rows(scored: DataFrame, close_index: int | None = None) -> DataFrame:
    """Scored samples to long form, still scaled; ``close_index`` is the place of close in ``x`` rows.

    ``close_now`` is on the input scale, ``y_true`` and ``y_pred`` on the target scale. Samples scored in blocks bring it.
    """
    now = "close_now" if "close_now" in scored.columns else f"element_at(x, -1)[{close_index}]"
    pairs = scored.selectExpr(
        "symbol",
        "rn",
        "n",
        "sample_id",
        f"{now} as close_now",
        "posexplode(arrays_zip(y, y_hat)) as (_k, _v)",
    )
    names = ", ".join(f"'{c}'" for c in TARGETS)
    return pairs.selectExpr(
        "symbol",
        "rn",
        "n",
        "sample_id",
        f"cast(_k div {len(TARGETS)} + 1 as int) as step",
        f"array({names})[_k % {len(TARGETS)}] as component",
        "_v.y as y_true",
        "_v.y_hat as y_pred",
        "close_now",
    )


def unscale_predictions(
    predictions: DataFrame, input_params: DataFrame, target_params: DataFrame, layout: Layout = Layout()
) -> DataFrame:
    """Predictions in price units, ready for the evaluation functions."""
    def width(p: str) -> str:
        return f"coalesce(nullif({p}_max - {p}_min, 0D), 1D)"

    def pick(value: str) -> str:
        cases = " ".join(
            f"when '{c}' then {value} * {width(c)} + {c}_min" for c in TARGETS
        )
        return f"case component {cases} end as {value}"

    now = input_params.selectExpr("symbol", "n", "close_min as now_min", "close_max as now_max")
    params = target_params.join(now.drop("n"), "symbol")
    return (
        predictions.selectExpr("*", f"{chunk_sql(layout)} as _chunk")
        .join(per_chunk(params, layout).drop("n"), ["symbol", "_chunk"])
        .selectExpr(
            "symbol",
            "sample_id",
            "step",
            "component",
            pick("y_true"),
            pick("y_pred"),
            f"close_now * {width('now')} + now_min as close_now",
        )
    )


def future_dates(bars: DataFrame, days: int) -> DataFrame:
    """``days`` daily dates per symbol, from the day after its last bar."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    return last.selectExpr(
        "symbol",
        f"posexplode(sequence(last_ts + interval 1 day, last_ts + interval {days} days, "
        "interval 1 day)) as (_k, ts)",
    ).selectExpr("symbol", "cast(_k + 1 as bigint) as day", "ts")


def append_rows(rows: DataFrame, more: DataFrame) -> DataFrame:
    return rows.unionByName(more, allowMissingColumns=True)


def first_days(forecast: DataFrame, days: int) -> DataFrame:
    """Keep the first ``days`` forecast rows of each symbol."""
    return forecast.filter(F.col("day") <= days)


def usable_inputs(tail: DataFrame, columns: Sequence[str], window: int) -> DataFrame:
    """Per symbol whether its input window is complete and free of NULL and infinity."""
    bad = " or ".join(f"`{c}` is null or isnan(`{c}`) or abs(`{c}`) = double('infinity')" for c in columns)
    return tail.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"count(*) = {window} and count_if({bad}) = 0").alias("usable"),
    )


def _extend(tail: DataFrame, smoothing: str, layout: Layout) -> DataFrame:
    """Features of the appended rows (``_new``) of the tail of each symbol.

    Each exponential mean restarts from its stored value at the first row of the tail, which continues
    the series exactly. The tail of a symbol is one short chunk.
    """
    specs = feat.first_scan(smoothing)
    stored = {out: f"_stored_{out}" for out in (*specs, "macd_signal", "adx_14")}
    df = tail.selectExpr(
        *[f"`{c}`" for c in ("symbol", "ts", "rn", "n", "open", "high", "low", "close", "volume", "_new")],
        *[f"`{out}` as {name}" for out, name in stored.items()],
        "0L as _chunk",
    )
    df = feat.rolling_part(df, smoothing)

    def seeded(df: DataFrame, second: dict[str, tuple[str, float]]) -> DataFrame:
        df = df.selectExpr(
            "*",
            *[
                f"case when rn = 1 then coalesce({stored[o]}, {c}) else {c} end as _in_{o}"
                for o, (c, _) in second.items()
            ],
        )
        return ewm(df, {o: (f"_in_{o}", a) for o, (_, a) in second.items()}, layout, carry=False)

    df = seeded(df, specs)
    df, second = feat.between_scans(df, smoothing)
    if smoothing == ind.SIMPLE:
        df = df.drop("_stored_adx_14")
    df = ind.add(seeded(df, second), macd_hist="macd - macd_signal")
    return df.filter("_new").select(*tail.columns)


def forecast(
    bars: DataFrame,
    forecaster: Forecaster,
    input_params: DataFrame,
    target_params: DataFrame,
    days: int,
    smoothing: str = ind.WILDER,
    layout: Layout = Layout(),
) -> DataFrame:
    """Predict ``horizon`` days, append them, extend the features, slide on: ``symbol, ts, day, open..close``.

    All symbols advance together, ceil(days / horizon) rounds. Only a tail of each symbol is kept between
    rounds. The last volume is carried forward, rolling features see enough earlier rows and exponential
    means continue, so every round has a full input window. Symbols without a usable window get no rows
    (see ``usable_inputs``).
    """
    w, h = forecaster.window, forecaster.horizon
    kept = max(w, feat.LOOKBACK) + 1
    if kept + h > layout.chunk_rows:
        raise ValueError("window and horizon must fit into one chunk")
    full = feat.scan_states(bars, smoothing, layout)
    tail = full.filter(F.col("rn") > F.col("n") - kept).withColumn("_new", F.lit(False))
    tail = stage(_rebase(tail), "tail")

    done = None
    for first in range(0, days, h):
        rows = _predict(tail, forecaster, input_params, target_params, first)
        done = rows if done is None else done.unionByName(rows)
        if first + h >= days:
            break
        grown = tail.withColumn("_new", F.lit(False)).unionByName(
            rows.join(tail.filter("rn = n").select("symbol", "volume", "n"), "symbol").selectExpr(
                "symbol", "ts", f"n + day - {first} as rn", "n", "open", "high", "low", "close", "volume",
                "true as _new",
            ),
            allowMissingColumns=True,
        )
        new = _extend(grown, smoothing, layout)
        old = grown.filter("not _new")
        joined = old.unionByName(new).withColumn("n", F.col("n") + h)
        tail = stage(_rebase(joined.filter(F.col("rn") > F.col("n") - kept)), "tail")
    return first_days(done, days)


def _rebase(tail: DataFrame) -> DataFrame:
    """Number the kept rows of each symbol from 1 (a tail is short and has no gaps)."""
    first = tail.groupBy("symbol").agg(F.min("rn").alias("_first"), F.max("rn").alias("_last"))
    rest = [f"`{c}`" for c in tail.columns if c not in ("rn", "n", "_chunk")]
    return tail.join(first, "symbol").selectExpr(
        *rest, "rn - _first + 1 as rn", "_last - _first + 1 as n"
    )


def _predict(
    tail: DataFrame, forecaster: Forecaster, input_params: DataFrame, target_params: DataFrame, first: int
) -> DataFrame:
    """The next ``horizon`` bars of each symbol from the last ``window`` rows of its tail."""
    w, h, columns = forecaster.window, forecaster.horizon, forecaster.columns
    last = tail.filter(F.col("rn") > F.col("n") - w)
    good = usable_inputs(last, columns, w).filter("usable").select("symbol")
    scaled = ", ".join(
        f"(`{c}` - {c}_min) / coalesce(nullif({c}_max - {c}_min, 0D), 1D)" for c in columns
    )
    # a window has at most `window` rows, so gathering it per symbol is bounded
    inputs = (
        last.join(good, "symbol", "left_semi")
        .join(input_params.drop("n"), "symbol")
        .selectExpr("symbol", "ts", "rn", f"array({scaled}) as row")
        .groupBy("symbol")
        .agg(
            F.max("ts").alias("last_ts"),
            F.expr("transform(sort_array(collect_list(struct(rn, row))), r -> r.row) as x"),
        )
    )
    scored = forecaster.score(inputs).join(target_params.drop("n"), "symbol")
    price = {
        c: f"y_hat[_k * {len(TARGETS)} + {i}] * coalesce(nullif({c}_max - {c}_min, 0D), 1D) + {c}_min"
        for i, c in enumerate(TARGETS)
    }
    return (
        scored.selectExpr("*", f"explode(sequence(0, {h - 1})) as _k")
        .selectExpr(
            "symbol",
            "last_ts + make_interval(0, 0, 0, _k + 1) as ts",
            f"cast(_k + 1 + {first} as bigint) as day",
            *[f"{sql} as {c}" for c, sql in price.items()],
        )
    )
