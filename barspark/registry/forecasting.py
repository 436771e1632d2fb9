"""Fitting, scoring, recursive forecasts and report sinks."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import indicators as ind
from ..operators import prepare as pr
from ..operators.blocks import of_split
from ..operators.study import Study, StudyConfig, run_study, scaled_blocks, scaled_samples
from ..plans import Layout, number_rows, numbered_once, stage, stage_path
from ..sources import sinks
from ..sources.bars import to_bars
from .base import HOURLY, bars_sql, hourly, query, rounded, show, stamp, ticks
from .evaluation import METRIC_KEYS, METRIC_ROWS_SQL, metric_sql, metrics

WINDOW, HORIZON, DAYS = 4, 2, 5
INPUTS = ("open", "high", "low", "close", "return", "sma_ratio_20", "rsi_14", "atr_14")
PRICES = list(pr.TARGETS)


def _study(spark, sf, smoothing: str = ind.WILDER, regs: tuple[float, ...] = (0.01,)) -> Study:
    config = StudyConfig(smoothing, WINDOW, HORIZON, columns=INPUTS, regs=regs, layout=Layout("H4"))
    return run_study(to_bars(ticks(spark, sf), "H4"), config)


@query("fit_and_score")
def fit_and_score(spark, sf):
    """Held-out predictions in price units."""
    keys = ["symbol", "sample_id", "step", "component"]
    return show(_study(spark, sf).predictions(), keys, ["y_true", "y_pred", "close_now"], 4)


@query("fit_best")
def fit_best(spark, sf):
    """Validation loss per candidate."""
    return _study(spark, sf, regs=(0.01, 1.0)).losses


@query("study_metrics_wilder")
def metrics_wilder(spark, sf):
    return show(_study(spark, sf).metrics(), METRIC_KEYS, ["Nilai"], 4)


@query("study_metrics_simple")
def metrics_simple(spark, sf):
    return show(_study(spark, sf, ind.SIMPLE).metrics(), METRIC_KEYS, ["Nilai"], 4)


@query("recursive_forecast")
def recursive_forecast(spark, sf):
    return show(_study(spark, sf).forecast(DAYS), ["symbol", "ts", "day"], PRICES, 4)


def _wide_study(spark, sf, smoothing: str) -> Study:
    """All inputs, window and horizon of the dialect's own size."""
    inputs = {} if smoothing == ind.WILDER else {"window": 90, "horizon": 15}
    config = StudyConfig(smoothing, layout=HOURLY, regs=(0.01, 1.0), **inputs)
    return run_study(hourly(spark, sf), config)


@query("fit_wide")
def fit_wide(spark, sf):
    """Held-out predictions of 15 steps from windows of 90 bars with all 35 columns."""
    keys = ["symbol", "sample_id", "step", "component"]
    return show(_wide_study(spark, sf, ind.WILDER).predictions(), keys, ["y_true", "y_pred", "close_now"], 4)


@query("fit_wide_simple")
def fit_wide_simple(spark, sf):
    """Test metrics of 15 steps from windows of 90 bars with the 26 model columns."""
    return show(_wide_study(spark, sf, ind.SIMPLE).metrics(), METRIC_KEYS, ["Nilai"], 4)


# --- a model small enough for SQL to solve: the last two closes, two steps ahead -----------------

SMALL, AHEAD, SMALL_REGS = 2, 2, (0.0001, 0.01, 1.0)
_SMALL_N = f"(n - {SMALL} - {AHEAD} + 1)"
_SMALL_TRAIN = f"cast(floor({_SMALL_N} * 0.7::double) as bigint)"


def _small_range(name: str, rows: str) -> str:
    parts = ", ".join(f"min({c}) as {c}_min, coalesce(nullif(max({c}) - min({c}), 0), 1) as {c}_width" for c in PRICES)
    return f"{name} as (select symbol, {parts} from bars where {_SMALL_N} > 0 and {rows} group by symbol)"


def _of(component: str, template: str) -> str:
    return f"case {component} " + " ".join(f"when '{c}' then {template.format(c=c)}" for c in PRICES) + " end"


_SMALL_CTES = (
    _small_range("inputs", f"rn <= {_SMALL_TRAIN} + {SMALL}"),
    _small_range("targets", f"rn > {SMALL} and rn <= {_SMALL_TRAIN} + {SMALL} + {AHEAD}"),
    f"""small as (select a.symbol, a.rn - {SMALL} as sample_id, {_SMALL_N.replace('n -', 'a.n -')} as samples, step::int as step,
    component, a.close as close_now, (p.close - i.close_min) / i.close_width as x0, (a.close - i.close_min) / i.close_width as x1,
    {_of('component', 'b.{c}')} as price, {_of('component', 't.{c}_min')} as low, {_of('component', 't.{c}_width')} as width
  from bars a join bars p on p.symbol = a.symbol and p.rn = a.rn - 1 join inputs i on i.symbol = a.symbol
    join targets t on t.symbol = a.symbol, range(1, {AHEAD + 1}) s(step), (values ('open'), ('high'), ('low'), ('close')) c(component),
    bars b where b.symbol = a.symbol and b.rn = a.rn + step and a.rn >= {SMALL} and a.rn + {AHEAD} <= a.n)""",
    f"""sums as (select model_id, step, component, avg(x0) as m0, avg(x1) as m1, avg((price - low) / width) as my,
    var_pop(x0) + reg / stddev_pop((price - low) / width) as a, covar_pop(x0, x1) as c,
    var_pop(x1) + reg / stddev_pop((price - low) / width) as d,
    covar_pop(x0, (price - low) / width) as e, covar_pop(x1, (price - low) / width) as f
  from small, (values {', '.join(f'({k}, {r}::double)' for k, r in enumerate(SMALL_REGS))}) r(model_id, reg)
  where sample_id < floor(samples * 0.7::double) group by 1, 2, 3, reg)""",
    """solved as (select model_id, step, component, (e * d - c * f) / (a * d - c * c) as b0, (a * f - c * e) / (a * d - c * c) as b1,
    my - (e * d - c * f) / (a * d - c * c) * m0 - (a * f - c * e) / (a * d - c * c) * m1 as b from sums)""",
    """losses as (select model_id, avg((b + b0 * x0 + b1 * x1 - (price - low) / width) ** 2) as val_mse
  from small join solved using (step, component) where sample_id >= floor(samples * 0.7::double)
    and sample_id < floor(samples * 0.7::double) + floor(samples * 0.15::double) group by 1)""",
    """best as (select solved.* from solved where model_id = (select arg_min(model_id, (val_mse, model_id)) from losses))""",
)


def _small_parts(spark, sf):
    rows = numbered_once(hourly(spark, sf), HOURLY)
    inputs = stage(pr.fit_minmax_train(rows, PRICES, SMALL, AHEAD), "input-range")
    outputs = stage(pr.fit_minmax_train(rows, PRICES, SMALL, AHEAD, of="targets"), "target-range")
    blocks = stage(scaled_blocks(rows, inputs, outputs, ["close"], SMALL, AHEAD, HOURLY), "blocks")
    return rows, inputs, outputs, blocks


def _small_best(blocks):
    train, val = (of_split(blocks, split) for split in ("train", "val"))
    return fc.fit_best(train, val, ["close"], SMALL, AHEAD, SMALL_REGS)


@query(
    "fit_small",
    bars_sql(
        f"select model_id, step, component, {rounded('b', 'b0', 'b1')} from solved", *_SMALL_CTES
    ),
)
def fit_small(spark, sf):
    """The coefficients of every regularisation."""
    blocks = _small_parts(spark, sf)[3]
    fitted = fc.fit_blocks(of_split(blocks, "train"), ["close"], SMALL, AHEAD, SMALL_REGS)
    rows = [
        (m, k // len(PRICES) + 1, PRICES[k % len(PRICES)], float(f.intercepts[k]), *map(float, f.coefficients[:, k]))
        for m, f in enumerate(fitted)
        for k in range(AHEAD * len(PRICES))
    ]
    found = spark.createDataFrame(rows, "model_id int, step int, component string, b double, b0 double, b1 double")
    return show(found, ["model_id", "step", "component"], ["b", "b0", "b1"])


@query("fit_small_losses", bars_sql(f"select model_id, {rounded('val_mse')} from losses", *_SMALL_CTES))
def fit_small_losses(spark, sf):
    """Validation loss per regularisation."""
    return show(_small_best(_small_parts(spark, sf)[3])[1], ["model_id"], ["val_mse"])


@query(
    "fit_small_score",
    bars_sql(
        f"""select symbol, sample_id, step, component, {rounded('y_true', 'y_pred', 'close_now', digits=4)} from (
  select symbol, sample_id, step, component, price as y_true, (b + b0 * x0 + b1 * x1) * width + low as y_pred, close_now
  from small join best using (step, component)
  where sample_id >= floor(samples * 0.7::double) + floor(samples * 0.15::double))""",
        *_SMALL_CTES,
    ),
)
def fit_small_score(spark, sf):
    """Held-out predictions in price units, by the model of the lowest loss."""
    _, inputs, outputs, blocks = _small_parts(spark, sf)
    scored = _small_best(blocks)[0].score_blocks(of_split(blocks, "test"))
    predictions = fc.unscale_predictions(fc.prediction_rows(scored), inputs, outputs, HOURLY)
    return show(predictions, ["symbol", "sample_id", "step", "component"], ["y_true", "y_pred", "close_now"], 4)


def _next_close(step: int) -> str:
    return (
        f"(select b + b0 * ((r.before - i.close_min) / i.close_width) + b1 * ((r.last - i.close_min) / i.close_width)"
        f" from best where step = {step} and component = 'close') * t.close_width + t.close_min"
    )


@query(
    "fit_small_forecast",
    bars_sql(
        f"""select symbol, strftime(ts + to_days(day::int), '%Y-%m-%d %H:%M:%S') as ts, day, {rounded(*PRICES, digits=4)} from (
  select r.symbol, r.ts, round * {AHEAD} + step as day, {', '.join(
      f"max((b + b0 * ((r.before - i.close_min) / i.close_width) + b1 * ((r.last - i.close_min) / i.close_width))"
      f" * t.{c}_width + t.{c}_min) filter (component = '{c}') as {c}" for c in PRICES)}
  from rounds r join inputs i on i.symbol = r.symbol join targets t on t.symbol = r.symbol, best group by 1, 2, 3) where day <= {DAYS}""",
        *_SMALL_CTES,
        f"""rounds as (
  select a.symbol, 0 as round, a.ts, a.close as last, b.close as before
  from bars a join bars b on b.symbol = a.symbol and b.rn = a.n - 1 where a.rn = a.n
  union all select r.symbol, r.round + 1, r.ts, {_next_close(2)}, {_next_close(1)}
  from rounds r join inputs i on i.symbol = r.symbol join targets t on t.symbol = r.symbol where r.round < 2)""",
    ),
)
def fit_small_forecast(spark, sf):
    """The recursive forecast by the model of the lowest loss."""
    rows, inputs, outputs, blocks = _small_parts(spark, sf)
    bars = rows.select("symbol", "ts", *PRICES, "volume")
    found = fc.forecast(bars, _small_best(blocks)[0], inputs, outputs, DAYS, layout=HOURLY)
    return show(found, ["symbol", "ts", "day"], PRICES, 4)


#: Coefficients with enough digits that no rounded result is a tie.
LAST, BEFORE, STEP = 0.731043, 0.268957, 0.013717


class Drift(fc.Forecaster):
    """A forecaster with given coefficients, so that SQL can follow each of its steps: the last row of the window, the
    row before it, and a share of the range for each step ahead."""

    def score(self, samples):
        last, before = "element_at(x, -1)", "element_at(x, -2)"
        cells = [
            f"{LAST}D * {last}[{i}] + {BEFORE}D * {before}[{i}] + {k} * {STEP}D"
            for k in range(1, self.horizon + 1)
            for i in range(len(PRICES))
        ]
        return samples.withColumn("y_hat", F.expr(f"array({', '.join(cells)})"))


def _range_sql(name: str, rows: str) -> str:
    parts = ", ".join(f"min({c}) as {c}_min, coalesce(nullif(max({c}) - min({c}), 0), 1) as {c}_width" for c in PRICES)
    return f"{name} as (select symbol, {parts} from bars where {rows} group by symbol)"


_SAMPLES = f"(n - {WINDOW} - {HORIZON} + 1)"
_TRAIN = f"cast(floor({_SAMPLES} * 0.7::double) as bigint)"
_RANGES = (
    _range_sql("inputs", f"{_SAMPLES} > 0 and rn <= {_TRAIN} + {WINDOW}"),
    _range_sql("targets", f"{_SAMPLES} > 0 and rn > {WINDOW} and rn <= {_TRAIN} + {WINDOW} + {HORIZON}"),
)


def _case(column: str, values: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


def _drift_parts(spark, sf):
    rows = number_rows(hourly(spark, sf), HOURLY)
    inputs = pr.fit_minmax_train(rows, PRICES, WINDOW, HORIZON)
    outputs = pr.fit_minmax_train(rows, PRICES, WINDOW, HORIZON, of="targets")
    return rows, inputs, outputs, Drift(PRICES, WINDOW, HORIZON)


_DRIFT_PRED = {
    c: f"({LAST} * (a.{c} - i.{c}_min) / i.{c}_width + {BEFORE} * (p.{c} - i.{c}_min) / i.{c}_width + {STEP} * step)"
    f" * t.{c}_width + t.{c}_min"
    for c in PRICES
}


@query(
    "fixed_score",
    bars_sql(
        f"""select symbol, sample_id, step, component, {rounded('y_true', 'y_pred', 'close_now', digits=4)} from (
  select a.symbol, a.rn - {WINDOW} as sample_id, step::int as step, component,
    {_case('component', {c: f'b.{c}' for c in PRICES})} as y_true, {_case('component', _DRIFT_PRED)} as y_pred,
    a.close as close_now
  from bars a join bars p on p.symbol = a.symbol and p.rn = a.rn - 1 join inputs i on i.symbol = a.symbol
    join targets t on t.symbol = a.symbol, range(1, {HORIZON + 1}) s(step), (values ('open'), ('high'), ('low'), ('close')) c(component),
    bars b where b.symbol = a.symbol and b.rn = a.rn + step and a.rn >= {WINDOW} and a.rn + {HORIZON} <= a.n
    and a.rn - {WINDOW} >= cast(floor((a.n - {WINDOW} - {HORIZON} + 1) * 0.7::double) as bigint)
      + cast(floor((a.n - {WINDOW} - {HORIZON} + 1) * 0.15::double) as bigint))""",
        *_RANGES,
    ),
)
def fixed_score(spark, sf):
    """Held-out predictions in price units, by fixed coefficients."""
    rows, inputs, outputs, model = _drift_parts(spark, sf)
    samples = pr.split_by_fraction(scaled_samples(rows, inputs, outputs, PRICES, WINDOW, HORIZON, HOURLY))
    scored = model.score(samples.filter("split = 'test'"))
    predictions = fc.unscale_predictions(fc.prediction_rows(scored, PRICES.index("close")), inputs, outputs, HOURLY)
    return show(predictions, ["symbol", "sample_id", "step", "component"], ["y_true", "y_pred", "close_now"], 4)


def _drift_step(k: int) -> str:
    """The next row of every price, ``k`` steps ahead of the window's last two rows."""
    return ", ".join(
        f"({LAST} * (a_{c} - i.{c}_min) / i.{c}_width + {BEFORE} * (b_{c} - i.{c}_min) / i.{c}_width + {k} * {STEP})"
        f" * t.{c}_width + t.{c}_min as p{k}_{c}"
        for c in PRICES
    )


_ROUNDS = f"""rounds as (
  select a.symbol, 0 as round, a.ts, {', '.join(f'a.{c} as a_{c}, b.{c} as b_{c}' for c in PRICES)}
  from bars a join bars b on b.symbol = a.symbol and b.rn = a.n - 1 where a.rn = a.n
  union all
  select symbol, round + 1, ts, {', '.join(f'p2_{c}, p1_{c}' for c in PRICES)} from (
    select r.*, {_drift_step(1)}, {_drift_step(2)}
    from rounds r join inputs i on i.symbol = r.symbol join targets t on t.symbol = r.symbol where round < 3))"""


@query(
    "fixed_forecast",
    bars_sql(
        f"""select symbol, strftime(ts + to_days(day::int), '%Y-%m-%d %H:%M:%S') as ts, day, {rounded(*PRICES, digits=4)} from (
  select symbol, ts, round * 2 as day, {', '.join(f'a_{c} as {c}' for c in PRICES)} from rounds where round > 0
  union all select symbol, ts, round * 2 - 1, {', '.join(f'b_{c}' for c in PRICES)} from rounds where round > 0) where day <= {DAYS}""",
        *_RANGES,
        _ROUNDS,
    ),
)
def fixed_forecast(spark, sf):
    """The recursive forecast by fixed coefficients."""
    rows, inputs, outputs, model = _drift_parts(spark, sf)
    bars = rows.select("symbol", "ts", *PRICES, "volume")
    found = fc.forecast(bars, model, inputs, outputs, DAYS, layout=HOURLY)
    return show(found, ["symbol", "ts", "day"], PRICES, 4)


@query(
    "best_model",
    bars_sql(
        """select arg_min(model_id, (val_mse, model_id)) as model_id, round(min(val_mse), 4) + 0.0 as val_mse from (
  select k as model_id, avg(e) as val_mse from (
    select k, case when rn >= k then (close - avg(close) over (partition by symbol, k order by ts
      rows between k - 1 preceding and current row)) ** 2 end as e
    from bars, (values (5), (10), (20), (50)) m(k))
  group by 1)"""
    ),
)
def lowest_loss(spark, sf):
    """Moving averages as stand-in models: the one nearest to the close."""
    rows = ind.with_sma(hourly(spark, sf), ratio=False, layout=HOURLY)
    errors = rows.select(*[((F.col("close") - F.col(f"sma_{k}")) ** 2).alias(str(k)) for k in ind.MEAN_SPANS])
    losses = errors.agg(*[F.avg(str(k)).alias(str(k)) for k in ind.MEAN_SPANS])
    losses = losses.unpivot([], [str(k) for k in ind.MEAN_SPANS], "model_id", "val_mse")
    best = fc.best_model(losses.withColumn("model_id", F.col("model_id").cast("int")))
    return show(best, ["model_id"], ["val_mse"], 4)


@query(
    "future_dates",
    bars_sql(
        f"""select symbol, day, strftime(last + to_days(day::int), '%Y-%m-%d %H:%M:%S') as ts
from (select symbol, max(ts) as last from bars group by 1), range(1, {30 + 1}) d(day)"""
    ),
)
def dates(spark, sf):
    return show(fc.future_dates(hourly(spark, sf), 30), ["symbol", "day", "ts"])


_AHEAD = f"""ahead as (select symbol, day, last + to_days(day::int) as ts
  from (select symbol, max(ts) as last from bars group by 1), range(1, {30 + 1}) d(day))"""


@query(
    "append_rows",
    bars_sql(
        f"select symbol, {stamp()}, {rounded('close')} from (select symbol, ts, close from bars union all select symbol, ts, null from ahead)",
        _AHEAD,
    ),
)
def appended(spark, sf):
    bars = hourly(spark, sf)
    return show(fc.append_rows(bars, fc.future_dates(bars, 30).drop("day")), numbers=["close"])


@query("first_days", bars_sql(f"select symbol, day, {stamp()} from ahead where day <= 7", _AHEAD))
def truncated(spark, sf):
    return show(fc.first_days(fc.future_dates(hourly(spark, sf), 30), 7), ["symbol", "day", "ts"])


@query(
    "usable_inputs",
    bars_sql(
        """select symbol, count(*) as rows, count(*) = 60 and count(*) filter (x is null or isinf(x)) = 0 as usable
from (select symbol, rn, n, case when symbol = 'view' and rn = n then null when symbol = 'error' and rn = n - 3
  then 'Infinity'::double else close end as x from bars) where rn > n - 60 group by 1"""
    ),
)
def usable(spark, sf):
    rows = number_rows(hourly(spark, sf), HOURLY)
    rows = ind.add(
        rows,
        x="case when symbol = 'view' and rn = n then null when symbol = 'error' and rn = n - 3 "
        "then double('Infinity') else close end",
    )
    return fc.usable_inputs(pr.tail_window(rows, 60), ["x"], 60)


@query("write_metrics", METRIC_ROWS_SQL)
def metrics_file(spark, sf):
    path = stage_path(spark, "metrics-csv")
    sinks.write_metrics(metrics(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in METRIC_KEYS) + ", Nilai double"
    return show(spark.read.schema(schema).option("header", True).csv(path), METRIC_KEYS, ["Nilai"], 4)


_SUMMARY_CONFIG = {"sequence": {"window_size": WINDOW, "horizon": HORIZON}}
_SUMMARY_SQL = metric_sql(
    f"""select symbol, unnest([{', '.join(repr(x) for x in (
        '===== RINGKASAN MODEL =====', 'Tanggal pelatihan: 2025-01-01 00:00:00', 'Dataset: events',
        'Konfigurasi Pelatihan:', *json.dumps(_SUMMARY_CONFIG, indent=2).splitlines(), 'Hasil Evaluasi:',
        '===== AKHIR RINGKASAN =====',
    ))}, 'Jumlah data setelah pembersihan: ' || count(*)]) as value from bars group by symbol
union all select symbol, printf('Timestep %d %s: MSE=%.6f, R2=%.6f', step, upper(component), mse, r2) from steps
union all select symbol, printf('%s: %.4f', m.name, case m.name when 'accuracy' then accuracy
    when 'precision_up' then precision_up when 'recall_up' then recall_up when 'precision_down' then precision_down
    else recall_down end)
  from signals, (values ('accuracy'), ('precision_up'), ('recall_up'), ('precision_down'), ('recall_down')) m(name)"""
)


@query("write_summary", _SUMMARY_SQL)
def summary_file(spark, sf):
    path = stage_path(spark, "summary")
    counts = hourly(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    config = _SUMMARY_CONFIG
    lines = sinks.summary_rows(metrics(spark, sf), counts, config, "events", datetime(2025, 1, 1))
    sinks.write_summary(lines, path)
    return spark.read.text(path).select("symbol", "value")


@query(
    "write_forecast",
    bars_sql(f"select symbol, {stamp()}, {rounded(*PRICES)} from bars"),
)
def forecast_file(spark, sf):
    path = stage_path(spark, "forecast")
    sinks.write_forecast(hourly(spark, sf), path, "parquet")
    return show(spark.read.parquet(path).withColumnRenamed("date", "ts"), numbers=PRICES)
