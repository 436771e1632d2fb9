"""Metrics on a simple prediction: each component moves on by the last candle's body."""

from __future__ import annotations

from ..operators import evaluate as ev
from ..operators.indicators import add
from ..plans import numbered_once, over, settle, spread
from .base import HOURLY, bars_sql, hourly, query, rounded, show

HORIZON = 3


def predictions(spark, sf):
    bars = numbered_once(hourly(spark, sf), HOURLY)
    rows = spread(bars, HOURLY, ahead=HORIZON)
    cells = ", ".join(
        f"named_struct('step', {k}, 'component', '{c}', 'y_true', {over(f'lead({c}, {k})')}, 'y_pred', {c} + close - open)"
        for k in range(1, HORIZON + 1)
        for c in ev.COMPONENTS
    )
    cells = settle(rows.selectExpr("symbol", "rn", "n", "close", "_home", f"array({cells}) as _cells"))
    return (
        cells.filter(f"rn + {HORIZON} <= n")
        .selectExpr("symbol", "rn - 1 as sample_id", "close as close_now", "explode(_cells) as _c")
        .selectExpr("symbol", "sample_id", "_c.*", "close_now")
    )


_PREDICTIONS = """predictions as (
  select a.symbol, a.rn - 1 as sample_id, (b.rn - a.rn)::int as step, c.component,
    case c.component when 'open' then b.open when 'high' then b.high when 'low' then b.low else b.close end as y_true,
    case c.component when 'open' then a.open when 'high' then a.high when 'low' then a.low else a.close end
      + a.close - a.open as y_pred, a.close as close_now
  from bars a join bars b on b.symbol = a.symbol and b.rn between a.rn + 1 and a.rn + 3,
    (values ('open'), ('high'), ('low'), ('close')) c(component)
  where a.rn + 3 <= a.n)"""

_STEPS = """steps as (
  select symbol, step, component, count(*) as rows, avg((y_true - y_pred) * (y_true - y_pred)) as mse,
    avg(abs(y_true - y_pred)) as mae, 1 - sum((y_true - y_pred) * (y_true - y_pred))
      / sum((y_true - m) * (y_true - m)) as r2
  from (select *, avg(y_true) over (partition by symbol, step, component) as m from predictions)
  group by 1, 2, 3)"""

_NOW = """now as (select symbol, sample_id, sign(y_true - close_now)::double as actual,
  sign(y_pred - close_now)::double as predicted from predictions where step = 1 and component = 'close')"""
_DIFF = """diff as (select symbol, sample_id, sign(y_true - lag(y_true) over w)::double as actual,
  sign(y_pred - lag(y_pred) over w)::double as predicted from predictions where step = 1 and component = 'close'
  window w as (partition by symbol order by sample_id) qualify lag(y_true) over w is not null)"""


def _sql(select: str, *ctes: str) -> str:
    return bars_sql(select, _PREDICTIONS, *ctes)


@query("mse", _sql(f"select symbol, step, component, rows, {rounded('mse', digits=4)} from steps", _STEPS))
def mse(spark, sf):
    return show(ev.step_metrics(predictions(spark, sf)), ["symbol", "step", "component", "rows"], ["mse"], 4)


@query("r2", _sql(f"select symbol, step, component, {rounded('r2', digits=4)} from steps", _STEPS))
def r2(spark, sf):
    return show(ev.step_metrics(predictions(spark, sf)), ["symbol", "step", "component"], ["r2"], 4)


@query("mae", _sql(f"select symbol, step, component, {rounded('mae', digits=4)} from steps", _STEPS))
def mae(spark, sf):
    return show(ev.step_metrics(predictions(spark, sf)), ["symbol", "step", "component"], ["mae"], 4)


@query("direction_now", _sql("select * from now", _NOW))
def now(spark, sf):
    return ev.direction_now(predictions(spark, sf))


@query("direction_diff", _sql("select * from diff", _DIFF))
def diff(spark, sf):
    return ev.direction_diff(predictions(spark, sf), HOURLY)


@query(
    "direction_accuracy",
    _sql(
        "select symbol, count(*) as rows, round(avg((actual = predicted)::int), 6) + 0.0 as accuracy from now group by 1",
        _NOW,
    ),
)
def accuracy(spark, sf):
    return show(
        ev.direction_accuracy(ev.direction_now(predictions(spark, sf))), ["symbol", "rows"], ["accuracy"]
    )


_SIGNALS = """signals as (
  select symbol, avg((actual = predicted)::int) as accuracy,
    coalesce(count(*) filter (actual = 1 and predicted = 1) / nullif(count(*) filter (predicted = 1), 0), 0) as precision_up,
    coalesce(count(*) filter (actual = 1 and predicted = 1) / nullif(count(*) filter (actual = 1), 0), 0) as recall_up,
    coalesce(count(*) filter (actual = -1 and predicted = -1) / nullif(count(*) filter (predicted = -1), 0), 0) as precision_down,
    coalesce(count(*) filter (actual = -1 and predicted = -1) / nullif(count(*) filter (actual = -1), 0), 0) as recall_down
  from now group by 1)"""
_SIGNAL_NAMES = ["accuracy", "precision_up", "recall_up", "precision_down", "recall_down"]


@query("precision_recall", _sql(f"select symbol, {rounded(*_SIGNAL_NAMES)} from signals", _NOW, _SIGNALS))
def precision_recall(spark, sf):
    return show(
        ev.precision_recall(ev.direction_now(predictions(spark, sf))), ["symbol"], _SIGNAL_NAMES
    )


@query(
    "confusion",
    _sql("select symbol, actual, predicted, count(*) as rows from diff group by all", _DIFF),
)
def confusion(spark, sf):
    return ev.confusion(ev.direction_diff(predictions(spark, sf), HOURLY))


@query(
    "confusion_matrix",
    _sql(
        """select symbol, actual, count(*) filter (predicted = -1) as down, count(*) filter (predicted = 0) as flat,
  count(*) filter (predicted = 1) as up from diff group by 1, 2""",
        _DIFF,
    ),
)
def matrix(spark, sf):
    return ev.confusion_matrix(ev.direction_diff(predictions(spark, sf), HOURLY))


@query(
    "confusion_rates",
    _sql(
        """select symbol, round(coalesce(count(*) filter (actual = -1 and predicted = 1)
    / nullif(count(*) filter (actual = -1), 0), 0), 6) + 0.0 as false_positive_rate,
  round(coalesce(count(*) filter (actual = 1 and predicted = -1)
    / nullif(count(*) filter (actual = 1), 0), 0), 6) + 0.0 as false_negative_rate
from diff where actual <> 0 and predicted <> 0 group by 1""",
        _DIFF,
    ),
)
def rates(spark, sf):
    return show(
        ev.confusion_rates(ev.direction_diff(predictions(spark, sf), HOURLY)),
        ["symbol"],
        ["false_positive_rate", "false_negative_rate"],
    )


def metric_sql(select: str) -> str:
    """SQL over the bars, step metrics and signals."""
    return _sql(select, _STEPS, _NOW, _SIGNALS)


METRIC_ROWS_SQL = _sql(
    """select symbol, "Timestep", "Komponen", "Metrik", round("Nilai", 4) + 0.0 as "Nilai" from (
  select symbol, step::varchar as "Timestep", upper(component) as "Komponen", 'MSE' as "Metrik", mse as "Nilai" from steps
  union all select symbol, step::varchar, upper(component), 'R2', r2 from steps
  union all select symbol, 'Timestep 1', 'Signal', m.name, case m.name when 'accuracy' then accuracy
    when 'precision_up' then precision_up when 'recall_up' then recall_up when 'precision_down' then precision_down
    else recall_down end
  from signals, (values ('accuracy'), ('precision_up'), ('recall_up'), ('precision_down'), ('recall_down')) m(name))""",
    _STEPS,
    _NOW,
    _SIGNALS,
)
METRIC_KEYS = ["symbol", "Timestep", "Komponen", "Metrik"]


def metrics(spark, sf):
    pred = predictions(spark, sf)
    return ev.metric_rows(ev.step_metrics(pred), ev.precision_recall(ev.direction_now(pred)))


@query("metric_rows", METRIC_ROWS_SQL)
def long_metrics(spark, sf):
    return show(metrics(spark, sf), METRIC_KEYS, ["Nilai"], 4)


@query(
    "sample_extract",
    _sql(
        """select symbol, sample_id, round(y_true, 6) + 0.0 as y_true, round(y_pred, 6) + 0.0 as y_pred,
  row_number() over (partition by symbol order by sample_id) as place
from predictions where step = 1 and component = 'close' qualify place <= 100"""
    ),
)
def extract(spark, sf):
    rows = ev.sample_extract(predictions(spark, sf))
    rows = rows.withColumn("place", rows.place.cast("bigint"))
    return show(rows, ["symbol", "sample_id", "place"], ["y_true", "y_pred"])


@query(
    "empty_test",
    _sql(
        f"select symbol, step, component, {rounded('mse', digits=4)} from steps where symbol in "
        "(select symbol from bars where n > 680)",
        _STEPS,
    ),
)
def empty_test(spark, sf):
    """A symbol without test rows gets no metric rows."""
    sizes = numbered_once(hourly(spark, sf), HOURLY).filter("rn = 1 and n > 680").select("symbol")
    kept = predictions(spark, sf).join(sizes, "symbol", "left_semi")
    return show(ev.step_metrics(kept), ["symbol", "step", "component"], ["mse"], 4)


@query(
    "forecast_band",
    _sql(
        """select symbol, sample_id, round(max(y_pred) filter (component = 'close'), 6) + 0.0 as close,
  round(max(y_pred) filter (component = 'low'), 6) + 0.0 as low,
  round(max(y_pred) filter (component = 'high'), 6) + 0.0 as high
from predictions where step = 1 group by 1, 2"""
    ),
)
def band(spark, sf):
    bars = hourly(spark, sf)
    rows = numbered_once(bars, HOURLY).filter(f"rn + {HORIZON} <= n")
    moved = {c: f"{c} + close - open" for c in ("low", "high")}
    rows = add(rows, _c="close + close - open", **{f"_{c}": sql for c, sql in moved.items()})
    rows = rows.selectExpr("symbol", "ts", "rn - 1 as sample_id", "_c as close", "_low as low", "_high as high")
    ids = rows.select("symbol", "ts", "sample_id")
    return show(
        ev.forecast_band(rows).join(ids, ["symbol", "ts"]), ["symbol", "sample_id"], ["close", "low", "high"]
    )
