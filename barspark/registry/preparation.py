"""Scaling, windows and splits over the hourly bars."""

from __future__ import annotations

from ..operators import prepare as pr
from ..operators.blocks import of_split, samples_of, sequence_blocks
from ..plans import number_rows, numbered_once, stage
from .base import HOURLY, bars_sql, hourly, query, rounded, show, stamp

WINDOW, HORIZON = 10, 5
COLUMNS = ["open", "high", "low", "close", "volume"]
_T = f"cast(floor((n - {WINDOW} - {HORIZON} + 1) * 0.7::double) as bigint)"


def _bounds(columns) -> list[str]:
    return [f"{c}_{m}" for c in columns for m in ("min", "max")]


def _fit(columns, rows: str = "true") -> str:
    parts = ", ".join(f"min({c}) as {c}_min, max({c}) as {c}_max" for c in columns)
    return f"select symbol, max(n) as n, {parts} from bars where {rows} group by symbol"


_INPUTS = _fit(COLUMNS, f"rn <= {_T} + {WINDOW}")
_OUTPUTS = _fit(COLUMNS[:4], f"rn > {WINDOW} and rn <= {_T} + {WINDOW} + {HORIZON}")


def numbered(spark, sf):
    return number_rows(hourly(spark, sf), HOURLY)


def _fit_sql(inner: str, columns) -> str:
    return bars_sql(f"select symbol, n, {rounded(*_bounds(columns))} from ({inner})")


@query("minmax_all", _fit_sql(_fit(COLUMNS), COLUMNS))
def minmax_all(spark, sf):
    return show(pr.fit_minmax(numbered(spark, sf), COLUMNS), ["symbol", "n"], _bounds(COLUMNS))


@query("minmax_train_inputs", _fit_sql(_INPUTS, COLUMNS))
def minmax_inputs(spark, sf):
    fitted = pr.fit_minmax_train(numbered(spark, sf), COLUMNS, WINDOW, HORIZON)
    return show(fitted, ["symbol", "n"], _bounds(COLUMNS))


@query("minmax_train_targets", _fit_sql(_OUTPUTS, COLUMNS[:4]))
def minmax_targets(spark, sf):
    fitted = pr.fit_minmax_train(numbered(spark, sf), COLUMNS[:4], WINDOW, HORIZON, of="targets")
    return show(fitted, ["symbol", "n"], _bounds(COLUMNS[:4]))


_SCALED = ", ".join(
    f"(b.{c} - {c}_min) / coalesce(nullif({c}_max - {c}_min, 0), 1) as {c}" for c in COLUMNS
)


@query(
    "scale",
    bars_sql(
        f"""select symbol, {stamp()}, {rounded(*COLUMNS)} from (
  select b.symbol, b.ts, {_SCALED} from bars b join fitted f on f.symbol = b.symbol)""",
        f"fitted as ({_INPUTS})",
    ),
)
def scaled(spark, sf):
    rows = numbered_once(hourly(spark, sf), HOURLY)
    fitted = pr.fit_minmax_train(rows, COLUMNS, WINDOW, HORIZON)
    return show(pr.scale(rows, fitted, COLUMNS, HOURLY), numbers=COLUMNS)


@query("inverse_scale", bars_sql(f"select symbol, {stamp()}, {rounded(*COLUMNS)} from bars"))
def unscaled(spark, sf):
    rows = numbered_once(hourly(spark, sf), HOURLY)
    fitted = pr.fit_minmax_train(rows, COLUMNS, WINDOW, HORIZON)
    back = pr.inverse_scale(
        pr.scale(rows, fitted, COLUMNS, HOURLY), fitted, {c: c for c in COLUMNS}, HOURLY
    )
    return show(back, numbers=COLUMNS)


@query(
    "input_windows",
    bars_sql(
        f"""select a.symbol, a.rn - {WINDOW} as sample_id, b.rn - a.rn + {WINDOW - 1} as place,
  round(b.open, 6) + 0.0 as open, round(b.close, 6) + 0.0 as close
from bars a join bars b on b.symbol = a.symbol and b.rn between a.rn - {WINDOW - 1} and a.rn
where a.rn >= {WINDOW}"""
    ),
)
def windows(spark, sf):
    rows = pr.input_windows(numbered(spark, sf), ["open", "close"], WINDOW, HOURLY)
    return rows.selectExpr("symbol", "sample_id", "posexplode(x) as (place, v)").selectExpr(
        "symbol", "sample_id", "cast(place as bigint) as place", "round(v[0], 6) + 0D as open", "round(v[1], 6) + 0D as close"
    )


@query(
    "horizon_targets",
    bars_sql(
        f"""select a.symbol, a.rn - {WINDOW} as sample_id, (b.rn - a.rn - 1) * 4 + c.k as place,
  round(case c.k when 0 then b.open when 1 then b.high when 2 then b.low else b.close end, 6) + 0.0 as y
from bars a join bars b on b.symbol = a.symbol and b.rn between a.rn + 1 and a.rn + {HORIZON},
  (values (0), (1), (2), (3)) c(k)
where a.rn >= {WINDOW} and a.rn + {HORIZON} <= a.n"""
    ),
)
def targets(spark, sf):
    rows = pr.horizon_targets(numbered(spark, sf), WINDOW, HORIZON, layout=HOURLY)
    return rows.selectExpr("symbol", "sample_id", "posexplode(y) as (place, v)").selectExpr(
        "symbol", "sample_id", "cast(place as bigint) as place", "round(v, 6) + 0D as y"
    )


def _samples(spark, sf):
    return pr.sequences(numbered(spark, sf), ["close", "volume"], WINDOW, HORIZON, layout=HOURLY)


@query(
    "sequences",
    bars_sql(
        f"""select a.symbol, a.rn - {WINDOW} as sample_id, a.n - {WINDOW} - {HORIZON} + 1 as samples,
  round(sum(b.close * (b.rn - a.rn + {WINDOW})) filter (b.rn <= a.rn), 4) + 0.0 as x_sum,
  round(sum(b.low * (b.rn - a.rn)) filter (b.rn > a.rn), 4) + 0.0 as y_sum
from bars a join bars b on b.symbol = a.symbol and b.rn between a.rn - {WINDOW - 1} and a.rn + {HORIZON}
where a.rn >= {WINDOW} and a.rn + {HORIZON} <= a.n group by 1, 2, 3"""
    ),
)
def sample_rows(spark, sf):
    x = "aggregate(transform(x, (r, i) -> r[0] * (i + 1)), 0D, (a, b) -> a + b)"
    y = "aggregate(transform(y, (v, i) -> case when i % 4 = 2 then v * (i div 4 + 1) else 0D end), 0D, (a, b) -> a + b)"
    rows = _samples(spark, sf).selectExpr("symbol", "sample_id", "samples", f"{x} as x_sum", f"{y} as y_sum")
    return show(rows, ["symbol", "sample_id", "samples"], ["x_sum", "y_sum"], 4)


@query(
    "sequence_blocks",
    bars_sql(
        f"""select a.symbol, a.rn as rn, a.rn - {WINDOW} as sample_id,
  case when a.rn - {WINDOW} < floor((a.n - {WINDOW} - {HORIZON} + 1) * 0.7::double) then 'train'
    when a.rn - {WINDOW} < floor((a.n - {WINDOW} - {HORIZON} + 1) * 0.7::double)
      + floor((a.n - {WINDOW} - {HORIZON} + 1) * 0.15::double) then 'val' else 'test' end as split,
  round(sum(b.close * (b.rn - a.rn + {WINDOW})) filter (b.rn <= a.rn), 4) + 0.0 as x_sum,
  round(sum(b.low * (b.rn - a.rn)) filter (b.rn > a.rn), 4) + 0.0 as y_sum
from bars a join bars b on b.symbol = a.symbol and b.rn between a.rn - {WINDOW - 1} and a.rn + {HORIZON}
where a.rn >= {WINDOW} and a.rn + {HORIZON} <= a.n group by 1, 2, 3, 4"""
    ),
)
def block_samples(spark, sf):
    """The samples of every split, read back from the store of blocks."""
    columns = ["close", "volume"]
    blocks = stage(sequence_blocks(numbered(spark, sf), columns, WINDOW, HORIZON, layout=HOURLY), "blocks")
    x = "aggregate(transform(x, (r, i) -> r[0] * (i + 1)), 0D, (a, b) -> a + b)"
    y = "aggregate(transform(y, (v, i) -> case when i % 4 = 2 then v * (i div 4 + 1) else 0D end), 0D, (a, b) -> a + b)"
    rows = None
    for split in pr.SPLITS:
        own = samples_of(of_split(blocks, split), WINDOW, HORIZON, len(columns)).selectExpr("*", f"'{split}' as split")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.selectExpr("symbol", "rn", "sample_id", "split", f"{x} as x_sum", f"{y} as y_sum")
    return show(rows, ["symbol", "rn", "sample_id", "split"], ["x_sum", "y_sum"], 4)


_SAMPLES = f"""samples as (select symbol, rn - {WINDOW} as sample_id, n - {WINDOW} - {HORIZON} + 1 as samples
  from bars where rn >= {WINDOW} and rn + {HORIZON} <= n)"""
_FRACTION = """case when sample_id < floor(samples * 0.7::double) then 'train'
  when sample_id < floor(samples * 0.7::double) + floor(samples * 0.15::double) then 'val' else 'test' end"""
_CEIL = """case when sample_id < samples - ceil(samples * 0.3::double) then 'train'
  when sample_id < samples - ceil(ceil(samples * 0.3::double) * 0.5) then 'val' else 'test' end"""


@query("split_fraction", bars_sql(f"select symbol, sample_id, {_FRACTION} as split from samples", _SAMPLES))
def split_fraction(spark, sf):
    return pr.split_by_fraction(_samples(spark, sf)).select("symbol", "sample_id", "split")


@query("split_ceil", bars_sql(f"select symbol, sample_id, {_CEIL} as split from samples", _SAMPLES))
def split_ceil(spark, sf):
    return pr.split_by_ceil(_samples(spark, sf)).select("symbol", "sample_id", "split")


@query(
    "split_report",
    bars_sql(
        f"""select s.symbol, k.split, count(d.sample_id) as rows, count(d.sample_id) = 0 as empty
from (select distinct symbol from samples) s cross join (values ('train'), ('val'), ('test')) k(split)
left join (select *, {_FRACTION} as split from samples) d on d.symbol = s.symbol and d.split = k.split
group by 1, 2""",
        _SAMPLES,
    ),
)
def report(spark, sf):
    return pr.split_report(pr.split_by_fraction(_samples(spark, sf)))


@query(
    "tail_window",
    bars_sql(f"select symbol, {stamp()}, {rounded('close')} from bars where rn > n - 90"),
)
def tail(spark, sf):
    return show(pr.tail_window(numbered(spark, sf), 90), numbers=["close"])
