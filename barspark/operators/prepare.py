"""Data sets for forecasting: min-max scaling, sliding windows, chronological splits.

Rows carry ``rn`` and ``n`` from the feature table. Samples are numbered from 0: sample *i* reads rows
``i+1 .. i+window`` (by ``rn``) and predicts the ``horizon`` rows after them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans import Layout, chunk_sql, over, per_chunk, settle, spread
from .clean import require_columns

TARGETS = ("open", "high", "low", "close")
SPLITS = ("train", "val", "test")


def _extremes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.groupBy("symbol").agg(
        F.max("n").alias("n"),
        *[F.min(c).alias(f"{c}_min") for c in columns],
        *[F.max(c).alias(f"{c}_max") for c in columns],
    )


def fit_minmax(features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per-symbol minimum and maximum over all rows (later rows leak into the scale)."""
    return _extremes(require_columns(features, ["symbol", "n", *columns]), columns)


def fit_minmax_train(
    features: DataFrame,
    columns: Sequence[str],
    window: int,
    horizon: int,
    train: float = 0.7,
    of: str = "features",
) -> DataFrame:
    """Minimum and maximum over the rows of the training samples.

    Inputs use the first ``T + window`` rows, targets the rows after ``window`` up to
    ``T + window + horizon``, with T training samples. Both ranges end one row after the last row a
    training sample reads.
    """
    if of not in ("features", "targets"):
        raise ValueError("of must be 'features' or 'targets'")
    require_columns(features, ["symbol", "rn", "n", *columns])
    samples = f"(n - {window} - {horizon} + 1)"
    last_train = f"cast({samples} * {float(train)!r}D as bigint)"
    if of == "features":
        rows = f"rn <= {last_train} + {window}"
    else:
        rows = f"rn > {window} and rn <= {last_train} + {window} + {horizon}"
    return _extremes(features.filter(f"{samples} > 0 and {rows}"), columns)


def _with_params(df: DataFrame, params: DataFrame, layout: Layout) -> DataFrame:
    """Each row with its symbol's parameters, joined per chunk so that no symbol is one task."""
    rows = df.selectExpr("*", f"{chunk_sql(layout)} as _chunk")
    return rows.join(per_chunk(params, layout).drop("n"), ["symbol", "_chunk"])


def scale(
    df: DataFrame, params: DataFrame, columns: Sequence[str], layout: Layout = Layout()
) -> DataFrame:
    """Map each column to 0..1 by its fitted range; a constant column is only shifted to 0."""
    rest = {c: f"`{c}`" for c in df.columns}
    scaled = {
        c: f"(`{c}` - {c}_min) / coalesce(nullif({c}_max - {c}_min, 0D), 1D)" for c in columns
    }
    return _with_params(df, params, layout).selectExpr(
        *[f"{sql} as `{c}`" for c, sql in (rest | scaled).items()]
    )


def inverse_scale(
    df: DataFrame, params: DataFrame, columns: dict[str, str], layout: Layout = Layout()
) -> DataFrame:
    """Undo ``scale``. ``columns`` maps each column to the fitted column whose range it uses."""
    rest = {c: f"`{c}`" for c in df.columns}
    back = {
        c: f"`{c}` * coalesce(nullif({p}_max - {p}_min, 0D), 1D) + {p}_min" for c, p in columns.items()
    }
    return _with_params(df, params, layout).selectExpr(
        *[f"{sql} as `{c}`" for c, sql in (rest | back).items()]
    )


def input_windows(
    df: DataFrame, columns: Sequence[str], window: int, layout: Layout = Layout()
) -> DataFrame:
    """``sample_id, x`` for every full window, x = ``window`` rows of the columns."""
    rows = spread(require_columns(df, ["rn", "n", *columns]), layout, back=window - 1)
    frame = f"rows between {window - 1} preceding and current row"
    return (
        settle(
            rows.selectExpr("*", f"{over(f'collect_list({_row(columns)})', frame)} as x")
        )
        .filter(f"rn >= {window}")
        .selectExpr("symbol", "ts", "rn", "n", f"rn - {window} as sample_id", "x")
    )


def horizon_targets(
    df: DataFrame,
    window: int,
    horizon: int,
    targets: Sequence[str] = TARGETS,
    layout: Layout = Layout(),
) -> DataFrame:
    """``sample_id, y``: the next ``horizon`` rows of the targets, one flat array, step after step."""
    rows = spread(require_columns(df, ["rn", "n", *targets]), layout, ahead=horizon)
    frame = f"rows between 1 following and {horizon} following"
    return (
        settle(
            rows.selectExpr("*", f"flatten({over(f'collect_list({_row(targets)})', frame)}) as y")
        )
        .filter(f"rn >= {window} and rn + {horizon} <= n")
        .selectExpr("symbol", "ts", "rn", "n", f"rn - {window} as sample_id", "y")
    )


def sequences(
    df: DataFrame,
    columns: Sequence[str],
    window: int,
    horizon: int,
    targets: Sequence[str] | None = None,
    layout: Layout = Layout(),
) -> DataFrame:
    """Samples ``symbol, ts, rn, n, sample_id, samples, x, y`` in one pass.

    ``targets`` defaults to open, high, low, close; pass ``target_*`` columns when inputs and targets are
    scaled differently. The arrays are wide (window x columns doubles), so select and scale first.
    """
    targets = list(targets or TARGETS)
    rows = spread(
        require_columns(df, ["rn", "n", *columns, *targets]), layout, back=window - 1, ahead=horizon
    )
    behind = f"rows between {window - 1} preceding and current row"
    ahead = f"rows between 1 following and {horizon} following"
    return (
        settle(
            rows.selectExpr(
                "symbol",
                "ts",
                "rn",
                "n",
                "_home",
                f"{over(f'collect_list({_row(columns)})', behind)} as x",
                f"flatten({over(f'collect_list({_row(targets)})', ahead)}) as y",
            )
        )
        .filter(f"rn >= {window} and rn + {horizon} <= n")
        .selectExpr(
            "symbol",
            "ts",
            "rn",
            "n",
            f"rn - {window} as sample_id",
            f"n - {window} - {horizon} + 1 as samples",
            "x",
            "y",
        )
    )


def _row(columns: Sequence[str]) -> str:
    return "array(" + ", ".join(f"`{c}`" for c in columns) + ")"


def fraction_bounds(train: float = 0.7, val: float = 0.15) -> tuple[str, str]:
    """SQL of the first validation and the first test sample: after ``int(train * samples)``, and ``int(val * samples)`` more."""
    first = f"cast(samples * {float(train)!r}D as bigint)"
    return first, f"{first} + cast(samples * {float(val)!r}D as bigint)"


def ceil_bounds(held_out: float = 0.3, test: float = 0.5) -> tuple[str, str]:
    """As ``fraction_bounds``, with ``ceil(held_out * samples)`` at the end, and ``ceil(test * held out)`` of those for the test."""
    rest = f"ceil(samples * {float(held_out)!r}D)"
    return f"samples - {rest}", f"samples - ceil({rest} * {float(test)!r}D)"


def split_by_fraction(samples: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """First ``int(train * samples)``, next ``int(val * samples)``, rest test. No shuffle."""
    return _split(samples, *fraction_bounds(train, val))


def split_by_ceil(samples: DataFrame, held_out: float = 0.3, test: float = 0.5) -> DataFrame:
    """Hold out ``ceil(held_out * samples)`` at the end, then ``ceil(test * held out)`` of those."""
    return _split(samples, *ceil_bounds(held_out, test))


def _split(samples: DataFrame, first: str, second: str) -> DataFrame:
    return require_columns(samples, ["sample_id", "samples"]).selectExpr(
        "*",
        f"case when sample_id < {first} then 'train' when sample_id < {second} then 'val' "
        "else 'test' end as split",
    )


def split_report(samples: DataFrame) -> DataFrame:
    """Samples per symbol and split, with a row (and ``empty``) for splits that have none."""
    counts = samples.groupBy("symbol").agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )
    return counts.unpivot("symbol", list(SPLITS), "split", "rows").selectExpr(
        "*", "rows = 0 as empty"
    )


def tail_window(df: DataFrame, window: int) -> DataFrame:
    """The latest ``window`` rows of each symbol, read off the row positions."""
    return require_columns(df, ["rn", "n"]).filter(F.col("rn") > F.col("n") - window)
