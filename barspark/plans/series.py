"""Row positions, chunk windows with halos, and carried maxima for series of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .layout import Layout
from .prefix import exclusive_prefix
from .stage import stage


def number_rows(df: DataFrame, layout: Layout = Layout(), tie: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rn`` (1-based position by ``ts`` then ``tie``) and ``n`` (rows of the series).

    Positions are counted inside time buckets and shifted by the rows of all earlier buckets, so no
    task sees more than one bucket of a symbol. The bucket counts of a symbol are summed in one window;
    their number depends on the time span alone (a century of M1 bars makes 12,800 buckets).
    ``(symbol, ts, *tie)`` must be unique and not NULL. A data frame that already has ``rn`` and ``n``
    is returned as it is.
    """
    if {"rn", "n"} <= set(df.columns):
        return df
    return _shifted(df, _placed(df, layout, tie))


def _placed(df: DataFrame, layout: Layout, tie: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``_bucket`` and ``_place``, their position in it."""
    bucketed = df.selectExpr(
        "*", f"floor(unix_timestamp(ts) / {layout.bucket_seconds}) as _bucket"
    )
    order = ", ".join(("ts", *tie))
    return bucketed.selectExpr(
        "*", f"row_number() over (partition by symbol, _bucket order by {order}) as _place"
    )


def _shifted(df: DataFrame, placed: DataFrame) -> DataFrame:
    counts = placed.groupBy("symbol", "_bucket").agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts.selectExpr(
        "symbol",
        "_bucket",
        "coalesce(sum(rows) over (partition by symbol order by _bucket "
        "rows between unbounded preceding and 1 preceding), 0) as rows_before",
        "sum(rows) over (partition by symbol) as rows_all",
    )
    return placed.join(offsets, ["symbol", "_bucket"]).selectExpr(
        *[f"`{c}`" for c in df.columns], "rows_before + _place as rn", "rows_all as n"
    )


def numbered_once(df: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """``number_rows`` for plans that read the series several times: the rows and their places are written once.

    The bucket counts are read off that table, so that ``df`` is worked out once and not for rows and counts.
    """
    if {"rn", "n"} <= set(df.columns):
        return df
    return _shifted(df, stage(_placed(df, layout), "series"))


def chunk_sql(layout: Layout, rn: str = "rn") -> str:
    return f"floor(({rn} - 1) / {layout.chunk_rows})"


def spread(df: DataFrame, layout: Layout, back: int = 0, ahead: int = 0) -> DataFrame:
    """Assign rows to chunks and copy border rows into the neighbour that looks at them.

    ``back`` rows of each chunk are also sent to the next one, ``ahead`` rows to the one before.
    In a window over ``(symbol, _chunk)`` a home row then sees the same neighbours as in the whole
    series. ``settle`` removes the copies.
    """
    size = layout.chunk_rows
    if back > size or ahead > size:
        raise ValueError(f"a look-around of {max(back, ahead)} rows needs chunk_rows >= that")
    own, last = chunk_sql(layout), chunk_sql(layout, "n")
    if not back and not ahead:
        return df.selectExpr("*", f"{own} as _chunk", "true as _home")
    places = [own]
    if back:
        places.append(f"case when (rn - 1) % {size} >= {size - back} and {own} < {last} then {own} + 1 end")
    if ahead:
        places.append(f"case when (rn - 1) % {size} < {ahead} and {own} > 0 then {own} - 1 end")
    return df.selectExpr(
        "*", f"explode(array_compact(array({', '.join(places)}))) as _chunk"
    ).selectExpr("*", f"_chunk = {own} as _home")


def settle(df: DataFrame) -> DataFrame:
    """Drop the halo copies made by ``spread``."""
    return df.filter("_home").drop("_home")


def over(expr: str, frame: str = "") -> str:
    """SQL of a window expression over the chunk, in time order."""
    return f"{expr} over (partition by symbol, _chunk order by rn {frame})"


def so_far(expr: str) -> str:
    return over(expr, "rows between unbounded preceding and current row")


def earlier(expr: str) -> str:
    return over(expr, "rows between unbounded preceding and 1 preceding")


def chunk_end_sql(layout: Layout) -> str:
    return f"(rn % {layout.chunk_rows} = 0 or rn = n)"


def running_max(
    df: DataFrame, exprs: dict[str, str], layout: Layout, strict: frozenset[str] = frozenset()
) -> DataFrame:
    """Add running maxima over the whole series (``df`` chunked and settled).

    With a struct that starts with ``rn`` this is "the last non-null value so far". Names in
    ``strict`` look at earlier rows only.
    """
    local = df.selectExpr(
        "*",
        *[f"{so_far(f'max({e})')} as _m_{name}" for name, e in exprs.items()],
        *[f"{earlier(f'max({exprs[name]})')} as _e_{name}" for name in strict],
    )
    # the running maximum at the end of a chunk is the maximum of the chunk
    chunks = local.filter(chunk_end_sql(layout)).selectExpr(
        "symbol", "_chunk", *[f"_m_{name} as {name}" for name in exprs]
    )
    before = exclusive_prefix(chunks, "_chunk", {name: "max" for name in exprs}, layout.fanout)
    before = before.select("symbol", "_chunk", *[f"{name}_before" for name in exprs])
    return local.join(before, ["symbol", "_chunk"]).selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[
            f"greatest({name}_before, {'_e_' if name in strict else '_m_'}{name}) as {name}"
            for name in exprs
        ],
    )


def per_chunk(params: DataFrame, layout: Layout) -> DataFrame:
    """Repeat one-row-per-symbol parameters for every chunk of the symbol (needs ``n``).

    Joining on ``(symbol, _chunk)`` spreads a large symbol over many tasks, which a join on
    ``symbol`` alone would not.
    """
    return params.selectExpr(
        "*", f"explode(sequence(0, cast({chunk_sql(layout, 'n')} as bigint))) as _chunk"
    )


def join_salted(df: DataFrame, small: DataFrame, on: list[str], by: str, salts: int = 64) -> DataFrame:
    """Left join of a per-key table; each key is repeated ``salts`` times so that no key is hot.

    Spark still broadcasts ``small`` when its own size statistics are under the broadcast threshold.
    """
    repeated = small.selectExpr("*", f"explode(sequence(0, {salts - 1})) as _salt")
    salted = df.selectExpr("*", f"cast(pmod(xxhash64({by}), {salts}) as int) as _salt")
    return salted.join(repeated, [*on, "_salt"], "left").drop("_salt")
