"""Exclusive prefix maxima and sums over per-chunk summaries.

The rows here are summaries (one per chunk or bucket), already far fewer than the data. They are
still not gathered per symbol at once: ``fanout`` neighbours are scanned in one group, then the group
totals. With 1,024-row chunks and a fan-out of 4,096 the last level holds one row per 4.2 million.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_EARLIER = "rows between unbounded preceding and 1 preceding"


def exclusive_prefix(parts: DataFrame, pos: str, how: dict[str, str], fanout: int) -> DataFrame:
    """Add ``<col>_before`` (sum or max over all earlier ``pos`` of the symbol) and ``<col>_all``.

    ``parts`` has one row per ``(symbol, pos)``; nothing before gives 0 for sums, NULL for maxima.
    """
    grouped = parts.selectExpr("*", f"floor({pos} / {fanout}) as _group")
    inner = grouped.selectExpr(
        "*",
        *[
            f"{h}({c}) over (partition by symbol, _group order by {pos} {_EARLIER}) as _in_{c}"
            for c, h in how.items()
        ],
    )
    groups = (
        grouped.groupBy("symbol", "_group")
        .agg(*[F.expr(f"{h}({c}) as _t_{c}") for c, h in how.items()])
        .selectExpr(
            "symbol",
            "_group",
            *[
                f"{h}(_t_{c}) over (partition by symbol order by _group {_EARLIER}) as _pre_{c}"
                for c, h in how.items()
            ],
            *[f"{h}(_t_{c}) over (partition by symbol) as {c}_all" for c, h in how.items()],
        )
    )

    def total(c: str, h: str) -> str:
        if h == "sum":
            return f"coalesce(_pre_{c}, 0) + coalesce(_in_{c}, 0) as {c}_before"
        return f"greatest(_pre_{c}, _in_{c}) as {c}_before"

    return inner.join(groups, ["symbol", "_group"]).selectExpr(
        *parts.columns, *[total(c, h) for c, h in how.items()], *[f"{c}_all" for c in how]
    )

