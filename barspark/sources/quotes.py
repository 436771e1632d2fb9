"""Quotes as of a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans import exclusive_prefix


def quotes_at(
    requests: DataFrame,
    quotes: DataFrame,
    tie: str = "tick_id",
    bucket_seconds: int = 60,
    fanout: int = 4096,
) -> DataFrame:
    """Add the last quote at or before each request: ``quote_ts, bid, ask`` (NULL if none yet).

    Both sides are cut into time buckets. Inside a bucket a running maximum over (time, tie) finds the
    latest quote; the latest quote of each earlier bucket arrives through a prefix maximum over bucket
    summaries. Choose ``bucket_seconds`` so that a task can sort one symbol's quotes of a bucket.
    """
    bucket = f"floor(unix_timestamp(ts) / {bucket_seconds}) as _bucket"
    asked = requests.selectExpr("*", "1 as _kind", bucket)
    given = quotes.selectExpr(
        "symbol",
        "ts",
        "0 as _kind",
        bucket,
        f"named_struct('ts', ts, 'tie', {tie}, 'bid', bid, 'ask', ask) as _quote",
    )
    rows = asked.unionByName(given, allowMissingColumns=True)
    summaries = rows.groupBy("symbol", "_bucket").agg(F.max("_quote").alias("quote"))
    before = exclusive_prefix(summaries, "_bucket", {"quote": "max"}, fanout).select(
        "symbol", "_bucket", "quote_before"
    )
    # only buckets that hold a request are sorted
    wanted = asked.select("symbol", "_bucket").distinct()
    return (
        rows.join(wanted, ["symbol", "_bucket"], "left_semi")
        .selectExpr(
            "*",
            "max(_quote) over (partition by symbol, _bucket order by ts, _kind "
            "rows between unbounded preceding and current row) as _seen",
        )
        .filter("_kind = 1")
        .join(before, ["symbol", "_bucket"])
        .selectExpr(*[f"`{c}`" for c in requests.columns], "greatest(quote_before, _seen) as _q")
        .selectExpr(
            *[f"`{c}`" for c in requests.columns],
            "_q.ts as quote_ts",
            "_q.bid as bid",
            "_q.ask as ask",
        )
    )
