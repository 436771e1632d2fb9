import importlib

import numpy as np
import pandas as pd
import pytest
from conftest import ordered, random_bars

from barspark.plans import Layout, ewm, number_rows, over, running_max, settle, spread

LAYOUTS = [Layout("H1"), Layout("H1", bucket_slots=7, chunk_rows=16, fanout=2)]


def two_series(rows=150):
    return pd.concat([random_bars(rows, "A", 1), random_bars(rows // 3, "B", 2)])


@pytest.mark.parametrize("layout", LAYOUTS)
def test_positions(spark, layout):
    pdf = two_series().sample(frac=1, random_state=3)
    got = ordered(number_rows(spark.createDataFrame(pdf).repartition(5), layout))
    want = pdf.sort_values(["symbol", "ts"], ignore_index=True)
    groups = want.groupby("symbol")
    assert (got.rn == groups.cumcount() + 1).all()
    assert (got.n == groups["ts"].transform("size")).all()


def test_positions_with_ties(spark):
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.Timestamp("2024-01-01"), "id": [3, 1, 2]})
    got = number_rows(spark.createDataFrame(pdf), Layout("M1"), tie=("id",)).toPandas()
    assert (got.rn == got.id).all()


@pytest.mark.parametrize("layout", LAYOUTS)
def test_windows_do_not_see_chunk_borders(spark, layout):
    pdf = two_series()
    rows = spread(number_rows(spark.createDataFrame(pdf), layout), layout, back=9, ahead=4)
    rows = rows.selectExpr(
        "*",
        f"{over('sum(close)', 'rows between 9 preceding and current row')} as past",
        f"{over('max(close)', 'rows between 1 following and 4 following')} as next",
    )
    got = ordered(settle(rows))
    assert len(got) == len(pdf)
    by = pdf.sort_values(["symbol", "ts"], ignore_index=True).groupby("symbol")["close"]
    past = by.transform(lambda x: x.rolling(10, min_periods=1).sum())
    ahead = by.transform(lambda x: x[::-1].rolling(4, min_periods=1).max()[::-1].shift(-1))
    np.testing.assert_allclose(got.past, past, rtol=1e-12)
    np.testing.assert_allclose(got.next, ahead)


def test_look_around_must_fit_a_chunk(spark):
    with pytest.raises(ValueError):
        spread(spark.range(1), Layout(chunk_rows=8), back=9)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_running_max(spark, layout):
    rows = settle(spread(number_rows(spark.createDataFrame(two_series()), layout), layout))
    marked = "case when volume = 1 then named_struct('rn', rn, 'v', close) end"
    got = running_max(rows, {"upto": marked, "before": marked}, layout, strict=frozenset({"before"}))
    got = ordered(got)
    value = got.close.where(got.volume == 1)
    upto = value.groupby(got.symbol).ffill()
    before = upto.groupby(got.symbol).shift()
    for column, want in (("upto", upto), ("before", before)):
        have = got[column].map(lambda r: np.nan if r is None else r.v)
        np.testing.assert_array_equal(have.astype(float), want)


@pytest.mark.parametrize("rows", [1, 127, 128, 129, 400])
def test_ewm_matches_pandas(spark, rows):
    rng = np.random.default_rng(rows)
    pdf = random_bars(rows, seed=rows)
    pdf["x"] = np.where((rng.random(rows) < 0.3) | (np.arange(rows) < 3), np.nan, pdf.close)
    # a gap longer than a chunk
    pdf.loc[140:300, "x"] = np.nan
    layout = Layout("H1", bucket_slots=50, chunk_rows=32, fanout=3)
    df = spark.createDataFrame(pdf).selectExpr("symbol", "ts", "close", "nanvl(x, null) as x")
    chunked = settle(spread(number_rows(df, layout), layout))
    specs = {"a": ("x", 1 / 3), "b": ("x", 2 / 51), "c": ("close", 1 / 14)}
    got = ordered(ewm(chunked, specs, layout))
    for out, (column, alpha) in specs.items():
        want = pdf[column].ewm(alpha=alpha, adjust=False).mean()
        have = got[out].astype(float)
        assert (have.isna() == want.isna()).all()
        np.testing.assert_allclose(have, want, rtol=1e-11)


def test_ewm_refuses_what_would_overflow(spark):
    with pytest.raises(ValueError, match="chunk_rows"):
        ewm(spark.range(1), {"a": ("id", 0.9)}, Layout())
    with pytest.raises(ValueError, match="alpha"):
        ewm(spark.range(1), {"a": ("id", 1.0)}, Layout())


def test_layout_is_checked():
    with pytest.raises(ValueError):
        Layout("H2")
    with pytest.raises(ValueError):
        Layout(chunk_rows=0)


def test_one_symbol_gives_bounded_groups_of_chunk_summaries(spark, monkeypatch):
    module = importlib.import_module("barspark.plans.ewm")

    staged = {}

    def keep(df, label, write=module.stage):
        staged[label] = write(df, label)
        return staged[label]

    monkeypatch.setattr(module, "stage", keep)
    layout = Layout("H1", bucket_slots=50, chunk_rows=16, fanout=4)
    df = spark.createDataFrame(random_bars(1000, seed=5)).select("symbol", "ts", "close")
    ewm(settle(spread(number_rows(df, layout), layout)), {"a": ("close", 0.1)}, layout)
    groups = staged["carry"].groupBy("_group").count().toPandas()
    # the chunks of a group and its total; then one total for each group
    assert groups["count"].max() <= layout.fanout + 1 and len(groups) == -(-1000 // (16 * 4))
