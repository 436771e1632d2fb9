import numpy as np
import pandas as pd
import pytest
from conftest import random_bars
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from barspark.operators import blocks as bl
from barspark.operators import forecast as fc
from barspark.operators import prepare as pr
from barspark.operators import regression as rg
from barspark.plans import Layout, number_rows, stage

SMALL = Layout("H1", bucket_slots=40, chunk_rows=32, fanout=2)
COLUMNS = ["open", "high", "low", "close", "volume"]


def scaled(spark, sizes=(150, 90, 14, 15, 5)):
    pdf = pd.concat([random_bars(n, f"S{n}", n) for n in sizes], ignore_index=True)
    rows = number_rows(spark.createDataFrame(pdf), SMALL)
    return stage(pr.scale(rows, pr.fit_minmax(rows, COLUMNS), COLUMNS, SMALL), "scaled")


@pytest.mark.parametrize("w, h", [(10, 5), (1, 1), (32, 32), (3, 7)])
def test_samples_are_those_of_sequences(spark, w, h):
    rows = scaled(spark)
    blocks = bl.sequence_blocks(rows, COLUMNS, w, h, layout=SMALL)
    got = bl.samples_of(blocks, w, h, len(COLUMNS)).toPandas()
    want = pr.sequences(rows, COLUMNS, w, h, layout=SMALL).drop("ts").toPandas()
    keys = ["symbol", "sample_id"]
    got, want = (d.sort_values(keys, ignore_index=True) for d in (got, want))
    pd.testing.assert_frame_equal(got[[*keys, "rn", "n", "samples"]], want[[*keys, "rn", "n", "samples"]], check_dtype=False)
    for a, b in zip(got.itertuples(), want.itertuples()):
        np.testing.assert_array_equal(np.array(list(map(list, a.x))), np.array(list(map(list, b.x))))
        np.testing.assert_array_equal(a.y, b.y)


@pytest.mark.parametrize("bounds, split", [(pr.fraction_bounds(), pr.split_by_fraction), (pr.ceil_bounds(), pr.split_by_ceil)])
def test_splits_of_blocks(spark, bounds, split):
    rows = scaled(spark)
    blocks = stage(bl.sequence_blocks(rows, COLUMNS, 10, 5, layout=SMALL), "blocks")
    want = split(pr.sequences(rows, COLUMNS, 10, 5, layout=SMALL)).select("symbol", "sample_id", "split").collect()
    got = [
        (r.symbol, r.sample_id, s)
        for s in pr.SPLITS
        for r in bl.samples_of(bl.of_split(blocks, s, bounds), 10, 5, len(COLUMNS)).collect()
    ]
    assert sorted(got) == sorted(map(tuple, want))


def test_rows_are_kept_about_once(spark):
    pdf = random_bars(5000)
    rows = number_rows(spark.createDataFrame(pdf), Layout("H1"))
    stored = bl.sequence_blocks(rows, COLUMNS, 90, 15, layout=Layout("H1")).selectExpr("size(x) as x").agg(F.sum("x")).first()[0]
    assert stored <= 1.12 * 5000 * len(COLUMNS)


def all_at_once(spark, train, w, h, reg):
    """A linear regression for each output on the samples written out."""
    outputs = h * len(pr.TARGETS)
    rows = train.select(
        array_to_vector(F.flatten("x")).alias("features"), *[F.col("y")[k].alias(f"y{k}") for k in range(outputs)]
    ).cache()
    models = [
        LinearRegression(labelCol=f"y{k}", regParam=reg, standardization=False, solver="normal").fit(rows) for k in range(outputs)
    ]
    return np.array([m.coefficients.toArray() for m in models]).T, np.array([m.intercept for m in models])


@pytest.mark.parametrize("w, h", [(4, 2), (1, 1), (30, 1)])
def test_coefficients_equal_separate_regressions(spark, monkeypatch, w, h):
    monkeypatch.setattr(rg, "TILE", 50)
    monkeypatch.setattr(rg, "FAN", 2)
    monkeypatch.setattr(rg, "ENDS", 2)
    rows = scaled(spark)
    blocks = stage(bl.sequence_blocks(rows, COLUMNS, w, h, layout=SMALL).repartition(5), "blocks")
    train = pr.split_by_fraction(pr.sequences(rows, COLUMNS, w, h, layout=SMALL)).where("split = 'train'")
    regs = (0.001, 0.1)
    fitted = fc.fit_blocks(bl.of_split(blocks, "train"), COLUMNS, w, h, regs)
    for model, reg in zip(fitted, regs):
        coefficients, intercepts = all_at_once(spark, train, w, h, reg)
        np.testing.assert_allclose(model.coefficients, coefficients, atol=1e-8)
        np.testing.assert_allclose(model.intercepts, intercepts, atol=1e-8)
    again = fc.fit_forecaster(train, COLUMNS, w, h, regs[0])
    np.testing.assert_allclose(again.coefficients, fitted[0].coefficients, atol=1e-10)


def test_moments_equal_the_plain_sums(spark):
    w, h = 6, 3
    rows = scaled(spark)
    blocks = bl.sequence_blocks(rows, COLUMNS, w, h, layout=SMALL)
    pdf = pr.sequences(rows, COLUMNS, w, h, layout=SMALL).toPandas()
    x = np.array([np.concatenate([list(r) for r in v]) for v in pdf.x])
    y = np.array(pdf.y.tolist())
    got = rg.moments(blocks, w, h, len(COLUMNS), 4)
    assert got.samples == len(x)
    for a, b in ((got.x, x.sum(0)), (got.y, y.sum(0)), (got.xx, x.T @ x), (got.xy, x.T @ y), (got.yy, (y * y).sum(0))):
        np.testing.assert_allclose(a, b, rtol=1e-10, atol=1e-9)


def test_losses_and_scores(spark):
    w, h = 5, 2
    rows = scaled(spark)
    blocks = stage(bl.sequence_blocks(rows, COLUMNS, w, h, layout=SMALL), "blocks")
    best, losses = fc.fit_best(bl.of_split(blocks, "train"), bl.of_split(blocks, "val"), COLUMNS, w, h, (0.001, 10.0))
    samples = pr.split_by_fraction(pr.sequences(rows, COLUMNS, w, h, layout=SMALL))
    scored = best.score(samples.where("split = 'val'")).toPandas()
    want = ((np.array(scored.y.tolist()) - np.array(scored.y_hat.tolist())) ** 2).mean()
    assert losses.agg(F.min("val_mse")).first()[0] == pytest.approx(want, rel=1e-9)
    test = samples.where("split = 'test'")
    old = fc.prediction_rows(best.score(test), COLUMNS.index("close")).toPandas()
    new = fc.prediction_rows(best.score_blocks(bl.of_split(blocks, "test"))).toPandas()
    keys = ["symbol", "sample_id", "step", "component"]
    old, new = (d.sort_values(keys, ignore_index=True)[sorted(d.columns)] for d in (old, new))
    pd.testing.assert_frame_equal(old, new, rtol=1e-9)


def test_nothing_to_fit_on_and_missing_values(spark):
    rows = scaled(spark)
    blocks = bl.sequence_blocks(rows, COLUMNS, 10, 5, layout=SMALL)
    with pytest.raises(ValueError, match="no samples"):
        fc.fit_blocks(blocks.limit(0), COLUMNS, 10, 5)
    holes = rows.withColumn("close", F.expr("case when rn <> 7 then close end"))
    with pytest.raises(ValueError, match="missing"):
        fc.fit_blocks(bl.sequence_blocks(holes, COLUMNS, 10, 5, layout=SMALL), COLUMNS, 10, 5)
    assert bl.sequence_blocks(rows, COLUMNS, 100, 60, layout=Layout("H1")).count() == 0
