"""A whole study: features, samples, forecaster, metrics, report and forecast from one set of bars.

The two dialects differ in more than smoothing. ``wilder`` drops rows with missing values first, fits its
ranges on the training rows, splits by fraction and compares directions with the present close. ``simple``
uses the 26 model columns, fits on all rows, splits by the ceil rule and compares directions between
neighbouring samples.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..plans import Layout, number_rows, stage
from ..sources import sinks
from . import evaluate as ev
from . import features as feat
from . import forecast as fc
from . import indicators as ind
from . import prepare as pr
from .blocks import of_split, sequence_blocks
from .clean import drop_inf, drop_null, drop_warmup, keep_long_series


@dataclass(frozen=True)
class StudyConfig:
    smoothing: str = ind.WILDER
    window: int = 90
    horizon: int = 15
    train: float = 0.7
    val: float = 0.15
    columns: tuple[str, ...] = ()
    regs: tuple[float, ...] = (0.01,)
    layout: Layout = field(default_factory=Layout)

    @property
    def inputs(self) -> list[str]:
        if self.columns:
            return list(self.columns)
        return list(feat.WILDER_FEATURES if self.smoothing == ind.WILDER else feat.MODEL_FEATURES)

    @property
    def bounds(self) -> tuple[str, str]:
        return pr.fraction_bounds(self.train, self.val) if self.smoothing == ind.WILDER else pr.ceil_bounds(1 - self.train)

    @classmethod
    def simple(cls, **changes) -> StudyConfig:
        """The defaults of the simple dialect."""
        return cls(**({"smoothing": ind.SIMPLE, "window": 10, "horizon": 5} | changes))


@dataclass
class Study:
    config: StudyConfig
    rows: DataFrame
    blocks: DataFrame
    input_params: DataFrame
    target_params: DataFrame
    forecaster: fc.Forecaster
    losses: DataFrame

    def predictions(self, split: str = "test") -> DataFrame:
        """Predictions of a split in price units."""
        scored = self.forecaster.score_blocks(of_split(self.blocks, split, self.config.bounds))
        rows = fc.prediction_rows(scored)
        return fc.unscale_predictions(rows, self.input_params, self.target_params, self.config.layout)

    def metrics(self) -> DataFrame:
        """Long metric rows of the test split; none where it is empty."""
        predictions = stage(self.predictions(), "predictions")
        steps = ev.step_metrics(predictions)
        if self.config.smoothing == ind.WILDER:
            return ev.metric_rows(steps, ev.precision_recall(ev.direction_now(predictions)))
        moves = ev.direction_diff(predictions, self.config.layout)
        signals = ev.direction_accuracy(moves).drop("rows").join(ev.confusion_rates(moves), "symbol", "left")
        return ev.metric_rows(steps, signals, "All")

    def forecast(self, days: int) -> DataFrame:
        bars = self.rows.select("symbol", "ts", *pr.TARGETS, "volume")
        return fc.forecast(
            bars, self.forecaster, self.input_params, self.target_params, days,
            self.config.smoothing, self.config.layout,
        )

    def write(self, folder: str, dataset: str) -> None:
        """Metrics, summary text and the fitted models under one folder."""
        metrics = stage(self.metrics(), "metrics")
        counts = self.rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
        sinks.write_metrics(metrics, os.path.join(folder, "evaluation_results"))
        summary = sinks.summary_rows(metrics, counts, asdict(self.config), dataset)
        sinks.write_summary(summary, os.path.join(folder, "model_summary"))
        self.forecaster.save(os.path.join(folder, "models"))


def clean_features(bars: DataFrame, config: StudyConfig) -> DataFrame:
    """Feature rows without missing or infinite values, numbered anew."""
    if config.smoothing == ind.WILDER:
        bars = drop_null(bars)
    elif "volume" not in bars.columns:
        bars = bars.withColumn("volume", F.lit(None).cast("double"))
    # staged, so that the filters below see plain columns and not the window expressions
    full = stage(
        feat.technical_features(bars, config.smoothing, config.layout).drop("rn", "n"), "all-features"
    )
    names = [c for c in full.columns if c not in ("symbol", "ts", "volume")]
    kept = drop_warmup(full, names)
    if config.smoothing == ind.WILDER:
        kept = drop_inf(kept, names)
    return number_rows(kept, config.layout)


def run_study(bars: DataFrame, config: StudyConfig = StudyConfig()) -> Study:
    """Fit and validate on ``symbol, ts, open..close, volume`` bars.

    Symbols too short for a single sample are left out. The feature rows, ranges and blocks are staged.
    """
    w, h, layout = config.window, config.horizon, config.layout
    columns, targets = config.inputs, list(pr.TARGETS)
    rows = stage(keep_long_series(clean_features(bars, config), w, h), "features")
    if rows.isEmpty():
        raise ValueError(f"no symbol has the {w + h} clean rows one sample needs")

    if config.smoothing == ind.WILDER:
        inputs = pr.fit_minmax_train(rows, columns, w, h, config.train)
        outputs = pr.fit_minmax_train(rows, targets, w, h, config.train, of="targets")
    else:
        inputs, outputs = pr.fit_minmax(rows, columns), pr.fit_minmax(rows, targets)
    inputs, outputs = stage(inputs, "input-range"), stage(outputs, "target-range")

    blocks = stage(scaled_blocks(rows, inputs, outputs, columns, w, h, layout), "blocks")
    train, val = (of_split(blocks, split, config.bounds) for split in ("train", "val"))
    forecaster, losses = fc.fit_best(train, val, columns, w, h, config.regs)
    return Study(config, rows, blocks, inputs, outputs, forecaster, losses)


TARGET_NAMES = [f"target_{c}" for c in pr.TARGETS]


def scaled_rows(rows: DataFrame, inputs: DataFrame, outputs: DataFrame, columns: Sequence[str], layout: Layout) -> DataFrame:
    """Inputs and, as ``target_*``, targets, each on its own scale."""
    ranges = outputs.selectExpr(
        "symbol", "n", *[f"{c}_{m} as target_{c}_{m}" for c in pr.TARGETS for m in ("min", "max")]
    )
    scaled = rows.selectExpr("*", *[f"{c} as target_{c}" for c in pr.TARGETS])
    return pr.scale(pr.scale(scaled, inputs, columns, layout), ranges, TARGET_NAMES, layout)


def scaled_blocks(
    rows: DataFrame, inputs: DataFrame, outputs: DataFrame, columns: Sequence[str], window: int, horizon: int, layout: Layout
) -> DataFrame:
    """The store of samples that a study fits and scores on."""
    return sequence_blocks(scaled_rows(rows, inputs, outputs, columns, layout), columns, window, horizon, TARGET_NAMES, layout)


def scaled_samples(
    rows: DataFrame, inputs: DataFrame, outputs: DataFrame, columns: Sequence[str], window: int, horizon: int, layout: Layout
) -> DataFrame:
    """The samples written out, one row each."""
    return pr.sequences(scaled_rows(rows, inputs, outputs, columns, layout), columns, window, horizon, TARGET_NAMES, layout)
