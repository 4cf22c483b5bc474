"""Forecasts of windows: built-in baselines, a seeded stand-in, and a hook for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import array_mean, derive_seed
from plumbline.operators.windows import HORIZON


def _last(wins: DataFrame):
    """The context's last value: of ``past``, or as summaries have it."""
    return F.element_at("past", -1) if "past" in wins.columns else F.col("last")


def last_value(wins: DataFrame, horizon: int = HORIZON, method: str = "N0") -> DataFrame:
    return wins.withColumns({"method": F.lit(method), "seed": F.lit(0), "pred": F.array_repeat(_last(wins), horizon)})


def past_mean(wins: DataFrame, horizon: int = HORIZON, method: str = "M") -> DataFrame:
    return wins.withColumns({"method": F.lit(method), "seed": F.lit(0), "pred": F.array_repeat(array_mean(F.col("past")) if "past" in wins.columns else F.col("mean"), horizon)})


def seeded(wins: DataFrame, seeds: tuple[int, ...], horizon: int = HORIZON, method: str = "S", amplitude: float = 0.1) -> DataFrame:
    """A deterministic stand-in for a sampling model, for tests: last value plus seeded noise in units of d."""
    rows = wins.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    w = derive_seed(F.col("seed"), F.col("var_key"), F.col("sample_id"))
    value = _last(wins) + amplitude * F.col("d") * (w / 2147483646.0 - 0.5)
    return rows.withColumns({"method": F.lit(method), "pred": F.array_repeat(value, horizon)})


Model = Callable[[np.ndarray, int], np.ndarray]


def with_model(wins: DataFrame, load: Callable[[], Model], seeds: tuple[int, ...], method: str, draws: int = 100) -> DataFrame:
    """Forecast with a model: ``load()`` runs once a task and gives f(past as float32, seed) -> (draws, horizon) as float32.

    Each window is a batch of its own, whatever Arrow batch it comes in; draws become float64 before they are averaged.
    """
    rows = wins.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    rows = rows.withColumn("window_seed", derive_seed(F.col("seed"), F.col("var_key"), F.col("sample_id")))

    @F.pandas_udf("array<double>")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for past, seed in batches:
            yield pd.Series([np.asarray(model(np.asarray(p, dtype=np.float32), int(s)), dtype=np.float64).mean(axis=0).tolist() for p, s in zip(past, seed)])

    return rows.withColumns({"method": F.lit(method), "pred": predict("past", "window_seed")}).drop("window_seed")


def draw_mean(draws: DataFrame, key: str, values: str) -> DataFrame:
    """(key, h, y): mean over rows of each position of an array of draws, in double."""
    return draws.select(key, F.posexplode(values).alias("h", "x")).groupBy(key, "h").agg(F.avg(F.col("x").cast("double")).alias("y"))


def nested_draw_mean(samples):
    """Mean over the outer array of array<array<float>>, as array<double>."""
    first = F.transform(F.element_at(samples, 1), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(samples, 2, F.size(samples)), first, lambda a, row: F.zip_with(a, row, lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.size(samples))


def frequency_mask(wins: DataFrame, seed: int, p: float = 0.5, rate: float = 0.10, retries: int = 3) -> DataFrame:
    """Augmented training windows: with probability p, a share of the spectrum of context and target is masked, its mean kept.

    A result that is not finite is tried again, then the window stays as it is. Draws come from each window's own seed.
    """
    rows = wins.withColumn("window_seed", derive_seed(F.lit(seed), F.col("var_key"), F.col("sample_id"), "mask-v1"))

    @F.pandas_udf("array<double>")
    def mask(values: pd.Series, seeds: pd.Series) -> pd.Series:
        def one(x, s):
            x, rng = np.asarray(x, dtype=np.float64), np.random.default_rng(int(s))
            if rng.random() >= p:
                return x.tolist()
            for _ in range(1 + retries):
                f = np.fft.rfft(x)
                f[1:][rng.random(len(f) - 1) < rate] = 0
                y = np.fft.irfft(f, len(x))
                if np.isfinite(y).all():
                    return y.tolist()
            return x.tolist()

        return pd.Series([one(x, s) for x, s in zip(values, seeds)])

    rows = rows.withColumn("m", mask(F.concat("past", "target"), F.col("window_seed")))
    n = F.size("past")
    return rows.withColumns({"past": F.slice("m", F.lit(1), n), "target": F.slice("m", n + 1, F.size("target"))}).drop("m", "window_seed")
