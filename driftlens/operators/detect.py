"""Robust seasonal scores: seasonal medians, MAD scales with floors, signed deviations and bands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAD = 1.4826


@dataclass(frozen=True)
class Params:
    """Buckets per season, seasons looked back, buckets of the cold window; floors and threshold."""

    season: int = 24
    seasons: int = 3
    lookback: int = 24
    threshold: float = 4.0
    abs_floor: float = 1e-9
    rel_floor: float = 0.05
    poisson: bool = False
    cold_min: int = 3
    least: int = 10


def seasonal_expected(series: DataFrame, keys: tuple[str, ...], p: Params) -> DataFrame:
    """Adds ``seasonal``: the median of the same bucket in the previous seasons, by one shifted equi-join."""
    shifted = series.where("value is not null").select(*keys, F.explode(F.array(*(F.lit(k) for k in range(1, p.seasons + 1)))).alias("k"), "bucket", "value")
    shifted = shifted.select(*keys, (F.col("bucket") + F.col("k") * p.season).alias("bucket"), "value")
    return series.join(shifted.groupBy(*keys, "bucket").agg(F.median("value").alias("seasonal")), [*keys, "bucket"], "left")


def _mad(values) -> F.Column:
    mid = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)) / 2
    ordered = F.array_sort(values)
    return F.element_at(F.transform(F.array(mid(ordered)), lambda m: mid(F.array_sort(F.transform(values, lambda v: F.abs(v - m))))), 1)


def score(series: DataFrame, keys: tuple[str, ...] = ("key",), p: Params = Params(), wide: int = 400) -> DataFrame:
    """(keys, bucket, observed, expected, scale, score, lower, upper, is_seasonal) of the buckets that can be scored.

    Expected is the seasonal median, else the median of the cold window. The scale is the scaled MAD of the residuals
    of one season before the bucket, ten at least, with floors. Seasons of up to ``wide`` buckets use window frames in
    the JVM; longer ones go series by series through one sorted pass in numpy, as frames then copy too much.
    """
    if p.season > wide:
        return score_in_python(series, keys, p)
    x = seasonal_expected(series, keys, p).withColumn("r", F.col("value") - F.col("seasonal"))
    order = W.partitionBy(*keys).orderBy("bucket")
    cold, season = order.rangeBetween(-p.lookback, -1), order.rangeBetween(-p.season, -1)
    x = x.select(
        *keys, "bucket", "value", "seasonal",
        F.expr("percentile(value, 0.5)").over(cold).alias("cold"), F.count("value").over(cold).alias("cold_n"),
        F.collect_list("r").over(season).alias("rs"), F.collect_list("value").over(season).alias("vs"),
    )
    expected = F.coalesce("seasonal", F.when(F.col("cold_n") >= p.cold_min, F.col("cold")))
    x = x.withColumn("expected", expected).withColumn("frame", F.when(F.col("seasonal").isNotNull(), F.col("rs")).otherwise(F.col("vs")))
    x = x.where(F.col("value").isNotNull() & F.col("expected").isNotNull() & (F.size("frame") >= p.least))
    return _finish(x.withColumn("mad", MAD * _mad(F.col("frame"))), keys, p)


def _finish(x: DataFrame, keys: tuple[str, ...], p: Params) -> DataFrame:
    floors = [F.col("mad"), F.lit(p.abs_floor), p.rel_floor * F.abs("expected")]
    if p.poisson:
        floors.append(F.sqrt(F.greatest("expected", F.lit(1.0))))
    x = x.withColumn("scale", F.greatest(*floors))
    return x.select(
        *keys, "bucket", F.col("value").alias("observed"), "expected", "scale", ((F.col("value") - F.col("expected")) / F.col("scale")).alias("score"),
        (F.col("expected") - p.threshold * F.col("scale")).alias("lower"), (F.col("expected") + p.threshold * F.col("scale")).alias("upper"), F.col("seasonal").isNotNull().alias("is_seasonal"),
    )


def score_series(bucket: np.ndarray, value: np.ndarray, p: Params, scale_every: int = 1) -> list[tuple]:
    """(bucket, value, seasonal, expected, mad) of one series sorted by bucket; NaN is missing.

    With ``scale_every`` above one a MAD is kept for so many buckets as long as the mode stays the same.
    """
    at = {int(b): float(v) for b, v in zip(bucket, value, strict=True) if not np.isnan(v)}

    def seasonal(b: int) -> float | None:
        got = [at[b - k * p.season] for k in range(1, p.seasons + 1) if b - k * p.season in at]
        return float(np.median(got)) if got else None

    expected = {b: seasonal(b) for b in at}
    out, kept = [], None
    for b, v in at.items():
        e = expected[b]
        mode = e is not None
        if not mode:
            near = [at[x] for x in range(b - p.lookback, b) if x in at]
            if len(near) < p.cold_min:
                continue
            e = float(np.median(near))
        if kept and kept[0] == mode and 0 <= b - kept[1] < scale_every:
            mad = kept[2]
        else:
            span = [x for x in range(b - p.season, b) if x in at]
            r = np.array([at[x] - expected[x] for x in span if expected[x] is not None] if mode else [at[x] - e for x in span])
            if len(r) < p.least:
                continue
            mad = MAD * float(np.median(np.abs(r - np.median(r))))
            kept = (mode, b, mad)
        out.append((b, v, e if mode else None, e, mad))
    return out


def score_in_python(series: DataFrame, keys: tuple[str, ...], p: Params, scale_every: int = 1) -> DataFrame:
    """The same scores, one series at a time; also the form with cached scales."""
    fields = {f.name: f.dataType.simpleString() for f in series.schema.fields}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bucket")
        rows = score_series(group["bucket"].to_numpy(), group["value"].to_numpy(float), p, scale_every)
        out = pd.DataFrame(rows, columns=["bucket", "value", "seasonal", "expected", "mad"])
        for k in keys:
            out[k] = group[k].iloc[0]
        return out[[*keys, "bucket", "value", "seasonal", "expected", "mad"]]

    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "bucket long, value double, seasonal double, expected double, mad double"])
    return _finish(series.groupBy(*keys).applyInPandas(run, schema), keys, p)


def anomalous(score_col: str = "score", direction: str | None = None, threshold: float = 4.0, min_volume: float = 0.0) -> F.Column:
    """Whether a score counts: enough volume, and on the side (``up``, ``down``, none: both) beyond the threshold."""
    side = {"up": F.col(score_col) >= threshold, "down": F.col(score_col) <= -threshold, None: F.abs(score_col) >= threshold}[direction]
    return (F.greatest("observed", "expected") >= min_volume) & side
