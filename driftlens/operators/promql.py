"""Range functions, vector matching and bands of metric rules, on long tables (keys, ts in seconds, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _range(keys: tuple[str, ...], ts: str, lo: int, hi: int):
    return W.partitionBy(*keys).orderBy(ts).rangeBetween(lo, hi)


def increase(samples: DataFrame, keys: tuple[str, ...], window: int, extrapolate: bool = False, ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``increase`` over the left-open window that ends at each sample; counter resets count from zero.

    Extrapolated, the increase is stretched to the window: by up to half a step beyond the first sample where the
    window begins more than 1.1 steps before it, and never below a counter's zero.
    """
    order = W.partitionBy(*keys).orderBy(ts)
    last = F.lag(value).over(order)
    step = F.when(last.isNull(), 0.0).when(F.col(value) < last, F.col(value)).otherwise(F.col(value) - last)
    w = _range(keys, ts, -window + 1, 0)
    x = samples.withColumn("__d", step)
    x = x.withColumn("__n", F.count(value).over(w)).withColumn("__t", F.min(ts).over(w)).withColumn("__v", F.first(value).over(w))
    # the first sample of the window adds nothing: its step lies before it
    x = x.withColumn("__i", F.sum("__d").over(w) - F.first("__d").over(w))
    raw = F.when(F.col("__n") >= 2, F.col("__i"))
    if extrapolate:
        span = F.col(ts) - F.col("__t")
        mean = span / (F.col("__n") - 1)
        before = F.col("__t") - (F.col(ts) - window)
        to_start = F.when(before >= mean * 1.1, mean / 2).otherwise(before)
        zero = F.when((F.col("__i") > 0) & (F.col("__v") >= 0), span * F.col("__v") / F.col("__i"))
        to_start = F.when(zero < to_start, zero).otherwise(to_start)
        raw = F.when(F.col("__n") >= 2, F.col("__i") * (span + to_start) / span)
    return x.withColumn("increase", raw).drop("__d", "__n", "__t", "__v", "__i")


def rate(samples: DataFrame, keys: tuple[str, ...], window: int, extrapolate: bool = True, ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``rate``, the increase by second."""
    return increase(samples, keys, window, extrapolate, ts, value).withColumn("rate", F.col("increase") / window).drop("increase")


def histogram_quantile(q: float, buckets: DataFrame, keys: tuple[str, ...], le: str = "le", count: str = "count") -> DataFrame:
    """Quantile of cumulative buckets by linear interpolation; the last finite bound where it falls into +Inf."""
    rows = buckets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(le).cast("double").alias("le"), F.col(count).cast("double").alias("c")))).alias("b"))
    total = F.element_at(F.col("b"), -1)["c"]
    at = F.array_position(F.transform("b", lambda x: x["c"] >= q * total), True).cast("int")
    rows = rows.withColumn("at", at).withColumn("target", q * total).where(total > 0)
    here, before = F.element_at("b", F.col("at")), F.try_element_at(F.col("b"), F.col("at") - 1 + F.when(F.col("at") == 1, 100_000).otherwise(0))
    lo, c0 = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["c"], F.lit(0.0))
    value = F.when(here["le"] == float("inf"), lo).when((F.col("at") == 1) & (here["le"] <= 0), here["le"]).otherwise(lo + (here["le"] - lo) * (F.col("target") - c0) / (here["c"] - c0))
    return rows.select(*keys, value.alias("quantile"))


def over_time(samples: DataFrame, keys: tuple[str, ...], window: int, how: str, q: float = 0.5, offset: int = 0, ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``{how}_over_time`` over the window that ends ``offset`` before each sample: avg, sum, min, max, count,
    stddev (of the population), quantile, last."""
    w = _range(keys, ts, -offset - window + 1, -offset)
    how_to = {"avg": F.avg(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value), "count": F.count(value), "stddev": F.stddev_pop(value), "quantile": F.expr(f"percentile({value}, {q})"), "last": F.last(value, ignorenulls=True)}
    return samples.withColumn(f"{how}_over_time", how_to[how].over(w))


def absent_over_time(samples: DataFrame, as_of: int, window: int, ts: str = "ts") -> DataFrame:
    """One row (value 1) if no sample lies in the window, else none."""
    n = samples.where((F.col(ts) > as_of - window) & (F.col(ts) <= as_of)).agg(F.count(F.lit(1)).alias("n"))
    return n.where("n = 0").select(F.lit(1.0).alias("value"))


def vector_and(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def vector_unless(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def vector_or(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return left.unionByName(vector_unless(right, left, on))


def binary(left: DataFrame, right: DataFrame, on: tuple[str, ...], op, value: str = "value") -> DataFrame:
    """One-to-one arithmetic of two vectors with the same labels; ``op`` gets both values."""
    return left.join(right.select(*on, F.col(value).alias("__other")), list(on)).select(*on, op(F.col(value), F.col("__other")).alias(value))


def topk(samples: DataFrame, n: int, at: tuple[str, ...], by: Column, tie: str) -> DataFrame:
    """The n rows of each instant with the largest ``by``."""
    return samples.withColumn("__r", F.row_number().over(W.partitionBy(*at).orderBy(by.desc(), tie))).where(F.col("__r") <= n).drop("__r")


def matches(labels: Column, selectors: list[tuple[str, str, str]]) -> Column:
    """Label selectors (name, =|!=|=~|!~, value); patterns are anchored and a missing label is empty."""
    out = F.lit(True)
    for name, op, value in selectors:
        v = F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))
        hit = v == value if op in ("=", "!=") else F.rlike(v, F.lit(f"^(?:{value})$"))
        out &= ~hit if op.startswith("!") else hit
    return out


def label_replace(labels: Column, target: str, source: str, pattern: str, group: int = 1) -> Column:
    """Copies a group of an anchored match on one label into another."""
    v = F.coalesce(F.try_element_at(labels, F.lit(source)), F.lit(""))
    new = F.regexp_extract(v, f"^(?:{pattern})$", group)
    rest = F.map_filter(labels, lambda k, _: k != target)
    return F.when(F.rlike(v, F.lit(f"^(?:{pattern})$")), F.map_concat(rest, F.create_map(F.lit(target), new))).otherwise(labels)


def held_for(rows: DataFrame, keys: tuple[str, ...], seconds: int, step: int, ts: str = "ts", condition: str = "condition") -> DataFrame:
    """Rows at which the condition has held at every evaluation for the given time."""
    w = W.partitionBy(*keys).orderBy(ts)
    hit = rows.where(condition).withColumn("__g", (F.col(ts) / step).cast("long") - F.row_number().over(w))
    start = F.min(ts).over(W.partitionBy(*keys, "__g"))
    return hit.withColumn("__s", start).where(F.col(ts) - F.col("__s") >= seconds).drop("__g", "__s")


HOUR, DAY, WEEK = 3600, 86400, 604800


def adaptive_band(samples: DataFrame, keys: tuple[str, ...], margin: float = 0.5, sigmas: float = 2.0, ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds upper and lower of an adaptive band: short-term averages and deviations, a margin, and the same time a
    day and a week ago, whichever is widest; never below zero."""
    x = over_time(over_time(samples, keys, HOUR, "avg", ts=ts, value=value), keys, HOUR, "stddev", ts=ts, value=value)
    x = x.withColumn("__sd", F.when(F.col("stddev_over_time") > margin * F.col("avg_over_time"), F.col("stddev_over_time")))
    short = _range(keys, ts, -26 * HOUR + 1, 0)
    x = x.withColumn("__st_avg", F.avg("avg_over_time").over(short)).withColumn("__st_sd", F.avg("__sd").over(short))
    highs, lows = [F.col("avg_over_time") * (1 + margin)], [F.col("avg_over_time") * (1 - margin)]
    highs.append(F.col("__st_avg") + sigmas * F.col("__st_sd"))
    lows.append(F.col("__st_avg") - sigmas * F.col("__st_sd"))
    for back in (DAY, WEEK):
        w = _range(keys, ts, -back - HOUR // 2 + 1, -back + HOUR // 2)
        a, s = F.avg(value).over(w), F.stddev_pop(value).over(w)
        x = x.withColumn(f"__a{back}", a).withColumn(f"__s{back}", s)
        highs.append(F.col(f"__a{back}") + sigmas * F.col(f"__s{back}"))
        lows.append(F.col(f"__a{back}") - sigmas * F.col(f"__s{back}"))
    x = x.withColumn("upper", F.greatest(*highs)).withColumn("lower", F.greatest(F.least(*lows), F.lit(0.0)))
    return x.select(*samples.columns, "upper", "lower")


def robust_band(samples: DataFrame, keys: tuple[str, ...], margin: float = 0.5, factor: float = 2.0, ts: str = "ts", value: str = "value") -> DataFrame:
    """As ``adaptive_band`` with medians and absolute deviations from the median of their own time."""
    day = _range(keys, ts, -DAY + 1, 0)
    x = samples.withColumn("__m", F.expr(f"percentile({value}, 0.5)").over(day)).withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    x = x.withColumn("__mad", F.expr("percentile(__d, 0.5)").over(day))
    highs = [F.col("__m") + factor * F.col("__mad"), F.col("__m") * (1 + margin)]
    lows = [F.col("__m") - factor * F.col("__mad"), F.col("__m") * (1 - margin)]
    for back in (DAY, WEEK):
        w = _range(keys, ts, -back - HOUR // 2 + 1, -back + HOUR // 2)
        x = x.withColumn(f"__m{back}", F.expr(f"percentile({value}, 0.5)").over(w)).withColumn(f"__d{back}", F.expr("percentile(__d, 0.5)").over(w))
        highs.append(F.col(f"__m{back}") + factor * F.col(f"__d{back}"))
        lows.append(F.col(f"__m{back}") - factor * F.col(f"__d{back}"))
    x = x.withColumn("upper", F.greatest(*highs)).withColumn("lower", F.greatest(F.least(*lows), F.lit(0.0)))
    return x.select(*samples.columns, "upper", "lower")


def z_score(samples: DataFrame, keys: tuple[str, ...], window: int = WEEK, ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``z``: the distance from the window's mean in its deviations; null where nothing varies."""
    w = _range(keys, ts, -window + 1, 0)
    return samples.withColumn("z", (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0)))


def predicted(samples: DataFrame, keys: tuple[str, ...], weeks: int = 3, ts: str = "ts", value: str = "value") -> DataFrame:
    """Adds ``prediction``: the median of the same time in the last weeks, moved by the growth of the weekly mean."""
    x = samples.withColumn("__now", F.avg(value).over(_range(keys, ts, -WEEK + 1, 0)))
    names = []
    for k in range(1, weeks + 1):
        here = _range(keys, ts, -k * WEEK, -k * WEEK)
        then = F.avg(value).over(_range(keys, ts, -(k + 1) * WEEK + 1, -k * WEEK))
        x = x.withColumn(f"__p{k}", F.avg(value).over(here) + F.col("__now") - then)
        names.append(F.col(f"__p{k}"))
    ordered = F.array_sort(F.filter(F.array(*names), lambda v: v.isNotNull()))
    mid = (F.try_element_at(ordered, F.greatest(F.floor((F.size(ordered) + 1) / 2), F.lit(1)).cast("int")) + F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))) / 2
    return x.withColumn("prediction", mid).select(*samples.columns, "prediction")


def aggregate(samples: DataFrame, labels: tuple[str, ...], how: str = "sum", value: str = "value") -> DataFrame:
    """``sum|max|min|avg|count by (labels)`` of a vector whose labels are columns."""
    return samples.groupBy(*labels).agg({"sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg, "count": F.count}[how](value).alias(value))


def without(samples: DataFrame, dropped: tuple[str, ...], how: str = "sum", value: str = "value") -> DataFrame:
    """The same over all labels but some."""
    return aggregate(samples, tuple(c for c in samples.columns if c not in (*dropped, value)), how, value)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
