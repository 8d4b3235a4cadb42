"""Time: as-of clamps, half-open windows, coverage, window statistics and deterministic synthetic series."""

from __future__ import annotations

import hashlib
import math
import random
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from larkfield.runtime import ship_package
from larkfield.sources.errors import NoDataError

MOST_DAYS = 62
# Fixed values of the synthetic scenario: unit, anchor value, slope a day, amplitude, phase, noise, digits.
ANCHOR = date(2026, 9, 26)
CHANNELS = {
    "soil_moisture": ("%", 16.6, -0.75, 3.0, 105, 0.25, 1),
    "air_temp": ("°C", 27.6, -0.50, 9.0, 200, 0.45, 1),
    "humidity": ("%", 88.0, 1.10, 12.0, 15, 1.60, 1),
    "water_quality": ("mS/cm(EC)", 1.78, 0.020, 0.30, 130, 0.030, 2),
    "leaf_wetness": ("h/日", 6.5, 0.35, 2.5, 20, 0.40, 1),
}
OTHER_CHANNEL = ("单位未知", 20.0, 0.0, 2.0, 100, 0.50, 2)
BANDS = {
    "soil_moisture": "20.0 ~ 30.0 %（10cm 层体积含水率）", "air_temp": "18.0 ~ 32.0 °C（日均）", "humidity": "50.0 ~ 80.0 %",
    "water_quality": "EC 1.2 ~ 1.8 mS/cm", "leaf_wetness": "0 ~ 4.0 h/日",
}
INDICES = {"ndvi": (0.63, -0.010), "ndwi": (0.10, -0.008)}
SITES = {
    "FIELD-07": {"name": "东地块（演示档案）", "crop": "番茄", "area": "1.2 亩", "planting": "2026-05-12 定植（演示）"},
    "GH-03": {"name": "3 号棚（演示档案）", "crop": "黄瓜", "area": "0.6 亩", "planting": "2026-08-02 定植（演示）"},
}


def as_of(day: Column, limit: Column) -> Column:
    """ISO dates compare as text."""
    return F.least(day, limit)


def as_of_window(start: Column, end: Column, limit: Column) -> Column:
    """struct(start, end), both clamped; an inverted window collapses to its end."""
    s, e = F.least(start, limit), F.least(end, limit)
    return F.struct(F.least(s, e).alias("start"), e.alias("end"))


def in_window(ts: Column, start: Column, end: Column, now: Column) -> Column:
    """Half open to the day after ``end``; a row without a time counts only if the window reaches now."""
    after = F.to_timestamp(end) + F.expr("INTERVAL 1 DAY")
    return F.when(ts.isNull(), after > now).otherwise((ts >= F.to_timestamp(start)) & (ts < after))


def coverage_gap(rows: DataFrame, by: str, ts: str, start: Column) -> DataFrame:
    """(by, first_ts, gap): gap where a series begins after the window does."""
    return rows.groupBy(by).agg(F.min(ts).alias("first_ts")).withColumn("gap", F.coalesce(F.col("first_ts") > F.to_timestamp(start), F.lit(True)))


def window_stats(rows: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    """Latest value, mean to two places, least, greatest, sum and number of each group."""
    return rows.groupBy(*by).agg(
        F.max_by(value, order).alias("latest"), F.round(F.avg(value), 2).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"),
        F.round(F.sum(value), 2).alias("total"), F.count(value).alias("n"),
    )


def cumulative(rows: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Adds ``so_far``: the sum of a group's values up to each day, to two places (one row a day; a group is a channel's window)."""
    upto = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("so_far", F.round(F.sum(value).over(upto), 2))


def window_problem(start: Column, end: Column, most: int = MOST_DAYS) -> Column:
    """Why a closed window of ISO dates has no data; null where it is fine."""
    iso = lambda c: F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_date(c, "yyyy-MM-dd"))
    first, last = iso(start), iso(end)
    return (
        F.when(first.isNull() | last.isNull(), "no date")
        .when(last < first, "it ends before it starts")
        .when(F.datediff(last, first) >= most, f"over {most} days")
    )


def window_days(spark: SparkSession, start: str, end: str, most: int = MOST_DAYS) -> DataFrame:
    """(day) for every day of a closed window; NoDataError for bad dates, inverted and too long windows."""
    row = spark.range(1).select(F.lit(str(start)).alias("s"), F.lit(str(end)).alias("e"))
    problem = row.select(window_problem(F.col("s"), F.col("e"), most)).first()[0]
    if problem:
        raise NoDataError(f"window {start} ~ {end}: {problem}")
    return row.select(F.explode(F.sequence(F.col("s").cast("date"), F.col("e").cast("date"))).alias("day"))


def validate_as_of(day: str, today: date) -> str:
    """A canonical ISO date that isn't in the future."""
    if date.fromisoformat(day).isoformat() != day or date.fromisoformat(day) > today:
        raise ValueError(f"no valid as-of date: {day}")
    return day


def _random(site: str, channel: str, day: date) -> random.Random:
    key = f"{site}|{channel}|{day.isoformat()}".encode()
    return random.Random(int.from_bytes(hashlib.blake2s(key, digest_size=8).digest(), "big"))


def _offset(day: date) -> int:
    return max(-MOST_DAYS, min(MOST_DAYS, (day - ANCHOR).days))


def channel_value(site: str, channel: str, day: date) -> float:
    _, base, slope, amplitude, phase, noise, digits = CHANNELS.get(channel, OTHER_CHANNEL)
    wave = lambda d: math.sin(2 * math.pi * (d.timetuple().tm_yday - phase) / 365.25)
    drift = slope * _offset(day) + amplitude * (wave(day) - wave(ANCHOR))
    return round(base + drift + _random(site, channel, day).uniform(-1.0, 1.0) * noise, digits)


def index_value(site: str, index: str, day: date) -> float:
    base, slope = INDICES.get(index.lower(), (0.5, -0.005))
    return round(base + slope * _offset(day) + _random(site, f"rs_{index}", day).uniform(-1, 1) * 0.01, 3)


def weather_day(site: str, day: date) -> dict:
    r = _random(site, "weather", day)
    rain = round(r.choice([0.0, 0.0, 0.0, 0.6, 0.2]), 1)
    low, high = 20 + r.randint(0, 3), 28 + r.randint(0, 3)
    return {"rain": rain, "low": low, "high": high, "wind": r.choice([2, 2, 3])}


def _days(spark: SparkSession, start: str, end: str) -> DataFrame:
    ship_package(spark)
    return window_days(spark, start, end)


def sensor_readings(requests: DataFrame, start: str, end: str) -> DataFrame:
    """(site_id, channel, day, value, unit): a row a day for each request (site_id, channel)."""

    @F.pandas_udf(T.DoubleType())
    def value(site: pd.Series, channel: pd.Series, day: pd.Series) -> pd.Series:
        return pd.Series([channel_value(*x) for x in zip(site, channel, day, strict=True)], dtype=float)

    days = _days(requests.sparkSession, start, end)
    unit = F.lit(OTHER_CHANNEL[0])
    for name, spec in CHANNELS.items():
        unit = F.when(F.col("channel") == name, spec[0]).otherwise(unit)
    return requests.select("site_id", "channel").crossJoin(F.broadcast(days)).select("site_id", "channel", "day", value("site_id", "channel", "day").alias("value"), unit.alias("unit"))


def remote_sensing(requests: DataFrame, start: str, end: str) -> DataFrame:
    """(site_id, index, day, value); a value is made for every day."""

    @F.pandas_udf(T.DoubleType())
    def value(site: pd.Series, index: pd.Series, day: pd.Series) -> pd.Series:
        return pd.Series([index_value(*x) for x in zip(site, index, day, strict=True)], dtype=float)

    days = _days(requests.sparkSession, start, end)
    return requests.select("site_id", "index").crossJoin(F.broadcast(days)).select("site_id", "index", "day", value("site_id", "index", "day").alias("value"))


def weather(sites: DataFrame, start: str, end: str) -> DataFrame:
    """(site_id, day, rain, low, high, wind), with two days of forecast after the window marked as such."""

    @F.pandas_udf("rain double, low int, high int, wind int")
    def of(site: pd.Series, day: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([weather_day(*x) for x in zip(site, day, strict=True)], columns=["rain", "low", "high", "wind"])

    days = _days(sites.sparkSession, start, end)
    seen = sites.select("site_id").crossJoin(F.broadcast(days)).withColumn("w", of("site_id", "day")).select("site_id", "day", "w.*", F.lit(False).alias("forecast"))
    last = date.fromisoformat(end)
    ahead = [(last + timedelta(days=1), 18.0, 20, 26, 3), (last + timedelta(days=2), 6.0, 19, 25, 4)]
    ahead = sites.sparkSession.createDataFrame(ahead, "day date, rain double, low int, high int, wind int")
    return seen.unionByName(sites.select("site_id").crossJoin(F.broadcast(ahead)).withColumn("forecast", F.lit(True)))


def camera_ratio(site: str) -> int:
    """Percent of leaf area in the imagery scenario."""
    return 10 + _random(site, "vision", ANCHOR).randint(0, 8)


def site_profile(site: str) -> dict:
    """A demonstration site's profile by upper-cased id; empty for any other."""
    return dict(SITES.get(str(site).strip().upper(), {}))


def reference_band(channel: Column) -> Column:
    out = F.lit("未建模")
    for name, band in BANDS.items():
        out = F.when(channel == name, band).otherwise(out)
    return out
