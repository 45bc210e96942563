"""Time buckets and time-weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def time_bucket(n: int, unit: str, ts: Column) -> Column:
    """Start of the bucket of n units that holds ts; weeks begin on Monday, months and years at their first day."""
    unit = unit.lower().rstrip("s")
    plain = ts.cast("timestamp_ntz")
    if unit in MICROS:
        width = n * MICROS[unit]
        micros = F.unix_micros(ts.cast("timestamp"))
        return F.timestamp_micros(micros - F.pmod(micros, F.lit(width))).cast("timestamp_ntz")
    if unit == "week":
        days = F.datediff(F.date_trunc("week", plain).cast("date"), F.lit("1970-01-05").cast("date"))
        return F.date_add(F.lit("1970-01-05").cast("date"), (days - F.pmod(days, F.lit(7 * n))).cast("int")).cast("timestamp_ntz")
    if unit in ("month", "year"):
        months = n * (12 if unit == "year" else 1)
        since = (F.year(plain) - 1970) * 12 + F.month(plain) - 1
        return F.add_months(F.lit("1970-01-01").cast("date"), (since - F.pmod(since, F.lit(months))).cast("int")).cast("timestamp_ntz")
    raise ValueError(f"no unit {unit!r}")


def index_weighted_avg(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "twa") -> DataFrame:
    """Trapezoid mean over readings in time order with equal spacing; a single reading is its own mean."""
    w = W.partitionBy(*keys).orderBy(*order)
    pairs = df.withColumn("_next", F.lead(value).over(w))
    mean = F.avg(F.when(F.col("_next").isNotNull(), (F.col(value) + F.col("_next")) / 2))
    return pairs.groupBy(*keys).agg(F.coalesce(mean, F.first(value)).alias(name))


def time_weighted_avg(df: DataFrame, keys: list[str], value: str, ts: str, tie: str, name: str = "twa") -> DataFrame:
    """Trapezoid mean over readings weighted by the seconds between them; without a span of time, the plain mean."""
    w = W.partitionBy(*keys).orderBy(ts, tie)
    seconds = (F.unix_micros(F.lead(ts).over(w).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    pairs = df.withColumn("_s", seconds).withColumn("_next", F.lead(value).over(w))
    area = F.sum((F.col(value) + F.col("_next")) / 2 * F.col("_s"))
    return pairs.groupBy(*keys).agg(F.coalesce(F.when(F.sum("_s") > 0, area / F.sum("_s")), F.avg(value)).alias(name))


def retained(df: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last days before the newest reading."""
    newest = df.agg(F.max(ts).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(ts) >= F.col("_newest") - F.expr(f"INTERVAL {int(days)} DAYS")).drop("_newest")
