"""Column expressions over 14-digit capture timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp_valid(ts: Column) -> Column:
    """14 digits, year 1990-2030, month 1-12, day 1-31, hour to 23, minute and second to 59; no calendar check."""
    part = lambda a, n: F.substring(ts, a, n).try_cast("int")
    fine = ts.rlike("^[0-9]{14}$") & part(1, 4).between(1990, 2030) & part(5, 2).between(1, 12) & part(7, 2).between(1, 31) & (part(9, 2) <= 23) & (part(11, 2) <= 59) & (part(13, 2) <= 59)
    return F.coalesce(fine, F.lit(False))


def stamp_parts(ts: Column) -> Column:
    """Struct of a timestamp's parts, weekday and readable form; ``error`` where it is none."""
    at = F.when(ts.rlike("^[0-9]{14}$"), F.try_to_timestamp(ts, F.lit("yyyyMMddHHmmss")))
    error = F.when(ts.isNull() | (F.length(ts) != 14), F.lit("Invalid timestamp format")).when(at.isNull(), F.lit("Failed to parse timestamp"))
    text = lambda f: F.date_format(at, f)
    return F.struct(
        ts.alias("timestamp"), text("yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"), F.hour(at).alias("hour"), F.minute(at).alias("minute"),
        F.second(at).alias("second"), text("EEEE").alias("weekday"), F.concat(text("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("human_readable"), error.alias("error"),
    )


def stamp_year(ts: Column) -> Column:
    """The year of a timestamp, null where its first four characters are no number."""
    return F.substring(ts, 1, 4).try_cast("int")
