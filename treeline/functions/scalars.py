"""Scalar functions as Columns: stamps, sizes, encodings, waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def conflict_stamp(seconds: Column) -> Column:
    """UTC, to the second; times before the epoch count as the epoch. Years of five digits have no sign. The session's time
    zone must be UTC."""
    at = F.timestamp_seconds(F.greatest(seconds, F.lit(0)))
    return F.concat(F.year(at).cast("string"), F.date_format(at, "-MM-dd HHmmss"))


def human_bytes(n: Column) -> Column:
    """Bytes, KiB or MiB, with one decimal; a tie goes to the even digit."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KiB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MiB", F.bround(n / (1 << 20), 1)))


def percent_encode(text: Column) -> Column:
    """RFC 3986: all but unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def backoff(failures: Column, first: int = 1, most: int = 30) -> Column:
    """Seconds to wait after so many failures in a row: doubling from `first` to `most`."""
    return F.least(F.lit(first) * F.pow(F.lit(2), F.least(failures, F.lit(30)) - 1), F.lit(most)).cast("bigint")


def strict_base64(text: Column) -> Column:
    """Bytes, or null where text is not RFC 4648 with padding; unused bits are not looked at."""
    shape = F.rlike(text, F.lit("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"))
    return F.when(shape, F.try_to_binary(text, F.lit("base64")))


def strict_unhex(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit("^([0-9a-f]{2})*$")), F.unhex(text))
