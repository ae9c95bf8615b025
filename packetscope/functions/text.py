"""Text and number cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetscope.constants import SENTINELS


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def flag(condition: Column) -> Column:
    """Condition as 0/1 INT; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def blank_to_null(c: Column) -> Column:
    return F.when(~c.isin(SENTINELS), c)


def has_text(c: Column) -> Column:
    """True for a value that is neither NULL nor empty."""
    return c.isNotNull() & (c.cast("string") != "")


def to_number(c: Column) -> Column:
    """Number of a text or numeric column, 0 when it is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def to_int(c: Column) -> Column:
    """Whole part of a number in text; ``80.0`` is 80, bad text is NULL."""
    return c.try_cast("double").try_cast("int")


def to_long(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def mentions(c: Column, needles: list[str]) -> Column:
    """True if the lower-cased text holds any of the needles."""
    lowered = F.lower(c)
    return any_of([lowered.contains(n) for n in needles])


def protocol_mentions(protocol: Column, name: str) -> Column:
    return flag(F.upper(protocol).contains(name))


def percent(n: Column, total: Column, digits: int) -> Column:
    """Share of ``n`` in ``total``; NULL when there is nothing to divide by."""
    return F.round(F.lit(100.0) * n / F.nullif(total, F.lit(0)), digits)


def readable_seconds(seconds: Column) -> Column:
    """``12.3 seconds``, ``4 minutes 5 seconds`` or ``2 hours 7 minutes``."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.format_string("%.1f seconds", seconds))
        .when(
            seconds < 3600,
            F.format_string("%d minutes %d seconds", F.floor(whole / 60), whole % 60),
        )
        .otherwise(
            F.format_string(
                "%d hours %d minutes", F.floor(whole / 3600), F.floor((whole % 3600) / 60)
            )
        )
    )


def hex_text(n: Column) -> Column:
    """``0x1f``; zero and NULL give empty text."""
    return F.when(n != 0, F.concat(F.lit("0x"), F.lower(F.hex(n)))).otherwise(F.lit(""))


def safe_decode(raw: Column) -> Column:
    """UTF-8 text of a binary column, invalid bytes dropped."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def domain(query: Column) -> Column:
    return F.lower(F.coalesce(query, F.lit("")))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as DOUBLE, read off the clock fields.

    Works the same for TIMESTAMP and TIMESTAMP_NTZ and whatever the session zone is.
    """
    return (
        F.unix_date(ts.cast("date")).cast("double") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.date_part(F.lit("SECOND"), ts).cast("double")
    )


def utc_clock(ts: Column) -> Column:
    """TIMESTAMP as the TIMESTAMP_NTZ a UTC clock showed, whatever the session zone is."""
    return F.convert_timezone(None, F.lit("UTC"), ts.cast("timestamp_ntz"))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 as BIGINT, read off the clock fields."""
    whole = (
        F.unix_date(ts.cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
    )
    second = F.date_part(F.lit("SECOND"), ts) * F.lit(1000000).cast("decimal(8,0)")
    return whole * 1000000 + second.cast("bigint")
