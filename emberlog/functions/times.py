"""Timestamps of any known shape as seconds: epoch, or a relative counter below 1e9."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIVE_BELOW = 1e9
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,:](\d{1,6}))?)?\s*(Z|[+-]\d{2}:?\d{2})?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


#: Shapes of a date and time, and what brings them into the order year, month, day, time parts, zone, iso mark.
SHAPES = (
    (r"^(\d{4})-(\d{2})-(\d{2})[T ]\s*" + _TIME + "$", "$1|$2|$3|$4|$5|$6|$7|$8|iso"),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})[T: ]*\s*" + _TIME + "$", "$1|$2|$3|$4|$5|$6|$7||"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})[T: ]*\s*" + _TIME + "$", "$3|$1|$2|$4|$5|$6|$7||"),
    (r"^(\d{4})(\d{2})(\d{2})-" + _TIME + "$", "$1|$2|$3|$4|$5|$6|$7||"),
    (r"^(\d{1,2})[-/]([A-Za-z]{3})[-/](\d{4})[T: ]*\s*" + _TIME + "$", "$3|$2|$1|$4|$5|$6|$7||"),
    (r"^([A-Za-z]{3})\s+(\d{1,2})[T: ]*\s*" + _TIME + "$", "2000|$1|$2|$3|$4|$5|$6||"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3|0|0||||"),
    ("^" + _TIME + "$", "2000|1|1|$1|$2|$3|$4||"),
)


def parse(raw: Column) -> Column:
    """Seconds since the epoch (UTC unless an ISO offset says otherwise), or null.

    Numbers stand for themselves (but eight digits are a day); dates without a year are put in 2000, times without a
    date on its first day.  Offsets count only after an ISO date.
    """
    x = F.trim(raw)
    parts = F.coalesce(*(F.when(x.rlike(p), F.regexp_replace(x, p, order)) for p, order in SHAPES))
    # each step binds its input once: a one-element array, transformed
    stamped = F.transform(F.transform(F.array(parts), lambda c: F.split(c, r"\|")), _seconds)[0]
    return F.coalesce(stamped, F.when(x.rlike(r"^\d+(\.\d+)?$"), x.cast("double")))


def _seconds(p: Column) -> Column:
    number = lambda k: F.coalesce(F.try_to_number(F.nullif(p[k], F.lit("")), F.lit("999999")).cast("int"), F.lit(0))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(p[1])).cast("int")
    month = F.when(p[1].rlike("^[A-Za-z]"), named).otherwise(F.try_to_number(p[1], F.lit("99")).cast("int"))
    stamp = F.try_make_timestamp(number(0), month, number(2), number(3), number(4), number(5).cast("decimal(8,6)"))
    fraction = F.when(p[6] != "", F.rpad(p[6], 6, "0").cast("int") / 1e6).otherwise(0.0)
    zone = F.regexp_replace(p[7], ":", "")
    shift = F.when((p[8] == "iso") & zone.rlike("^[+-]"), F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60)).otherwise(0)
    return F.unix_seconds(stamp).cast("double") + fraction - shift


def show(ts: Column) -> Column:
    """'-', a relative counter, or a UTC time."""
    day = F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss")
    return F.when(ts.isNull(), F.lit("-")).when(ts < RELATIVE_BELOW, F.concat(F.format_string("%.3f", ts), F.lit("s"))).otherwise(day)


def second_of_day(ts: Column) -> Column:
    return F.pmod(F.floor(ts), F.lit(86400)).cast("long")
