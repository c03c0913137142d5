"""Date parsing and date parts.

A text is cut into the tokens of its date and the rest, its time of day. What
the tokens are (a year of four digits, a number, the name of a month) decides
by a small grammar which of them is the year, the month and the day, in column
expressions that stay in generated code. Of two leading numbers the first is the
month, unless it is above 12. Years of two digits are 1969 to 2068; a year
alone is a date from 1678 to 2261. A year above 9999 carries a sign and comes first, as ISO 8601 and
Spark's own rendering write it (+12345-01-31), up to +293999, where timestamps end. A zone or an offset is read and does not
move the date: the parts are those that are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.constants import MONTH_NAMES
from tablewright.functions.kinds import column, is_temporal

_WEEKDAY = r"^(mon|tue|wed|thu|fri|sat|sun|monday|tues|tuesday|wednesday|thur|thurs|thursday|friday|saturday|sunday)\.?,? +"
_TIME = r"^([0-9]{1,2}):([0-5][0-9])(?::([0-5][0-9](?:[.][0-9]{1,9})?))? ?(am|pm)? ?(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2})?$"


def parse_date_text(c: Column) -> Column:
    """The moment a text spells, as written, else NULL. Never raises, also under ANSI mode."""
    text = F.regexp_replace(F.lower(F.trim(c)), _WEEKDAY, "")
    # the time of day begins at a number with a colon behind it
    clock = F.regexp_extract(text, r"(?:t| +)([0-9]{1,2}:.*)$", 1)
    day = F.regexp_replace(text, r"(?:t| +)[0-9]{1,2}:.*$", "")
    day = F.regexp_replace(day, r"(?<=[0-9])(st|nd|rd|th)\b", "")
    tokens = F.split(F.regexp_replace(day, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3"), r" *[,./-] *| +")
    # as an array the parts are computed once
    return F.element_at(F.transform(F.array(tokens), lambda t: _moment(t, clock)), 1)


def _moment(t: Column, clock: Column) -> Column:
    size = F.size(t)
    a, b, c = (F.get(t, k) for k in range(3))
    year = lambda x: x.rlike("^[0-9]{4}$")
    late = lambda x: x.rlike("^[+](1?[0-9]{5}|2[0-8][0-9]{4}|29[0-3][0-9]{3})$")
    number = lambda x: x.rlike("^[0-9]{1,2}$")
    value = lambda x: x.cast("int")
    name = lambda x: F.element_at(_months(), F.regexp_replace(x, "[.]$", ""))
    full = lambda x: F.when(year(x), value(x)).when(number(x) & (F.length(x) == 2), value(x) + F.when(value(x) < 69, 2000).otherwise(1900))
    ymd = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    swapped = (value(a) > 12) & (value(b) <= 12)
    three = (
        F.when((year(a) | late(a)) & number(b) & number(c), ymd(value(a), value(b), value(c)))
        .when(year(a) & number(c), ymd(value(a), name(b), value(c)))
        .when(number(a) & number(b), ymd(full(c), F.when(swapped, value(b)).otherwise(value(a)), F.when(swapped, value(a)).otherwise(value(b))))
        .when(number(a), ymd(full(c), name(b), value(a)))
        .when(number(b), ymd(F.when(year(c), value(c)), name(a), value(b)))
    )
    first = F.lit(1)
    two = (
        F.when(year(a) & number(b), ymd(value(a), value(b), first))
        .when(number(a) & year(b), ymd(value(b), value(a), first))
        .when(year(b), ymd(value(b), name(a), first))
    )
    date = F.when(size == 3, three).when(size == 2, two).when((size == 1) & year(a) & value(a).between(1678, 2261), ymd(value(a), first, first))
    hour, minute, second, half = (F.regexp_extract(clock, _TIME, k) for k in range(1, 5))
    hour, second = hour.try_cast("int"), F.coalesce(second.try_cast("decimal(11,9)"), F.lit(0))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    zero = F.lit(0)
    told = clock != ""
    return F.try_make_timestamp_ntz(
        date["y"], date["m"], date["d"], F.when(told, hour).otherwise(zero), F.when(told, minute.try_cast("int")).otherwise(zero), F.when(told, second.cast("decimal(16,6)")).otherwise(F.lit(0).cast("decimal(16,6)"))
    )


def _months() -> Column:
    entries = {n: k for k, month in enumerate(MONTH_NAMES, 1) for n in (month, month[:3])} | {"sept": 9}
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def parsed_date(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if is_temporal(dtype):
        return column(name)
    if isinstance(dtype, T.StringType):
        return parse_date_text(column(name))
    return F.lit(None).cast("timestamp_ntz")


def date_parts(parsed: Column, prefix: str) -> list[Column]:
    """Year, month and weekday with Monday as 0."""
    return [
        F.year(parsed).alias(f"{prefix}_year"),
        F.month(parsed).alias(f"{prefix}_month"),
        F.weekday(parsed).alias(f"{prefix}_weekday"),
    ]
