"""Value-level expressions. Every function returns a Column, so plans stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.constants import NULL_TOKENS, SIZE_UNITS
from tablewright.functions.kinds import column, is_numeric

# A decimal number as a whole cell. Spark's own cast also takes suffixes such as
# "1d", which would turn identifiers into numbers.
_INT_TEXT = r"^\s*[+-]?\d+\s*$"
_NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITY_TEXT = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN read as NULL; other types pass through untouched."""
    c = column(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return without_nan(df, name).cast("double")


def as_text(df: DataFrame, name: str) -> Column:
    """Text used when counting categories; booleans are spelled ``True``/``False``."""
    c = without_nan(df, name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.initcap(c.cast("string"))
    return c.cast("string")


def normalised(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    return df.select(*[without_nan(df, n).alias(n) for n in df.columns])


def portable(df: DataFrame) -> DataFrame:
    """NaN to NULL and temporal values to ISO text, as needed by row-sample outputs."""
    out = []
    for f in df.schema.fields:
        c = without_nan(df, f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def null_token_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NULL_TOKENS), c)


def text_is_integer(c: Column) -> Column:
    return c.rlike(_INT_TEXT) & c.try_cast("bigint").isNotNull()


def text_is_number(c: Column) -> Column:
    return c.rlike(_NUMBER_TEXT) | c.rlike(_INFINITY_TEXT)


def text_is_boolean(c: Column) -> Column:
    return F.lower(c).isin("true", "false")


def text_to_number(c: Column) -> Column:
    infinite = F.when(F.trim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(c.rlike(_NUMBER_TEXT), F.trim(c).try_cast("double")).when(c.rlike(_INFINITY_TEXT), infinite)


def payload_number(c: Column) -> Column:
    """Form-field text to a number: trimmed, non-empty and numeric, else NULL."""
    return text_to_number(F.trim(c))


def coerce_payload(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text fields of an incoming frame converted to the types a model was fitted on.

    Empty text and null tokens become NULL, numbers are parsed from trimmed
    text, other fields keep their text. Columns outside ``schema`` stay as they are.
    """
    wanted = {f.name: f.dataType for f in schema.fields}
    out = []
    for f in df.schema.fields:
        c = column(f.name)
        target = wanted.get(f.name)
        if target is not None and isinstance(f.dataType, T.StringType):
            if is_numeric(target):
                c = payload_number(c).cast(target)
            elif isinstance(target, T.StringType):
                c = null_token_to_null(c)
            else:
                c = null_token_to_null(c).try_cast(target)
        elif target is not None and is_numeric(target) and is_numeric(f.dataType):
            c = without_nan(df, f.name).cast(target)
        out.append(c.alias(f.name))
    return df.select(*out)


def size_text(num_bytes: float) -> str:
    """Bytes as text with one decimal, in steps of 1024."""
    step = sum(num_bytes >= 1024**i for i in range(1, len(SIZE_UNITS)))
    return f"{num_bytes / 1024**step:.1f} {SIZE_UNITS[step]}"


def size_text_column(num_bytes: Column) -> Column:
    b = num_bytes.cast("double")
    expr = None
    for step, unit in enumerate(SIZE_UNITS):
        text = F.concat(F.format_string("%.1f", b / F.lit(float(1024**step))), F.lit(f" {unit}"))
        last = step == len(SIZE_UNITS) - 1
        cond = F.lit(True) if last else b < F.lit(float(1024 ** (step + 1)))
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return expr
