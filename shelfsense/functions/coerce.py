"""Lenient conversions: text of unknown quality to typed values, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.functions.text import strip

# Spellings of true and false, and of the truthy texts of the cleaning stage.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")

# Java's parser would also take a type suffix such as ``1.5f``; only plain numbers are numbers here.
_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def drop_nan(value: Column) -> Column:
    """NaN and NULL are one missing notion."""
    return F.nanvl(value, F.lit(None).cast("double"))


def parse_number(value: Column) -> Column:
    """Text or number to double; unparsable and NaN become NULL."""
    text = strip(value.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_float(value: Column) -> Column:
    """As ``parse_number`` but with thousands separators and dollar signs removed."""
    return parse_number(F.regexp_replace(strip(value.cast("string")), "[,$]", ""))


def to_int(value: Column) -> Column:
    """Via double, so ``4.7`` is 4; overflow becomes NULL."""
    return parse_number(value).try_cast("bigint")


def to_bool(value: Column, numeric: bool = False) -> Column:
    """Known spellings only; ``numeric`` also takes any number, non-zero being true."""
    word = F.lower(strip(value.cast("string")))
    out = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if numeric:
        number = parse_number(value)
        out = out.when(number.isNotNull(), number != 0)
    return out


def verified_flag(value: Column) -> Column:
    """0/1 flag, missing and unknown texts are 0."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False)).cast("int")


def number_or(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(parse_number(value), F.lit(float(default)))


def int_or(value: Column, default: int = 0, kind: str = "bigint") -> Column:
    return F.coalesce(parse_number(value).try_cast(kind), F.lit(default).cast(kind))


def to_text(value: Column) -> Column:
    return value.cast("string")


def to_json_text(value: Column) -> Column:
    """Array, struct or map column as JSON text, NULL fields kept; scalar columns are passed by the caller as they are."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def millis_to_datetime(ms: Column) -> Column:
    """Epoch milliseconds to a UTC timestamp without zone, whatever the session zone; NULL stays NULL."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=(ms / F.lit(1000)).cast("decimal(18,6)"))


def datetime_to_millis(ts: Column) -> Column:
    """A timestamp to epoch milliseconds, reading its wall clock as UTC."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, ts.cast("timestamp_ntz"))


# By column type: numbers and booleans skip the detour over text ------------------------------------------


def number_column(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return drop_nan(F.col(name).cast("double"))
    return F.col(name).cast("double") if isinstance(kind, T.NumericType) else parse_number(F.col(name))


def int_column(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("bigint")
    return number_column(df, name).try_cast("bigint")


def bool_column(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.col(name) if isinstance(kind, T.BooleanType) else to_bool(F.col(name), numeric=True)


def flag_column(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.col(name), F.lit(False)).cast("int")
    return verified_flag(F.col(name))
