"""Column expressions of the profile and the checks; all of them run in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind(t: T.DataType) -> str:
    """numeric, temporal, boolean, text, nested or other."""
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return "nested" if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def nonfinite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def finite(df: DataFrame, name: str) -> Column:
    """The column with NaN and infinities as null."""
    c = col(name)
    return F.when(~nonfinite(c), c) if floating(df, name) else c


def significant_digits(c: Column) -> Column:
    """Digits of the shortest decimal text that reads back as the value.

    Counted as in a text that writes 1e-4 to 1e16 in full and always shows one decimal, so 5.0 has two. Plain
    string functions only; a value is written as text once for each of its uses here, so keep it out of
    expressions that repeat it.
    """
    s = F.abs(c.cast("double")).cast("string")
    cut = F.instr(s, "E")
    plain = F.length(F.ltrim(F.translate(s, ".", ""), F.lit("0")))
    count = F.length(F.rtrim(F.translate(F.substring_index(s, "E", 1), ".", ""), F.lit("0")))
    power = F.substring_index(s, "E", -1).try_cast("int")
    written = F.when((power >= 16) | (power < -4), count).when(power >= count - 1, power + 2).otherwise(count)
    return F.when(c == 0, 0).when(cut == 0, plain).otherwise(written).cast("long")


def as_date(t: Column) -> Column:
    return t.cast("date")


def month_number(c: Column, tokens: tuple[str, ...]) -> Column:
    """The month whose English abbreviation a label contains, the first that matches."""
    out = F.lit(None).cast("int")
    for i in range(len(tokens), 0, -1):
        out = F.when(F.upper(c).contains(tokens[i - 1]), i).otherwise(out)
    return out


def assembled_date(year: Column, month: Column, day: Column | None = None, dekad: Column | None = None) -> Column:
    """A date from its parts; null where they make none."""
    y, m = year.cast("int"), month.cast("int")
    first = F.try_make_timestamp(y, m, (day.cast("int") if day is not None else F.lit(1)), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.date_add(first, ((dekad.cast("int") - 1) * 10)) if dekad is not None else first
