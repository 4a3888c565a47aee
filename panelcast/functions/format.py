"""Report formatting as column expressions (decimal comma, percentage,
currency suffix, day/month/year dates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: currency symbols
CURRENCY_SYMBOLS = {"EUR": "EUR", "USD": "$", "GBP": "GBP", "JPY": "JPY"}


def _round(c: Column, d: int) -> Column:
    scale = float(10 ** d)
    return F.round(c * F.lit(scale)) / F.lit(scale)


def format_number(c: Column, decimals: int = 2) -> Column:
    """Rounded number with a decimal comma, fixed decimals; null -> ''."""
    s = F.format_string(f"%.{decimals}f", _round(c, decimals))
    return F.when(c.isNull(), F.lit("")).otherwise(F.regexp_replace(s, r"\.", ","))


def format_percentage(c: Column, decimals: int = 2) -> Column:
    """Values in [0, 1] are shares and are scaled by 100; then 'x.xx%'."""
    v = F.when((c >= 0) & (c <= 1), c * F.lit(100.0)).otherwise(c)
    return F.when(c.isNull(), F.lit("")).otherwise(
        F.concat(F.format_string(f"%.{decimals}f", _round(v, decimals)), F.lit("%")))


def format_currency(c: Column, currency: str = "EUR", decimals: int = 2) -> Column:
    return F.concat(format_number(c, decimals), F.lit(" " + CURRENCY_SYMBOLS.get(currency, currency)))


def format_date(c: Column, style: str = "short") -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd" if style == "iso" else "dd/MM/yyyy"), F.lit(""))


def metric_value(df: DataFrame, names: list[str]) -> Column:
    """The first of the named metrics that is there and not null; NaN if none is."""
    there = [F.col(f"`{n}`").cast("double") for n in names if n in df.columns]
    return F.coalesce(*there, F.lit(float("nan")))


def display_metric(c: Column, decimals: int = 3) -> Column:
    """A finite number with three decimals; anything else ``n/a``."""
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.when(finite, F.format_string(f"%.{decimals}f", _round(c, decimals))).otherwise(F.lit("n/a"))


def format_columns(df: DataFrame, spec: dict[str, dict]) -> DataFrame:
    """``format_dataframe``: {column: {"type": number|percentage|currency|date, ...}}."""
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        s = spec.get(name)
        if s is None:
            out.append(c)
            continue
        kind, d = s.get("type", "number"), int(s.get("decimals", 2))
        if kind == "percentage":
            out.append(format_percentage(c, d).alias(name))
        elif kind == "currency":
            out.append(format_currency(c, s.get("currency", "EUR"), d).alias(name))
        elif kind == "date":
            out.append(format_date(c, s.get("format", "short")).alias(name))
        else:
            out.append(format_number(c, d).alias(name))
    return df.select(*out)
