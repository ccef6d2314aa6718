"""Column expressions shared by the operators. All native, no Python UDF."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendspark import fixed

# white space as JavaScript's trim() sees it
TRIM_CHARS = " \t\r\n\u000b\u000c\u00a0\ufeff"


def moment(as_of: str | datetime | date | Column) -> Column:
    """The explicit 'now' of a job as a timestamp column."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it and
    however often the optimizer copies the expression (filter push-down does)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM_CHARS))


def is_blank(text: Column) -> Column:
    return F.coalesce(trim_all(text) == "", F.lit(True))


def display_name(first: Column, last: Column) -> Column:
    """Missing parts count as empty: an absent person gives one space."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def enum_rank(value: Column, members: list[str]) -> Column:
    """Declaration position of an enum value, for ordering; unknown gives null."""
    position = F.array_position(F.array(*[F.lit(m) for m in members]), value)
    return F.nullif(position, F.lit(0).cast("long"))


def leading_number(text: Column) -> Column:
    """Longest numeric prefix as double, null when there is none."""
    digits = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def percent_text(ratio: Column) -> Column:
    """0.2714 -> '27.1%'."""
    return F.concat(F.format_string("%.1f", ratio.cast("double") * 100), F.lit("%"))


def money_text(amount: Column, currency: Column | str = fixed.DEFAULT_CURRENCY) -> Column:
    """Currency text of the pt-BR locale: R$ 1.234,56 (no-break space)."""
    code = F.lit(currency) if isinstance(currency, str) else currency
    sign = code
    for name, symbol in fixed.CURRENCY_SIGNS.items():
        sign = F.when(code == name, F.lit(symbol)).otherwise(sign)
    minus = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    digits = F.translate(F.format_number(F.abs(amount), 2), ",.", ".,")
    return F.concat(minus, sign, F.lit("\u00a0"), digits)


def date_text(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")


def mean_of(amount: Column) -> Column:
    """Mean of a decimal as sum / count: exact sum, so independent of row order."""
    return F.sum(amount).cast("double") / F.count(amount)


def storage_key(folder: str, owner: Column, token: Column, extension: Column) -> Column:
    """Object key of an upload: folder/owner/token.ext (extension with its dot)."""
    name = F.concat(token, F.coalesce(extension, F.lit("")))
    return F.concat_ws("/", F.lit(folder), owner.cast("string"), name)


def receipt_key(url: Column, parts: int = 3) -> Column:
    """Key back from an object URL. parts=2 is the historic reading, which loses
    the folder name."""
    return F.substring_index(url, "/", -parts)


def one_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row of each key that is last in the order. Aggregates partially before the
    shuffle, so a key with very many rows costs one row per task; rows without a key go."""
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("one_key")).agg(
        F.max_by(whole, ranked).alias("one_row")).select("one_row.*")
