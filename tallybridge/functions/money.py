"""Money text and money arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

MONEY = "decimal(18,2)"

# Characters read as a minus sign, and as blanks inside a number.
MINUS_CLASS = "[\u2212\u2010\u2011\u2012\u2013\u2014]"
BLANK_CLASS = "[\\s\u00a0\u202f]"

def _compact(text: Column) -> Column:
    """ASCII minus, no blanks of any kind."""
    return F.regexp_replace(F.regexp_replace(text, MINUS_CLASS, "-"), BLANK_CLASS, "")


def _number(text: Column, shape: str = r"^[+-]?(\d+\.?\d*|\.\d+)$") -> Column:
    """``text`` as money when it has the given shape, half-up to the öre, else null."""
    return let(text, lambda t: F.when(t.rlike(shape), F.round(t.try_cast("decimal(28,10)"), 2).try_cast(MONEY)))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(_without(text, char))


def _comma_decimal(text: Column) -> Column:
    """Dots group, the comma is the decimal sign."""
    return F.translate(_without(text, "."), ",", ".")


def _statement(t: Column) -> Column:
    return _number(F.when(t.contains(","), _comma_decimal(t)).otherwise(t))


def _export(t: Column) -> Column:
    return F.coalesce(_number(_comma_decimal(t)), F.lit(0).cast(MONEY))


def _swedish(t: Column) -> Column:
    grouped = r"^[+-]?\d{1,3}(\.\d{3})+(,\d+)?$"
    return F.when(~t.contains(".") | t.rlike(grouped), _number(_comma_decimal(t), r"^[+-]?\d+(\.\d+)?$"))


def _mixed(body: Column) -> Column:
    """Both signs occur: the last one is the decimal sign."""
    comma_last = body.rlike(r",[^.,]*$")
    return F.when(comma_last, _comma_decimal(body)).otherwise(_without(body, ","))


def _any(t: Column) -> Column:
    def unsigned(body):
        several = (_count(body, ",") + _count(body, ".")) > 1
        one_group = body.rlike(r"^\d+[.,]\d{3}$")
        value = (
            F.when(~body.rlike(r"^[\d.,]+$"), F.lit(None))
            .when(body.contains(",") & body.contains("."), _mixed(body))
            .when(several | one_group, _without(body, ".,"))
            .otherwise(F.translate(body, ",", "."))
        )
        return _number(value)

    parsed = let(F.regexp_replace(t, r"^[+-]+", ""), unsigned)
    return F.when(t.startswith("-"), -parsed).otherwise(parsed).cast(MONEY)


def _archive(t: Column) -> Column:
    number = r"[-+]?(?:\d[\d.,]*|[.,]\d+)"

    def signed(num):
        def unsigned(body):
            value = (
                F.when(body.contains(",") & body.contains("."), _mixed(body))
                .when(_count(body, ",") > 1, _without(body, ","))
                .when(_count(body, ".") > 1, _without(body, "."))
                .otherwise(F.translate(body, ",", "."))
            )
            return _number(value)

        parsed = let(F.regexp_replace(num, r"^[+-]+|[.,]+$", ""), unsigned)
        return F.when(num.startswith("-"), -parsed).otherwise(parsed).cast(MONEY)

    exponent = t.rlike(rf"^[^\d.,+-]*{number}[eE][-+]?\d")
    return F.when(~exponent, let(F.regexp_extract(t, f"({number})", 1), signed))


_READERS = {"statement": _statement, "archive": _archive, "swedish": _swedish, "any": _any, "export": _export}
DIALECTS = tuple(_READERS)


def parse_money(text: Column, dialect: str) -> Column:
    """Localised money text as ``decimal(18,2)``; null where the dialect rejects the text.

    ``statement`` and ``export`` read a comma as the decimal sign and dots before it as grouping;
    ``swedish`` never reads a dot as the decimal sign; ``any`` and ``archive`` take the last sign
    as the decimal one, ``any`` reads a lone three-digit tail as thousands, and ``archive`` takes
    the first number found in the text.
    """
    if dialect not in _READERS:
        raise ValueError(f"unknown money dialect {dialect!r}; expected one of {DIALECTS}")
    return let(_compact(text), _READERS[dialect])


def format_money(amount: Column, currency: str | Column | None = "SEK", keep_sign: bool = False) -> Column:
    """``1234.5`` as ``1 234,50 SEK``: blank thousands, comma decimals, optional suffix."""
    value = amount if keep_sign else F.abs(amount)
    text = F.translate(F.format_number(value, 2), ",.", " ,")
    if currency is None or currency == "":
        return text
    suffix = F.lit(currency) if isinstance(currency, str) else currency
    return F.concat_ws(" ", text, suffix)


def half_up(value: Column) -> Column:
    """Two decimals, halves away from zero, as money."""
    return F.round(value, 2).cast(MONEY)
