"""One sort key for terms of every kind, so that a variable may hold all of them at once.

The key is a text whose code-point order is the order of the terms: unbound, blank nodes, addresses, numbers,
plain texts, instants, texts with a language, truth values, all other literals. It sorts, partitions by range and
merges like any text column, upwards and downwards.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import XSD
from .documents import bind

# The numeric datatypes of XML Schema.
NUMERIC = (
    "integer decimal float double nonPositiveInteger negativeInteger long int short byte nonNegativeInteger "
    "unsignedLong unsignedInt unsignedShort unsignedByte positiveInteger"
).split()

_NUMBER = r"^\s*([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d{1,15}))?\s*$"
_DAY = r"^(-?\d{4,}-\d\d-\d\d)"
_ZONE = r"(Z|[+-]\d\d:\d\d)?$"
_INSTANT = _DAY + r"(T\d\d:\d\d:\d\d)(?:\.(\d+))?" + _ZONE
_END = "\0\0"


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def number_key(text: Column) -> Column:
    """A number as written, of any number of digits, exactly; NULL for what is none.

    Numbers of one value have one key, however they are written. Exponents have at most 15 digits. NaN comes
    before all others.
    """
    parts = F.struct(*(F.regexp_extract(text, _NUMBER, i).alias(f"p{i}") for i in range(1, 5)))
    finite = bind(parts, lambda p: _finite(p["p1"], p["p2"], p["p3"], p["p4"]))
    return (
        F.when(text == "NaN", "a")
        .when(text == "-INF", "b")
        .when(text.isin("INF", "+INF"), "f")
        .when(text.rlike(_NUMBER), finite)
    )


def _finite(sign: Column, whole: Column, fraction: Column, exponent: Column) -> Column:
    none = F.concat(whole, fraction) == ""
    whole = F.ltrim(whole, F.lit("0"))
    digits = F.ltrim(F.concat(whole, fraction), F.lit("0"))
    # the power of ten above the first digit that is not zero
    lead = F.when(whole != "", F.length(whole)).otherwise(F.length(digits) - F.length(fraction))
    power = lead + F.coalesce(exponent.try_cast("bigint"), F.lit(0))
    mantissa = F.rtrim(digits, F.lit("0"))
    bias = F.lit(2 * 10**15)
    up = F.concat(F.lit("e"), _padded(bias + power, 16), mantissa)
    # of two negative numbers the longer one is the smaller: a mark above all digits ends it
    mirrored = F.translate(mantissa, "0123456789", "9876543210")
    down = F.concat(F.lit("c"), _padded(bias - power, 16), mirrored, F.lit("~"))
    return F.when(none, None).when(mantissa == "", "d").when(sign == "-", down).otherwise(up)


def instant_key(text: Column) -> Column:
    """A moment or the beginning of a day, with every digit of its second; without a zone it is in UTC."""
    day = text.rlike(_DAY + _ZONE)
    pattern = lambda i, of=_INSTANT: F.regexp_extract(text, of, i)
    zone = F.when(day, pattern(2, _DAY + _ZONE)).otherwise(pattern(4))
    clock = F.when(day, "T00:00:00").otherwise(pattern(2))
    date = F.when(day, pattern(1, _DAY + _ZONE)).otherwise(pattern(1))
    zone = F.when(zone == "", "Z").otherwise(zone)
    seconds = F.unix_seconds(F.concat(date, clock, zone).try_cast("timestamp"))
    fraction = F.when(day, "").otherwise(F.rtrim(pattern(3), F.lit("0")))
    return F.concat(_padded(seconds + F.lit(10**15), 16), fraction)


def sort_key(value: Column, kind: Column, dt: Column | None = None, tag: Column | None = None) -> Column:
    """The key of a term; terms of one value have one key, so that the next sort term decides between them.

    A literal whose text doesn't fit its datatype is among the other literals, by datatype and then text. No key
    is NULL.
    """
    none = F.lit(None).cast("string")
    parts = {"value": value, "kind": kind, "dt": none if dt is None else dt, "tag": none if tag is None else tag}
    # the parts are computed once, however often the key looks at them
    term = F.struct(*(c.alias(n) for n, c in parts.items()))
    return bind(term, lambda t: _sort_key(*(t[n] for n in parts)))


def _sort_key(value: Column, kind: Column, dt: Column, tag: Column) -> Column:
    dt = F.coalesce(dt, F.lit(XSD + "string"))
    first = lambda text: F.replace(text, F.lit("\0"), F.lit("\0\1"))
    truth = F.when(value.isin("true", "1"), "1").when(value.isin("false", "0"), "0")
    number, instant = number_key(value), instant_key(value)
    known = (
        F.when(tag.isNotNull(), F.concat(F.lit("6"), first(value), F.lit(_END), F.lower(tag)))
        .when(dt == XSD + "string", F.concat(F.lit("4"), value))
        .when(dt.isin(*(XSD + n for n in NUMERIC)), F.concat(F.lit("3"), number))
        .when(dt.isin(XSD + "dateTime", XSD + "date"), F.concat(F.lit("5"), instant))
        .when(dt == XSD + "boolean", F.concat(F.lit("7"), truth))
    )
    other = F.concat(F.lit("8"), first(dt), F.lit(_END), value)
    return (
        F.when(value.isNull(), "0")
        .when(kind == "bnode", F.concat(F.lit("1"), value))
        .when(kind == "iri", F.concat(F.lit("2"), value))
        .otherwise(F.coalesce(known, other))
    )
