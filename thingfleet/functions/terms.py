"""Built-in functions of graph queries whose rules differ from Spark's.

The others are Spark's own: strlen ``length``, ucase/lcase ``upper``/``lower``, strstarts,
strends and contains the column methods, concat ``concat``, coalesce ``coalesce``, if ``when``,
in ``isin``, bound ``isNotNull``, abs/ceil/floor/rand, year/month/day/hour/minute/second,
md5/sha1/sha2. An error is NULL; ``and``, ``or`` and ``not`` follow the same three-valued logic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import LANG_STRING, XSD

# ---------------------------------------------------------------- terms


def is_iri(kind: Column) -> Column:
    return kind == "iri"


def is_blank(kind: Column) -> Column:
    return kind == "bnode"


def is_literal(kind: Column) -> Column:
    return kind == "literal"


def is_numeric(number: Column) -> Column:
    return number.isNotNull()


def same_term(a: str, b: str) -> Column:
    """Equality of two term structs over value, kind, datatype and language."""
    parts = ["o", "o_kind", "o_dt", "o_lang"]
    return reduce(Column.__and__, [F.col(f"{a}.{p}").eqNullSafe(F.col(f"{b}.{p}")) for p in parts])


def lang(o_lang: Column) -> Column:
    return F.coalesce(o_lang, F.lit(""))


def datatype(o_dt: Column, o_lang: Column) -> Column:
    return F.when(o_lang.isNotNull(), LANG_STRING).otherwise(F.coalesce(o_dt, F.lit(XSD + "string")))


def _term(o: Column, kind: str, dt: Column | None = None, tag: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        o.cast("string").alias("o"),
        F.lit(kind).alias("o_kind"),
        (none if dt is None else dt).alias("o_dt"),
        (none if tag is None else tag).alias("o_lang"),
    )


def make_iri(text: Column) -> Column:
    return _term(text, "iri")


def make_bnode(label: Column) -> Column:
    return _term(F.concat(F.lit("_:"), label), "bnode")


def typed_literal(text: Column, dt: str) -> Column:
    return _term(text, "literal", F.lit(dt))


def lang_literal(text: Column, tag: Column) -> Column:
    return _term(text, "literal", F.lit(LANG_STRING), F.lower(tag))


def new_uuid() -> Column:
    """A fresh address; differs on every run."""
    return F.concat(F.lit("urn:uuid:"), F.uuid())


def new_struuid() -> Column:
    return F.uuid()


def lang_matches(tag: Column, wanted: Column | str) -> Column:
    """A language range against a tag: ``*`` any tag, else the tag or a prefix of its parts."""
    wanted = F.lower(F.lit(wanted) if isinstance(wanted, str) else wanted)
    tag = F.lower(F.coalesce(tag, F.lit("")))
    return (
        F.when(wanted == "*", tag != "")
        .when(tag == wanted, True)
        .otherwise(tag.startswith(F.concat(wanted, F.lit("-"))))
    )


# ---------------------------------------------------------------- strings


def substr(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    if length is None:
        return F.substr(text, start)
    return F.substr(text, start, F.lit(length) if isinstance(length, int) else length)


def str_before(text: Column, mark: str) -> Column:
    """Text before the first ``mark``; empty when it does not occur."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(F.when(text.isNotNull(), ""))


def str_after(text: Column, mark: str) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise(F.when(text.isNotNull(), ""))


def encode_for_uri(text: Column) -> Column:
    """Percent-encode all but letters, digits and ``-_.~``."""
    out = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(f"(?{flags}){pattern}" if flags else pattern)


def replace(text: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(text, f"(?{flags}){pattern}" if flags else pattern, by)


# ---------------------------------------------------------------- numbers and dates


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def now(run: str) -> Column:
    """The instant of the run, one value for the whole query."""
    return F.lit(run).cast("timestamp")


def tz(lexical: Column) -> Column:
    """The time zone part of a dateTime as written, empty when there is none."""
    return F.regexp_extract(lexical, r"(Z|[+-]\d\d:\d\d)$", 1)


def timezone_minutes(lexical: Column) -> Column:
    """Offset from UTC in minutes, NULL when none is written."""
    part = tz(lexical)
    hours = F.substr(part, F.lit(2), F.lit(2)).try_cast("int")
    minutes = F.substr(part, F.lit(5), F.lit(2)).try_cast("int")
    sign = F.when(part.startswith("-"), -1).otherwise(1)
    return F.when(part == "Z", 0).otherwise(sign * (hours * 60 + minutes))


# ---------------------------------------------------------------- hashes and casts


def digest(text: Column, name: str) -> Column:
    if name == "md5":
        return F.md5(text)
    if name == "sha1":
        return F.sha1(text)
    if name in ("sha256", "sha384", "sha512"):
        return F.sha2(text, int(name[3:]))
    raise ValueError(f"unknown digest {name}")


def number(text: Column) -> Column:
    """A number of any size: ``exact``, a decimal where one holds it, and ``approx``, the double; both NULL for
    what is no number."""
    looks = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    approx = F.when(looks, text.try_cast("double"))
    exact = F.when(looks, text.try_cast("decimal(38,18)"))
    return F.struct(F.when(exact.cast("double") == approx, exact).alias("exact"), approx.alias("approx"))


def cast_term(text: Column, target: str) -> Column:
    """Cast by name; a value that does not fit is NULL. :func:`number` holds numbers of every size."""
    kinds = {
        "integer": "decimal(38,0)",
        "decimal": "decimal(38,18)",
        "double": "double",
        "float": "float",
        "dateTime": "timestamp",
        "string": "string",
    }
    if target == "boolean":
        return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
    if target == "integer":
        # whole numbers only: the text must look like one
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("decimal(38,0)"))
    if target not in kinds:
        raise ValueError(f"unknown cast {target}")
    return text.try_cast(kinds[target])
