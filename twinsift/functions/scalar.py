"""Chainable scalar functions as native columns."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date pattern letters that differ from Spark's.
DATE_LETTERS = {"AP": "a", "ap": "a", "dddd": "EEEE", "ddd": "EEE", "zzz": "SSS"}
EXIF = "yyyy:MM:dd HH:mm:ss"
BLANK = r"[\s]+"


def title(c: Column) -> Column:
    """Upper-cases the first character of the string only; the rest becomes lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def mid(c: Column, start: str, length: str = "-1") -> Column:
    """From a 0-based position; a length of -1 takes the rest."""
    rest = F.substr(c, F.lit(int(start) + 1))
    return rest if int(length) < 0 else F.substring(c, int(start) + 1, int(length))


def pad(c: Column, n: str) -> Column:
    """Integers with leading zeros to ``n`` digits; longer ones stay whole."""
    text = c.cast("long").cast("string")
    return F.when(F.length(text) >= int(n), text).otherwise(F.lpad(text, int(n), "0"))


def camelsplit(c: Column) -> Column:
    return F.split(F.regexp_replace(c, "([a-z])(?=[A-Z])", "$1\u0001"), "\u0001")


def peek(c: Column, i: str) -> Column:
    """Item by 0-based index, from the end if negative; out of range is an error."""
    return F.element_at(c, int(i) + 1 if int(i) >= 0 else int(i))


def foreach(c: Column, chain: str) -> Column:
    """Applies functions joined by ``|`` to each item."""

    def each(x: Column) -> Column:
        for part in chain.split("|"):
            name, *args = part.split(":")
            x = FUNCTIONS[name](x, *args)
        return x

    return F.transform(c, each)


def date_pattern(pattern: str) -> str:
    """A pattern in Spark's letters; ``h`` counts to 24 unless an am or pm mark is asked for."""
    if "ap" not in pattern.lower():
        pattern = pattern.replace("h", "H")
    for old, new in DATE_LETTERS.items():
        pattern = pattern.replace(old, new)
    return pattern


def split(c: Column, by: str) -> Column:
    """Parts between the matches of a pattern; one that is no pattern is taken literally."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    try:
        spark._jvm.java.util.regex.Pattern.compile(by)
    except IllegalArgumentException:
        by = re.escape(by)
    return F.split(c, by)


def date(c: Column, pattern: str) -> Column:
    return F.coalesce(F.date_format(c, date_pattern(pattern)), F.lit(""))


def number_or_zero(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.coalesce(c.cast("string").try_cast(kind), F.lit(0).cast(kind))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "mid": mid,
    "trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "upper": F.upper,
    "lower": F.lower,
    "title": title,
    "pad": pad,
    "split": split,
    "join": lambda c, glue="": F.array_join(c, glue),
    "camelsplit": camelsplit,
    "push": lambda c, v: F.array_append(c, F.lit(v)),
    "pop": lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))),
    "shift": lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))),
    "peek": peek,
    "foreach": foreach,
    "add": lambda c, n: c.cast("long") + int(n),
    "date": date,
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "todate": lambda c: F.to_date(F.try_to_timestamp(c)),
    "totime": lambda c: F.date_format(F.try_to_timestamp(c), "HH:mm:ss"),
    "tostring": lambda c: c.cast("string"),
    "toint": number_or_zero("int"),
    "tofloat": number_or_zero("double"),
    "tobool": lambda c: F.coalesce(c.cast("string").try_cast("boolean"), F.lit(False)),
    "exifdate": lambda c: F.try_to_timestamp(c, F.lit(EXIF)),
}


def apply_chain(c: Column, chain: list[str]) -> Column:
    """Applies ``func,arg,arg`` steps in order; an unknown function is an error."""
    for step in chain:
        name, *args = step.split(",")
        if name not in FUNCTIONS:
            raise ValueError(f"unknown function: {name}")
        c = FUNCTIONS[name](c, *args)
    return c


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_literal(text: str) -> int:
    """Signed value of ``dct:<hex64>``; anything else is an error."""
    kind, _, digits = text.partition(":")
    if kind != "dct" or not digits:
        raise ValueError(f"not a hash: {text}")
    n = int(digits, 16)
    if n >> 64:
        raise ValueError(f"more than 64 bits: {text}")
    return n - (1 << 64) if n >> 63 else n


#: Lower end and width of each colour axis that is squeezed into 16 bits.
LUV = {"l": (0.0, 100.0), "u": (-134.0, 354.0), "v": (-140.0, 262.0)}


def luv_pack(c: Column, axis: str) -> Column:
    low, wide = LUV[axis]
    return F.least(F.greatest(F.floor((c - low) / wide * 65535), F.lit(0)), F.lit(65535)).cast("int")


def luv_unpack(c: Column, axis: str) -> Column:
    low, wide = LUV[axis]
    return c / 65535.0 * wide + low
