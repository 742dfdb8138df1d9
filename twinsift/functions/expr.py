"""Filter expressions as native columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.props import expression

_OPERATORS = ("==", "!=", "<=", ">=", "=", "<", ">", "~", "!")
_COMPARE = {
    "==": lambda a, b: a == b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "~": lambda a, b: a.cast("string").contains(b.cast("string")),
    "!": lambda a, b: ~a.cast("string").contains(b.cast("string")),
}
NUMERIC = {"byte", "short", "int", "integer", "long", "float", "double", "tinyint", "smallint", "bigint"}


def _needle(value: Column, group: str | None) -> Column:
    if group is None:
        raise ValueError("a needle is only there in grouped results")
    return F.first_value(value).over(Window.partitionBy(group).orderBy("pos"))


def _term(value: Column, kind: str, text: str, group: str | None) -> Column:
    if text in ("%null", "!%null"):
        return value.isNull() if text == "%null" else value.isNotNull()
    if text in ("%empty", "!%empty"):
        empty = F.coalesce(value.cast("string"), F.lit("")) == ""
        return empty if text == "%empty" else ~empty
    if text.startswith(":"):
        return value.cast("string").rlike(text[1:])
    if text.startswith("%") and text != "%needle":
        if kind not in NUMERIC:
            raise ValueError("a difference to the needle needs a number")
        op = next(o for o in _OPERATORS if text[1:].startswith(o))
        return _COMPARE[op](F.abs(value - _needle(value, group)), F.lit(float(text[1 + len(op) :])))
    op = next((o for o in _OPERATORS if text.startswith(o)), "")
    right = text[len(op) :]
    if right == "%needle":
        return _COMPARE[op or "=="](value, _needle(value, group))
    if kind in NUMERIC and op not in ("~", "!"):
        float(right)  # a right side that is no number is an error now, not later
    return _COMPARE[op or "=="](value, F.lit(right).cast(kind if op not in ("~", "!") else "string"))


def predicate(df: DataFrame, prop: str | Column, text: str, group: str | None = None) -> Column:
    """``text`` such as ``>5&&<10`` as a condition on a property; the right side takes the left side's type.

    ``&&`` and ``||`` go from left to right without precedence and end the evaluation at once: false before
    ``&&`` is false, true before ``||`` is true, whatever follows. Null comparisons are false.
    """
    value = expression(prop) if isinstance(prop, str) else prop
    kind = df.select(value.alias("v")).schema["v"].dataType.simpleString()
    parts = re.split(r"(&&|\|\|)", text)
    terms = [F.coalesce(_term(value, kind, t, group), F.lit(False)) for t in parts[::2]]
    out = terms[-1]
    for term, op in zip(reversed(terms[:-1]), reversed(parts[1::2])):
        out = F.when(~term, F.lit(False)).otherwise(out) if op == "&&" else F.when(term, F.lit(True)).otherwise(out)
    return out


def with_any(df: DataFrame, conditions: Sequence[tuple[str | Column, str]], invert: bool = False, group: str | None = None) -> DataFrame:
    """Keeps rows that meet any of the conditions (none of them if inverted); chain calls for a conjunction.

    With ``group`` the needle of each group (``pos`` 0) always stays, and groups left with less than two rows
    vanish.
    """
    hit = F.lit(False)
    for prop, text in conditions:
        hit = hit | predicate(df, prop, text, group)
    keep = ~hit if invert else hit
    if group is None:
        return df.where(keep)
    marked = df.withColumn("_keep", keep | (F.col("pos") == 0)).where("_keep").drop("_keep")
    return at_least(marked, group, 2)


def at_least(df: DataFrame, group: str, n: int) -> DataFrame:
    """Groups of at least ``n`` rows."""
    size = F.count(F.lit(1)).over(Window.partitionBy(group))
    return df.withColumn("_n", size).where(F.col("_n") >= n).drop("_n")
