"""Blank handling shared by readers and operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, plus the four information separators that str.strip removes as well.
_EDGE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"
_NUMBER = r"^[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip_blanks(c: Column) -> Column:
    """Without surrounding blanks of any kind (tab, line break, no-break space...)."""
    return F.regexp_replace(c, _EDGE, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_blanks(c), F.lit(""))


def point_number(c: Column) -> Column:
    """The finite decimal number with a point (exponent allowed) that ``c`` spells, else null."""
    s = strip_blanks(c)
    v = F.when(s.rlike(_NUMBER), s.try_cast("double"))
    return F.when(F.abs(v) < F.lit(float("inf")), v)
