"""Column functions on strings that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of any sort, as a Java character class body.
BLANK = r"\s   -     　﻿"


def strip_blanks(c: Column) -> Column:
    """The string without outer blanks of any sort; null stays null."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def squeeze(c: Column) -> Column:
    """The string trimmed, with every inner run of blanks as one space."""
    return F.trim(F.regexp_replace(c, f"[{BLANK}]+", " "))


def plain_name(c: Column) -> Column:
    """A name for comparison: trimmed, single spaces, lower case. A blank name becomes null."""
    n = F.lower(squeeze(c))
    return F.when(n != "", n)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once per row, however often it is used and wherever the optimizer moves it."""
    return F.element_at(F.transform(F.array(value), then), 1)
