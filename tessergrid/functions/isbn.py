"""ISBN arithmetic as column expressions."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a citation labels an ISBN.
LABELLED = r"(?i)\bISBN(?:-1[03])?\s*:?\s*([0-9Xx][0-9Xx\- ]{8,20}[0-9Xx])\b"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _weighted(digits: Column, n: int, weight: Callable[[int], int]) -> Column:
    # spelled out: a fold over a sequence would call a lambda a digit
    return reduce(operator.add, [F.substring(digits, i, 1).try_cast("int") * weight(i) for i in range(1, n + 1)])


def check13(digits: Column) -> Column:
    """Check digit of twelve digits."""
    return (10 - _weighted(digits, 12, lambda i: 3 - 2 * (i % 2)) % 10) % 10


def check10(digits: Column) -> Column:
    """Check character of nine digits."""
    return bound((11 - _weighted(digits, 9, lambda i: 11 - i) % 11) % 11, lambda rest: F.when(rest == 10, F.lit("X")).otherwise(rest.cast("string")))


def canonical(value: Column) -> Column:
    """The ISBN-13 of a valid ISBN in any spelling, else an empty string."""

    def read(raw: Column) -> Column:
        ten, thirteen = raw.rlike(r"^[0-9]{9}[0-9X]$"), raw.rlike(r"^[0-9]{13}$")
        made = bound(F.concat(F.lit("978"), F.substring(raw, 1, 9)), lambda body: F.concat(body, check13(body).cast("string")))
        sound13 = check13(F.substring(raw, 1, 12)).cast("string") == F.substring(raw, 13, 1)
        return F.when(ten & (check10(F.substring(raw, 1, 9)) == F.substring(raw, 10, 1)), made).when(thirteen & sound13, raw).otherwise(F.lit(""))

    return bound(F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^0-9Xx]", "")), read)


def labelled(citation: Column) -> Column:
    """Valid ISBNs that a citation names with a label, in order, without repeats."""
    found = F.transform(F.regexp_extract_all(citation, F.lit(LABELLED)), canonical)
    return F.array_distinct(F.filter(found, lambda x: x != ""))
