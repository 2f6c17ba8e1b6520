"""Pattern matching on ids as an index file's own engine does it: LIKE that folds A-Z only, user text unescaped.

`%` and `_` in user text are wildcards, a backslash is a plain character. Folding is by translate(), since lower() and
ILIKE fold letters outside ASCII, too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def like(text: Column, pattern: str) -> Column:
    folded = pattern.translate(str.maketrans(UPPER, LOWER))
    return fold(text).like(folded.replace("\\", "\\\\"))


def contains(symbol: Column, wanted: str) -> Column:
    return like(symbol, f"%{wanted}%")


def found(symbol: Column, query: str) -> Column:
    """As contains(), with `*` for any text. It is never anchored."""
    return contains(symbol, query.replace("*", "%"))


def type_rank(symbol: Column, wanted: str) -> Column:
    """0 if the id ends in the wanted text as a type (`#` follows), else 1. The text is taken as it is, `*` and all."""
    return F.when(like(symbol, f"%{wanted}#"), 0).otherwise(1)


def in_module(symbol: Column, wanted: str) -> Column:
    return like(symbol, f"% {wanted} %")
