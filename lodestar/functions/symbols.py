"""What a symbol id tells: "local N", or a scheme, a module and a descriptor separated by spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.split() has it.
_BLANK = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE, _WORD = f"[{_BLANK}]", f"[^{_BLANK}]+"


def is_local(symbol: Column) -> Column:
    return symbol.startswith("local ")


def name(symbol: Column) -> Column:
    """The readable name: the last word once `#`, `.` and then `()` count as spaces, without backticks around it.

    The id itself if nothing is left; `local N` gives `local_N`.
    """
    spaced = symbol
    for mark in ("#", ".", "()"):
        spaced = F.replace(spaced, F.lit(mark), F.lit(" "))
    last = F.regexp_extract(spaced, f"({_WORD}){_SPACE}*$", 1)
    bare = F.nullif(F.btrim(last, F.lit("`.")), F.lit(""))
    return F.when(is_local(symbol), F.concat(F.lit("local_"), F.substring(symbol, F.lit(7), F.length(symbol)))).otherwise(F.coalesce(bare, symbol))


def module(symbol: Column) -> Column:
    """The second word of an id, unless it is a lone `#` or `.`; null for local symbols and ids of one word."""
    second = F.nullif(F.regexp_extract(symbol, f"^{_SPACE}*{_WORD}{_SPACE}+({_WORD})", 1), F.lit(""))
    return F.when(~is_local(symbol) & ~second.isin("#", "."), second)


def member(label: Column, kind: Column) -> Column:
    """A member as shown: functions get parentheses."""
    return F.when(kind == "function", F.concat(label, F.lit("()"))).otherwise(label)


def has_role(roles: Column, mask: int) -> Column:
    return roles.bitwiseAND(F.lit(mask)) != 0


def location(path: Column, line: Column, context: Column | None = None) -> Column:
    """`file:line`, and ` (in context)` where there is one."""
    at = F.concat_ws(":", path, line.cast("string"))
    return at if context is None else F.concat(at, F.coalesce(F.concat(F.lit(" (in "), F.nullif(context, F.lit("")), F.lit(")")), F.lit("")))
