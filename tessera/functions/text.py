"""Column functions on text that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Runs of characters between (Unicode) white space; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def contains_any(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def glob_to_regex(glob: str) -> str:
    """A shell pattern (* and ?) as an anchored regular expression."""
    special = set(".^$+{}[]()|\\")
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob) + "$"


def issues(*checks: tuple[Column, Column]) -> Column:
    """The messages of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, message) for condition, message in checks]))


def mean_of(parts: Column, otherwise: float = 0.0) -> Column:
    """The mean of an array's non-null numbers."""
    own = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own)).otherwise(F.lit(otherwise))
