"""Text expressions that several operators share. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
PLACEHOLDERS = ("", "unknown", "none", "n/a", "anonymous")

_EDGES = r"(?U)^\s+|\s+$"
WORD = r"(?U)[\p{L}\p{N}]+"


def stripped(c: Column) -> Column:
    """Without outer white space of any kind (``trim`` removes blanks only)."""
    return F.regexp_replace(c, _EDGES, "")


def folded(c: Column) -> Column:
    """Stripped and lower-cased; the form in which domains, authors and papers are compared."""
    return F.lower(stripped(c))


def known(c: Column) -> Column:
    """The folded text, NULL if it stands for a missing value."""
    return F.when(~folded(c).isin(*PLACEHOLDERS), folded(c))


def words(c: Column) -> Column:
    """All maximal runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))
