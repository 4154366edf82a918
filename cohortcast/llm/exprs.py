"""Column helpers shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the word pattern [^\x20\x09-\x0D]+, as Java's regular expressions write it.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """body(value), where value is computed once a row and not once for each element of a function inside body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters other than white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def row_key(*cols) -> Column:
    """128 bits of hashes that tell rows apart by value; rows equal in these columns share them, and their results."""
    return F.struct(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def packed(columns: list[str]) -> Column:
    """The columns as one struct, so that no name of theirs can clash with an operator's own; `unpacked` takes them out."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("none"))


def unpacked(struct: str, columns: list[str]) -> list[Column]:
    return [F.col(struct).getField(c).alias(c) for c in columns]
