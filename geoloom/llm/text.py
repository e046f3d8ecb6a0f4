"""What the text operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that parts words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once for a row, however often ``then`` and its lambdas use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lower_ascii(c: Column) -> Column:
    """Lower-case A to Z and leave every other character alone."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text as an array; of a null or blank text the empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def bucket(c: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n
