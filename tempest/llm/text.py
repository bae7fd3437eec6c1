"""Column helpers shared by the training-data operators (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the task: white space characters and the word pattern built on them.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of the whole text (null: 0), as long."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def sha256_hex(text: Column) -> Column:
    """Bare lower-case hex SHA-256 of the text's UTF-8."""
    return F.sha2(F.encode(text, "utf-8"), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character unchanged.

    ``lower`` is the fast path and gives the same for texts without multi-byte characters.
    """
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
