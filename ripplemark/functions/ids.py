"""Tidying of ids and words: blanks around them are no part of them, an empty one is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is cut from both ends.
BLANKS = " \t\n\r\f\v\u00a0"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_id(c: Column | str) -> Column:
    """Case-sensitive id without surrounding blanks; null for an empty one."""
    return F.nullif(F.btrim(_col(c), F.lit(BLANKS)), F.lit(""))


def clean_word(c: Column | str) -> Column:
    """As clean_id, compared without case."""
    return F.lower(clean_id(c))
