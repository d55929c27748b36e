"""Column functions over plain values: link, action, difference and minute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The link pattern, the words looked for and the separator of dates in a minute's text.
LINK_PATTERN = r"(\[\[[^\[]*\]\])"
ADD_WORD, REMOVE_WORD = "added", "remove"
DATE_SEPARATOR = "/"


def first_link(comment: Column) -> Column:
    """The first ``[[...]]`` link; empty text without one, NULL for NULL."""
    return F.regexp_extract(comment, LINK_PATTERN, 0)


def action_type(comment: Column) -> Column:
    """``add`` or ``remove`` by the case-sensitive word in the comment, else NULL."""
    return F.when(F.contains(comment, F.lit(ADD_WORD)), "add").when(
        F.contains(comment, F.lit(REMOVE_WORD)), "remove"
    )


def difference(new: Column, old: Column) -> Column:
    """``new - old``; NULL when either is NULL or the result does not fit."""
    return F.try_subtract(new, old)


def minute_start(dt: Column) -> Column:
    """The start of the minute of a time without zone; no session setting matters."""
    return dt - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), dt))


def minute_text(dt: Column) -> Column:
    """The minute of a time without zone as text, ``yyyy/MM/dd HH:mm``."""
    return F.translate(F.substring(dt.cast("string"), 1, 16), "-", DATE_SEPARATOR)
