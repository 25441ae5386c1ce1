"""Dates as ``yyyyMMdd`` strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termweave.functions.text import NULL_TOKENS, strip

#: Accepted besides eight digits, in order.
FORMATS = (("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"), ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"))


def normalize_date(c: Column) -> Column:
    """``yyyyMMdd`` of a date string, null where it is none.

    Eight digits in plausible ranges pass as they are, even if the month has no
    such day; a trailing time is not accepted.
    """
    s = strip(c.cast("string"))
    part = lambda a, n: F.substring(s, a, n).try_cast("int")
    plain = s.rlike(r"^\d{8}$") & part(1, 4).between(1900, 2100) & part(5, 2).between(1, 12) & part(7, 2).between(1, 31)
    other = F.coalesce(*(F.when(s.rlike(shape), F.date_format(F.try_to_date(s, fmt), "yyyyMMdd")) for fmt, shape in FORMATS))
    return F.when(s.isin(*NULL_TOKENS), None).when(plain, s).when(~s.rlike(r"^\d{8}$"), other)
