"""String functions over columns. All are JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for null in delimited files. Fixed values.
NULL_TOKENS = ("", "NULL", "null", "None", "NA", "nan", "NaN")


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_query(c: Column) -> Column:
    return F.lower(strip(c))


def null_if(c: Column, tokens: tuple[str, ...] = ("", "None", "nan", "NaN")) -> Column:
    """Stripped, and null where it is one of ``tokens``."""
    s = strip(c)
    return F.when(~s.isin(*tokens), s)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def ngrams(c: Column, least: int = 4, most: int = 5) -> Column:
    """Character n-grams of each token, in token order."""

    def of_size(token: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(token) - n + 1, F.lit(1)))
        return F.when(F.length(token) >= n, F.transform(starts, lambda i: F.substr(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def grams(token: Column) -> Column:
        return F.concat(*(of_size(token, n) for n in range(least, most + 1)))

    return F.flatten(F.transform(tokens(c), grams))


def least_matches(n_terms: Column, share: float = 0.6) -> Column:
    """How many terms must match: the one of a single term, else the share rounded down, one at least."""
    return F.when(n_terms <= 1, n_terms).otherwise(F.greatest(F.lit(1), F.floor(n_terms * share))).cast("int")


def entity_alias(c: Column) -> Column:
    """The name without one trailing ``(...)``; unchanged if nothing would be left."""
    s = strip(c)
    short = strip(F.regexp_replace(s, r"\([^)]*\)$", ""))
    return F.when(short == "", s).otherwise(short)


def concept_id_of(c: Column) -> Column:
    """The digits of a trailing ``(digits)``, else null."""
    found = F.regexp_extract(c, r"\((\d+)\)\s*$", 1)
    return F.when(found != "", found)


def normalize_concept(c: Column) -> Column:
    """``Name (id)`` with the name lower-cased and spacing made even; text without an id is lower-cased."""
    cid = concept_id_of(c)
    name = F.lower(strip(F.regexp_replace(c, r"\(\d+\)\s*$", "")))
    return F.when(cid.isNull(), normalize_query(c)).otherwise(F.concat(name, F.lit("("), cid, F.lit(")")))


def split_synonyms(c: Column, most: int = 50) -> Column:
    """Parts between ``;`` and ``/``, stripped, distinct in order, the first ``most``."""
    parts = F.filter(F.transform(F.split(c, "[;/]"), strip), lambda p: p != "")
    return F.slice(F.array_distinct(parts), 1, most)


def doc_id(*parts: Column) -> Column:
    """MD5 of the parts joined by underscores; null parts count as empty."""
    return F.md5(F.concat_ws("_", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def strip_fence(c: Column) -> Column:
    """The text inside a Markdown code fence, if there is one."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return strip(F.when(F.instr(c, "```") > 0, inner).otherwise(c))


def parse_concept_id(c: Column) -> Column:
    """An id written as a number, such as ``12.0``, as digits; null if it is none."""
    return strip(c).try_cast("double").try_cast("bigint").cast("string")


def parse_score(c: Column) -> Column:
    return strip(c.cast("string")).try_cast("double")


def null_display(c: Column, shown: str = "NULL") -> Column:
    s = F.trim(c)
    return F.when(s.isNull() | (s == ""), shown).otherwise(s)


def interval_text(point: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.3f [%.3f-%.3f]", point, low, high)


def fill_template(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; other braces stay, those in a value too."""
    parts = re.split("{(" + "|".join(map(re.escape, values)) + ")}", template) if values else [template]
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))
