"""Postings of character grams: which rows can hold a substring.

The grams of a text are its distinct runs of ``size`` characters, lower case, and its
single CJK characters, as a CJK needle may be one character. A row holds a needle only
if it holds all the needle's grams; rows that do are few, and only their texts are
compared. A needle with no gram of its own (shorter than ``size`` and not CJK) is
looked for in all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK, is_cjk
from . import recall

SIZE = 3
CHARS = 0  #: size of an index of single CJK characters alone


def grams(text: Column, size: int = SIZE) -> Column:
    """Distinct grams of a text; ``CHARS`` takes single CJK characters only."""
    low = F.lower(text)
    single = F.regexp_extract_all(low, F.lit(f"[{CJK}]"), F.lit(0))
    if size == CHARS:
        return F.array_distinct(single)
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)), single))


def grams_of(needle: str, size: int = SIZE) -> list[str]:
    """The same of one needle."""
    low = needle.lower()
    runs = [low[i : i + size] for i in range(len(low) - size + 1)] if size != CHARS else []
    return list(dict.fromkeys(runs + [c for c in low if is_cjk(c)]))


def decides(needle: str, size: int = SIZE) -> bool:
    """Whether rows with the needle's grams are those with the needle: it is a single gram."""
    return grams_of(needle, size) == [needle.lower()]


def gram_postings(rows: DataFrame, keys: list[str], fields: list[str], size: int = SIZE) -> DataFrame:
    """gram and keys of every row, once each."""
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams(F.col(c), size), F.array().cast("array<string>")) for c in fields])))
    return rows.select(*keys, F.explode(every).alias("gram"))


def holding(postings: DataFrame, needle: str, keys: list[str], size: int = SIZE) -> DataFrame:
    """keys of the rows with all the needle's grams; the needle must have one."""
    wanted = grams_of(needle, size)
    rows = postings.filter(F.col("gram").isin(wanted))
    if len(wanted) == 1:
        return rows.select(*keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("_grams")).filter(F.col("_grams") == len(wanted)).select(*keys)


def like(rows: DataFrame, postings: DataFrame, keys: list[str], fields: list[str], needle: str, size: int = SIZE) -> DataFrame:
    """rows with the needle in any field: those with its grams, and of them those that hold it."""
    if not grams_of(needle, size):
        return rows.filter(recall.holds(fields, needle))
    some = rows.join(holding(postings, needle, keys, size), keys, "left_semi")
    return some.filter(recall.holds(fields, needle))
