"""Full text: words are runs of letters and digits, lower case, under 40 bytes."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = r"\p{IsAlphabetic}\p{N}"  # of a word, in the engine's patterns
_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower()) if len(w.encode()) < 40]


def token_column(text: Column) -> Column:
    """The words of a text, in order."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[^{LETTERS}]+")
    return F.filter(split, lambda w: (w != "") & (F.octet_length(w) < 40))


def norm_column(tokens: Column) -> Column:
    """` w1 w2 w3 `, in which a phrase can be found as a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def number_column(d: Column) -> Column:
    """A double as text, in its shortest form: 240.0 is 240."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def all_values_column(attrs: Column) -> Column:
    """The values of all attributes, joined by a space, in document order."""
    return F.array_join(F.transform(attrs, lambda e: F.coalesce(e["s"], e["l"].cast("string"), number_column(e["d"]))), " ")
