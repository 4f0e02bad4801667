"""Text columns: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters removed by ``strip_marks`` and by ``strip_punctuation`` (fixed values).
MARKS = "([,.!?:;])"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip_marks(text: Column) -> Column:
    """Removes ten punctuation marks; apostrophes and line breaks stay."""
    return F.translate(text, MARKS, "")


def strip_punctuation(text: Column) -> Column:
    """Removes all ASCII punctuation."""
    return F.translate(text, PUNCTUATION, "")


def space_tokens(text: Column) -> Column:
    """Lower-cased tokens between single spaces; tabs and line breaks stay inside tokens."""
    return F.split(F.lower(text), " ")


def is_number(word: Column) -> Column:
    return word.rlike("^[0-9]+$")


def is_ascii_alpha(word: Column) -> Column:
    return word.rlike("^[A-Za-z]+$")


def split_list(text: Column) -> Column:
    """A ', '-separated list as an array."""
    return F.split(text, ", ")


def json_field(text: Column, path: str) -> Column:
    """One field of a JSON document, null where it is absent."""
    return F.get_json_object(text, f"$.{path}")


def year_of(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """The year of a timestamp written as text."""
    return F.year(F.to_timestamp(text, pattern))


def mentions_year(text: Column, year: int) -> Column:
    """A looser test than ``year_of``: the year's digits stand anywhere in the text."""
    return text.contains(str(year))
