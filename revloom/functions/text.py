"""Message and status text as Column expressions."""

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def _col(value):
    return F.col(value) if isinstance(value, str) else value


def word_pattern(words) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def has_word(message, words) -> Column:
    """The message holds one of the whole words, in any case."""
    return _col(message).rlike(word_pattern(words))


def matched_words(message, words) -> Column:
    """Sorted distinct matches in lower case."""
    found = F.regexp_extract_all(_col(message), F.lit(word_pattern(words)), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def rename_target(path) -> Column:
    """New path of a rename: ``a/{x => y}/b`` is ``a/y/b``, ``x => y`` is ``y``."""
    braces = F.regexp_replace(_col(path), r"\{.*? *=> *(.*?)\}", "$1")
    arrow = F.regexp_replace(braces, r"^.* => ", "")
    return F.regexp_replace(arrow, r"/+", "/")


def change_kind(status) -> Column:
    """First letter of a status, null unless it is A, M, D, C or R."""
    first = F.substring(_col(status), 1, 1)
    return F.when(first.isin("A", "M", "D", "C", "R"), first)


def line_count(text) -> Column:
    """A numstat number; '-' (binary) counts as 0."""
    return F.coalesce(_col(text).try_cast("long"), F.lit(0).cast("long"))


def subject_line(message) -> Column:
    return F.substring_index(_col(message), "\n", 1)
