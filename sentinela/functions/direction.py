"""Which way a text says a figure went, and whether a figure agrees with a computed value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of falling and rising, and the tolerance of a match.
DECREASE_WORDS = [
    "redução", "queda", "diminuição", "declínio", "recuo", "caída", "caiu", "reduziu", "diminuiu", "desceu", "menor",
]
INCREASE_WORDS = [
    "aumento", "alta", "crescimento", "elevação", "subida", "subiu", "aumentou", "cresceu", "maior",
]
TOLERANCE = 0.01

_ANY_WORD = "|".join(DECREASE_WORDS + INCREASE_WORDS)
# The last direction word with neither `.`, `;` nor "anterior" behind it. "aumento" does not count within
# 20 characters after the start of "taxa de " (the name of the metric).
NEARBY = (
    rf"(?sU)^.*\b((?:(?<!taxa de .{{0,12}})aumento)|{'|'.join(w for w in DECREASE_WORDS + INCREASE_WORDS if w != 'aumento')})\b"
    r"(?!.*(?:[.;]|anterior))"
)
# A direction word, up to six words, and "de" directly before the figure.
IMMEDIATE = rf"(?sU)\b({_ANY_WORD})(?:\s+\w+){{0,6}}\s+de\s*\z"


def _is_decrease(word: Column) -> Column:
    """True, False, or NULL where there is no word."""
    return F.nullif(word, F.lit("")).isin(DECREASE_WORDS)


def nearby_decrease(context: Column) -> Column:
    """Whether the nearest direction word before a figure is one of falling; NULL if there is none."""
    return _is_decrease(F.regexp_extract(context, NEARBY, 1))


def immediate_decrease(context: Column) -> Column:
    """The same for a word tied to the figure by "de"; a minus sign before the figure is passed over."""
    return _is_decrease(F.regexp_extract(F.regexp_replace(context, r"[ \t\n\r-]+\z", ""), IMMEDIATE, 1))


def within_tolerance(value: Column, allowed: Column) -> Column:
    """Relative for a non-zero allowed value, absolute for zero."""
    scale = F.when(allowed == 0, F.lit(1.0)).otherwise(F.abs(allowed))
    return F.abs(value - allowed) / scale <= TOLERANCE


def is_grounded(value: Column, allowed: Column, context: Column) -> Column:
    """Whether a figure states an allowed value, sign and wording included.

    A figure equal in sign and size must not stand next to a word of the other direction. One equal in size
    only must be tied to a word that gives it the allowed value's sign. The words are looked for only where
    the sizes agree.
    """
    falls = allowed < 0
    return F.when(
        within_tolerance(value, allowed), F.coalesce(nearby_decrease(context) == falls, F.lit(True))
    ).otherwise(
        (value != 0) & (allowed != 0) & within_tolerance(F.abs(value), F.abs(allowed))
        & F.coalesce(immediate_decrease(context) == falls, F.lit(False))
    )
