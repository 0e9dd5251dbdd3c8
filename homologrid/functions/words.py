"""Text column expressions."""

from __future__ import annotations

import textwrap
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about an annotation.
EXCLUDED_WORDS = ["protein", "None"]


def kept_words(text: Column, excluded: Sequence[str] = tuple(EXCLUDED_WORDS)) -> Column:
    """Words of a text: split at single blanks, drop excluded words, then parentheses.

    The order matters: ``(protein)`` is not an excluded word and stays as
    ``protein``; two blanks in a row leave an empty word.
    """
    words = F.split(text, " ")
    if excluded:
        words = F.filter(words, lambda word: ~word.isin(list(excluded)))
    return F.transform(words, lambda word: F.translate(word, "()", ""))


def wrapped(text: Column, width: int = 40, line_break: str = "</br>") -> Column:
    """Word-wrap a label; Python's own wrapping rules, in Arrow batches."""

    @F.pandas_udf("string")
    def wrap(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda value: None if value is None else line_break.join(textwrap.wrap(value, width))
        )

    return wrap(text)
