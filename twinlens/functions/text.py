"""Text normalisation and tokenisation as Columns; Unicode decomposition as an Arrow function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: At most so many elements of a list-valued property are compared.
MAX_LIST_VALUES = 10

# Fixed value: the white space that separates tokens.
SPACE = r"[\t\n\x0B\f\r﻿\p{Z}]+"
_SPACE_PY = re.compile(r"[\t\n\x0b\f\r﻿ \xa0  -     　]+")


def fold_text(value: str | None) -> str | None:
    """Lower case, compatibility-decomposed, marks dropped, other than letters, digits and space to space, collapsed."""
    if value is None:
        return None
    plain = (c for c in unicodedata.normalize("NFKD", value.lower()) if unicodedata.category(c)[0] != "M")
    spaced = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in plain)
    return _SPACE_PY.sub(" ", spaced).strip(" ")


@F.pandas_udf(StringType())
def folded(values: pd.Series) -> pd.Series:
    known = {v: fold_text(v) for v in values.dropna().unique()}
    return values.map(known, na_action="ignore")


def is_ascii(column: Column) -> Column:
    return ~column.rlike(r"[^\x00-\x7F]")


def folded_ascii(column: Column) -> Column:
    """The same for ASCII text, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(column), r"[^a-z0-9]+", " "))


def tokens(column: Column, mode: str = "whitespace-lowercase", ascii_only: bool = False) -> Column:
    """Tokens of a text: lower-cased and split at white space; `alphanumeric` folds marks and punctuation first."""
    text = F.lower(column) if mode == "whitespace-lowercase" else (folded_ascii(column) if ascii_only else folded(column))
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def string_values(column: Column, is_array: bool) -> Column:
    """The values of a property as a list; null where it is missing."""
    if is_array:
        return F.slice(F.filter(column, lambda v: v.isNotNull()), 1, MAX_LIST_VALUES)
    return F.when(column.isNotNull(), F.array(column.cast("string")))
