"""Text folding and synthetic ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def folded(text: str) -> str:
    """Canonical decomposition without combining marks, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f").lower()


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """``folded`` of a column; null stays null.

    For search, keep it as a column of the dimension: matching is then a native LIKE.
    """
    return text.map(lambda x: None if x is None else folded(x), na_action="ignore")


def contains(column: Column, term: str) -> Column:
    """Whether a folded column holds a term, which is folded here; ``%`` and ``_`` in it are wildcards, a backslash is itself."""
    pattern = folded(term).replace("\\", "\\\\")
    return column.like(f"%{pattern}%")


def synthetic_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 16 hex digits of a hash of the lower-cased parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.lower(p) for p in parts)), 256), 1, 16))


def is_real(id_: Column) -> Column:
    """Neither a local file's nor an import's id."""
    low = F.lower(id_.cast("string"))
    return ~(low.startswith("local:") | low.startswith("import:"))
