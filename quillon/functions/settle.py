"""A barrier for costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``df`` with the columns ``made``, worked out once and behind a generator.

    The optimizer moves filters below projections by putting expressions in place of
    names, which repeats them wherever they are named, level upon level. It moves none
    below a generator.
    """
    rest = [c for c in df.columns if c not in made]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
