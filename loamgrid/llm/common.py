"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.shared import broadcast_if_small, removed, written

__all__ = ["broadcast_if_small", "free_names", "removed", "text_of", "without", "written"]


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add: an input column of such a name gives way."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in range(1, len(taken) + 2) if (n := "_" * k + name) not in taken) for name in names]
