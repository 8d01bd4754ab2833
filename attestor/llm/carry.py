"""Rows on their way through a Python task: the text once, the other columns in a struct.

Columns of the caller may have any name; inside the struct they are ``c0, c1, ...``, so
they never clash with those of an operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, carry: bool) -> DataFrame:
    """``doc_id, _text, carried``; ``carried`` holds all columns but the text, if asked for."""
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns) if c != "text"]
    carried = F.struct(*others) if carry and others else F.lit(None).cast("int")
    return df.select(F.col("doc_id"), F.col("text").alias("_text"), carried.alias("carried"))


def unpacked(columns: list[str], changed: dict[str, Column] | None = None) -> list[Column]:
    """The caller's columns from ``_text`` and ``carried``; ``changed`` replaces some."""
    changed = {"text": F.col("_text")} | (changed or {})
    return [changed[c].alias(c) if c in changed else F.col(f"carried.c{i}").alias(c) for i, c in enumerate(columns)]
