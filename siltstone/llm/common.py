"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hash60(*parts: Column | str, seed: str = "siltstone") -> Column:
    """A hash of 60 bits of the parts that any SQL engine with md5 can recompute; nulls count as empty."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 15), 16, 10).cast("bigint")


def need(df: DataFrame, *names: str) -> None:
    """Fails early if columns are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {missing}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not use yet, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def schema_of(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]
