"""Train and validation split by content: equal texts always fall on one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_bucket(text: Column, mod: int) -> Column:
    """First 8 bytes of the SHA-256 of the text as an unsigned number, modulo ``mod``."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)
    return F.pmod(head.cast("decimal(20,0)"), F.lit(mod)).cast("long")


def is_validation(text: Column, mod: int) -> Column:
    return content_bucket(text, mod) == 0


def take_split(df: DataFrame, split: str, mod: int, text_col: str = "text") -> DataFrame:
    """``all``, ``train`` or ``val`` rows."""
    if split not in ("all", "train", "val"):
        raise ValueError(f"split is all, train or val, not {split!r}")
    if split == "all":
        return df
    val = is_validation(F.col(text_col), mod)
    return df.where(val if split == "val" else ~val)
