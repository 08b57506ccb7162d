"""Hashes by which rows are drawn, jittered or numbered: the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Hash values are below this number.
SPACE = 1 << 60


def drawn(*keys: Column | str) -> Column:
    """A whole number from 0 to SPACE - 1 by the md5 of the keys, joined by colons."""
    text = F.concat_ws(":", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def drawn_sql(*keys: str) -> str:
    """The same in SQL."""
    return f"('0x' || md5(concat_ws(':', {', '.join(keys)}))[1:15])::BIGINT"
