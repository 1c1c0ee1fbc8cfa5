"""Scalar functions that Spark does not have."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fnv1a64(text: str) -> int:
    """64-bit FNV-1a of the UTF-8 bytes, which also numbers channels by name."""
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def sanitize(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", name)


@F.pandas_udf(T.StringType())
def format_g(values: pd.Series) -> pd.Series:
    """Numbers as C prints them with six significant digits, which Spark's formatter does not."""
    return values.map(lambda x: None if pd.isna(x) else f"{x:.6g}")


def split_list(text: Column) -> Column:
    """Trimmed non-empty parts between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
