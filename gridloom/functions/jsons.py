"""Strict JSON check of a column: Spark's parsers take trailing garbage, so each text is parsed in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from gridloom.plans.model import StoreError, check_json


def _ok(text: str | None) -> bool:
    try:
        check_json(text)
    except StoreError:
        return False
    return True


@F.pandas_udf(BooleanType())
def _json_ok(texts: pd.Series) -> pd.Series:
    return texts.map(_ok).astype(bool)


def json_ok(*columns: Column) -> Column:
    """Whether the text is empty, null or JSON; comments and white space around it are fine. For several columns an array, in one pass."""
    return _json_ok(columns[0]) if len(columns) == 1 else _json_all(*columns)


@F.pandas_udf(ArrayType(BooleanType()))
def _json_all(*texts: pd.Series) -> pd.Series:
    return pd.Series([[_ok(t) for t in row] for row in zip(*texts, strict=True)], dtype=object)
