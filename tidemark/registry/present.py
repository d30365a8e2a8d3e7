"""Uniform result types: dates as ISO text, decimals as double, whole numbers as bigint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(df: DataFrame, *columns: str) -> DataFrame:
    if columns:
        df = df.select(*columns)
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            col = col.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)
