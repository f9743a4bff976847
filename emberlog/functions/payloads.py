"""Payloads whose shape differs from row to row, as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload(text: Column) -> Column:
    """JSON text as a variant; null for null and for what is no JSON. Whole numbers beyond 64 bits stay exact up to 38
    digits."""
    return F.try_parse_json(text)


def member(value: Column, *paths: str, kind: str = "string") -> Column:
    """The first of ``paths`` (``$.a.b``, ``$[0]``, ``$['odd name']``) that a variant has as ``kind``; null where there is none
    or it is something else."""
    got = [F.try_variant_get(value, p, kind) for p in paths]
    return got[0] if len(got) == 1 else F.coalesce(*got)


def members(rows: DataFrame, value: str, outer: bool = False) -> DataFrame:
    """``rows`` once for each member of an object or element of an array in column ``value``: its ``pos``, ``key`` (null in
    arrays) and ``item``. Rows whose value is neither are left out, or kept with nulls if ``outer``."""
    explode = rows.sparkSession.tvf.variant_explode_outer if outer else rows.sparkSession.tvf.variant_explode
    return rows.lateralJoin(explode(F.col(value).outer()).select("pos", "key", F.col("value").alias("item")))


def shapes(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Of each group, how many rows it has, how many of them hold no payload, and the schema that the others have together."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("empty"), F.schema_of_variant_agg(F.col(value)).alias("shape"))
