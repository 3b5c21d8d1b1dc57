"""Set-shaped helpers over keys and blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_keys(needed: DataFrame, have: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are needed but not yet there."""
    return needed.select(*keys).distinct().join(have.select(*keys), list(keys), "left_anti")


def concatenate(blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Stack blocks of equal schema, each row tagged with its block name."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in blocks.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)
