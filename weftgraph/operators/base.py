"""Helpers of the graph operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration with files in the shared checkpoint folder.

    Without ``spark.checkpoint.dir`` a machine of one's own (master ``local``)
    gets a temporary folder; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weft-"))
    return df.checkpoint(eager=True)


#: Rows of a settled table up to which it is broadcast, some 100 bytes each.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df``, settled before, to be broadcast if it counts ``FEW`` rows or less."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``.  Unlike dropDuplicates the survivor is defined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def top_by(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1; 0 means all."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.filter(F.col(rank) <= k) if k else out
