"""Exact-size uniform samples of lines."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_lines(lines: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` lines, each set of them equally likely, in their order; all lines if there are no more.

    Seed 0 draws another sample each time. The order key hashes the position
    with the seed, so a seed gives the same sample whatever the partitions. Lines
    are counted by the first bits of their keys; whole parts below the cut are
    taken as they are, and only the part that is cut is sorted by its keys.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    seed = seed or random.SystemRandom().randrange(1, 1 << 62)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pos").cast("string"), F.col("line")))
    keyed = lines.withColumn("key", key).withColumn("part", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    left, cut = k, None
    for r in keyed.groupBy("part").count().orderBy("part").collect():  # no more than 65,536 rows
        if r["count"] > left:
            cut = r["part"]
            break
        left -= r["count"]
    if cut is None:
        return lines.orderBy("pos")
    edge = keyed.where(F.col("part") == cut).orderBy("key", "pos").limit(left)
    return keyed.where(F.col("part") < cut).union(edge).drop("key", "part").orderBy("pos")
