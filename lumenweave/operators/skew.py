"""Joins whose keys may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.session import width

#: A key with more than this share of an average partition's rows is split.
SHARE = 20


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], counted: DataFrame, how: str = "inner", by: Sequence[str] = ()) -> DataFrame:
    """``left`` joined with ``right``, hot keys of ``left`` in several parts; ``how`` is inner, left, left_semi or left_anti.

    ``counted`` has the keys with ``n``, the rows of ``left`` they have. Keys with more than one part in ``SHARE`` times the partitions of
    all rows are hot, so there are fewer of them than that, whatever the input: they are broadcast, their rows of ``left`` are dealt to
    parts by the hash of ``by`` (all other columns, if empty), and those of ``right`` are copied to each part. No row is lost. Keys are not null.
    """
    blocks = SHARE * width(left.sparkSession)
    total = counted.agg(F.sum("n").alias("total"))
    hot = counted.crossJoin(F.broadcast(total)).where(F.col("n") * blocks > F.col("total"))  # one row
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("n") * blocks / F.col("total")).cast("int").alias("__parts")))
    rest = list(by) or [c for c, t in left.dtypes if c not in keys and not t.startswith("map")]
    part = F.pmod(F.xxhash64(*(rest or keys)), F.coalesce("__parts", F.lit(1))).cast("int")
    a = left.join(hot, list(keys), "left").withColumn("__part", part).drop("__parts")
    b = right.join(hot, list(keys), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return a.join(b, [*keys, "__part"], how).drop("__part")
