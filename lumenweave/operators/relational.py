"""Filters, joins, set operations, de-duplication and sampling over named columns. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweave.session import written


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(c if c in keep else prefix + c) for c in df.columns])


def pair_key(disease: Column, drug: Column) -> Column:
    """``disease <> drug``; null if either is."""
    return F.concat(disease, F.lit(" <> "), drug)


def contains(text: Column, needle: str) -> Column:
    """Case-blind substring test; null text gives false."""
    return F.coalesce(F.contains(F.lower(text), F.lit(needle.lower())), F.lit(False))


def route(text: Column, keywords: Sequence[str]) -> Column:
    """The first keyword, in the given order, that the text holds; null if none."""
    out = F.lit(None).cast("string")
    for k in reversed(keywords):
        out = F.when(contains(text, k), k).otherwise(out)
    return out


def labels_matching(text: Column, patterns: Mapping[str, str]) -> Column:
    """All labels whose pattern the text matches, in one pass: ARRAY<STRING>."""
    return F.filter(F.array(*[F.when(F.coalesce(F.lower(text).rlike(p), F.lit(False)), F.lit(k)) for k, p in patterns.items()]), lambda x: x.isNotNull())


def without(df: DataFrame, key: Column, *lists: DataFrame) -> DataFrame:
    """Rows whose key stands on no exclusion list (each a single-column table). Null keys stay."""
    banned = reduce(DataFrame.union, [x.select(F.col(x.columns[0]).alias("__banned")) for x in lists]).where("__banned is not null").distinct()
    return df.withColumn("__key", key).join(banned, F.col("__key") == F.col("__banned"), "left_anti").drop("__key")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order. A partial aggregate, not a window: no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(df.columns)


def keep_first_window(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """As ``keep_first`` for orders with descending parts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per_class(df: DataFrame, by: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first k of each class, by a total order, with their rank. Spark keeps k rows a class before its shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def share(counts: DataFrame, count: str, digits: int = 4) -> DataFrame:
    """Adds each row's percentage of the total."""
    total = counts.agg(F.sum(count).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col(count) / F.col("__total"), digits)).drop("__total")  # one row


def outliers(df: DataFrame, columns: Sequence[str], limit: float) -> DataFrame:
    """Rows whose largest absolute z-score over the columns is above the limit, with that score."""
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns])
    z = [F.abs(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}"))) for c in columns]
    worst = F.greatest(*z) if len(z) > 1 else z[0]
    return df.crossJoin(F.broadcast(stats)).withColumn("max_z", worst).where(F.col("max_z") > limit).select(*df.columns, "max_z")  # one row


def first_source_wins(sources: Sequence[DataFrame], key: str, order: Sequence[Column]) -> DataFrame:
    """Union by name in which a key comes from the first source that has it, there from the first row by ``order``."""
    ranked = [s.withColumn("__rank", F.lit(i)) for i, s in enumerate(sources)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return keep_first(whole, [key], [F.col("__rank"), *order]).drop("__rank")


def resume(todo: DataFrame, done: DataFrame, key: str, column: str) -> DataFrame:
    """Results of an earlier run filled in; ``pending`` marks what is still to do."""
    earlier = done.select(F.col(key), F.col(column).alias("__earlier"))
    joined = todo.join(earlier, key, "left").withColumn(column, F.coalesce(F.col(column), F.col("__earlier"))).drop("__earlier")
    return joined.withColumn("pending", F.col(column).isNull())


def chained(base: DataFrame, key: str, others: Sequence[DataFrame], fill: str) -> DataFrame:
    """Left joins of several one-row-a-key tables; missing strings get ``fill``."""
    out = reduce(lambda a, b: a.join(b, key, "left"), others, base)
    return out.na.fill(fill)


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def md5_draw(key: Column) -> Column:
    """A number in [0, 1) from the first 7 hex digits of the key's MD5, which other engines can compute too."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("bigint") / float(16**7)


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of their MD5: the same at every run and partitioning."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the running number from 1 in this order, over all rows.

    One sort in ranges of the order, of which no task has more than its share; the sorted rows are written, and each gets its place in its
    range and the rows of the ranges before. Only the ranges' sizes, as many as there are partitions, are summed in one place.
    """
    spark = df.sparkSession
    placed = df.orderBy(*order).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    rows = written(placed, "numbered")
    before, total = [], 0
    for r in sorted(rows.groupBy("__range").count().collect()):
        before.append((r["__range"], total))
        total += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "__range int, __before bigint"))
    return rows.join(offsets, "__range").withColumn(name, F.col("__at") + F.col("__before") + 1).drop("__range", "__at", "__before")


def stratified(df: DataFrame, label: str, key: str, train: float, dev: float) -> DataFrame:
    """Adds split (train, dev, test) by place in each class's hash order; exact to a row in each class, null a class of its own."""
    rows = numbered(df, [F.col(label).asc_nulls_first(), F.md5(F.col(key).cast("string")), F.col(key)], "__n")
    sizes = rows.groupBy(F.col(label).alias("__label")).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    full = rows.join(sizes, F.col(label).eqNullSafe(F.col("__label")))
    place = (F.col("__n") - F.col("__first")) / F.col("__size")
    return full.withColumn("split", F.when(place < train, "train").when(place < train + dev, "dev").otherwise("test")).select(*df.columns, "split")


def overlap(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Membership of each key in several sets as flag columns."""
    tagged = reduce(DataFrame.union, [d.toDF(key).withColumn("__set", F.lit(n)).where(F.col(key).isNotNull()) for n, d in parts.items()])
    return tagged.groupBy(key).agg(*[F.bool_or(F.col("__set") == n).alias(f"in_{n}") for n in parts])


def split_ways(df: DataFrame, key: str, n: int) -> DataFrame:
    """Part of each row in an n-way strided split over a running id."""
    return df.withColumn("part", F.pmod(F.col(key), F.lit(n)).cast("int"))


def split_runs(df: DataFrame, order: Sequence[Column], parts: int | None = None, size: int | None = None) -> DataFrame:
    """Part of each row in contiguous runs of this order: so many of equal size (the first ones a row longer), or runs of ``size`` rows."""
    rows = numbered(df, order, "__n")
    if size:
        return rows.withColumn("part", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")
    total = F.broadcast(rows.agg(F.count("*").alias("__total")))  # one row
    short, longer, at = F.floor(F.col("__total") / parts), F.pmod("__total", F.lit(parts)), F.col("__n") - 1
    part = F.when(at < longer * (short + 1), F.floor(at / (short + 1))).otherwise(longer + F.floor((at - longer * (short + 1)) / F.greatest(short, F.lit(1))))
    return rows.crossJoin(total).withColumn("part", part.cast("int")).drop("__n", "__total")
