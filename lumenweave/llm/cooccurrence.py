"""Items that appear together, by stripes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweave.functions.text import label
from lumenweave.session import width, written


#: Likelihood ratio that chance passes once in a thousand: the quantile of chi-squared with one degree of freedom.
SIGNIFICANT = 10.828


def _entropy(*counts: Column) -> Column:
    """Sum of k ln k less N ln N, the unnormalised entropy of Dunning's statistic."""
    k = sum((F.when(c > 0, c * F.log(c)).otherwise(0.0) for c in counts), F.lit(0.0))
    n = sum(counts, F.lit(0.0))
    return k - F.when(n > 0, n * F.log(n)).otherwise(0.0)


def log_likelihood(n: Column, u: Column, d: Column, t: Column) -> Column:
    """Log-likelihood ratio of a pair seen ``n`` times, of items seen ``u`` and ``d`` times among ``t``."""
    a, b, c = n.cast("double"), (u - n).cast("double"), (d - n).cast("double")
    e = (t - u - d + n).cast("double")
    return F.greatest(F.lit(0.0), 2 * (_entropy(a, b, c, e) - _entropy(a + b, c + e) - _entropy(a + c, b + e)))


#: Stripes of an item merged in one go, and blocks of records: each block gives an item one stripe at most.
FAN = 16
BLOCKS = FAN * FAN


def _merged(maps: Column) -> Column:
    """One associative array of several, values of one key added."""
    add = lambda a, m: F.map_zip_with(a, m, lambda k, x, y: F.coalesce(x, F.lit(0).cast("bigint")) + F.coalesce(y, F.lit(0).cast("bigint")))
    return F.aggregate(F.slice(maps, F.lit(2), F.greatest(F.size(maps) - 1, F.lit(0))), F.get(maps, F.lit(0)), add)


def stripes(records: DataFrame, record: str, item: str, other: str, n: str) -> DataFrame:
    """An associative array of neighbours for each item: item, part, stripe MAP<STRING, BIGINT>.

    Records (baskets) are dealt to blocks by hash; in each block an item has one stripe, with the sums of its records' pairs (partial before
    the shuffle). Stripes of one item are then merged by key, ``FAN`` at a time. An item's stripe comes in as many parts as the session has
    partitions, by hash of the neighbour, so that an item with a third of all neighbours is not built in one task; parts of one item are
    disjoint. Null counts add nothing but keep the pair; null items or neighbours give nothing.
    """
    parts = width(records.sparkSession)
    block = F.pmod(F.xxhash64(F.col(record)), F.lit(BLOCKS)).cast("int")
    rows = records.where(F.col(item).isNotNull() & F.col(other).isNotNull()).select(block.alias("block"), F.col(item).alias("item"), F.col(other).alias("other"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n"))
    sums = rows.groupBy("block", "item", "other").agg(F.sum("n").alias("n")).withColumn("part", F.pmod(F.xxhash64("other"), F.lit(parts)).cast("int"))
    local = sums.groupBy("item", "part", "block").agg(F.map_from_entries(F.collect_list(F.struct("other", "n"))).alias("stripe"))
    first = local.groupBy("item", "part", F.floor(F.col("block") / FAN).alias("block")).agg(_merged(F.collect_list("stripe")).alias("stripe"))
    return first.groupBy("item", "part").agg(_merged(F.collect_list("stripe")).alias("stripe"))


def associations(records: DataFrame, record: str, item: str, other: str, n: str) -> DataFrame:
    """How often each pair occurs together against chance: item, other, n, u, d, t, lift, llr.

    ``records``: the pairs of each record (basket) with their count; null counts add nothing but keep the pair. ``u`` and
    ``d`` are the sums of the item and of the neighbour, ``t`` that of all. Empty input gives no rows.
    """
    lines = written(stripes(records, record, item, other, n), "stripes")
    totals = lines.select("item", F.aggregate(F.map_values("stripe"), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n")).groupBy("item").agg(F.sum("n").alias("u"))
    pairs = lines.select("item", F.explode("stripe").alias("other", "n"))
    others = pairs.groupBy("other").agg(F.sum("n").alias("d"))
    total = totals.agg(F.coalesce(F.sum("u"), F.lit(0)).alias("t"))
    full = pairs.join(totals, "item").join(others, "other").crossJoin(F.broadcast(total))  # one row
    lift = F.when((F.col("u") > 0) & (F.col("d") > 0), F.col("n").cast("double") * F.col("t") / F.col("u") / F.col("d"))
    return full.select("item", "other", "n", "u", "d", "t", lift.alias("lift"), log_likelihood(F.col("n"), F.col("u"), F.col("d"), F.col("t")).alias("llr"))


def pair_records(df: DataFrame, batch: str, key: str, drug: str, disease: str, count: str) -> DataFrame:
    """One row for each batch and pair: batch, drug, disease, n. Null labels are taken from ``key`` (``disease <> drug``).

    Rows of one batch and pair are one record; of their counts the largest holds, null if all are null.
    """
    halves = F.split(F.col(key), "<>", 2)
    u = F.coalesce(label(F.col(drug)), label(F.try_element_at(halves, F.lit(2))))
    d = F.coalesce(label(F.col(disease)), label(F.try_element_at(halves, F.lit(1))))
    return df.select(F.col(batch).alias("batch"), u.alias("drug"), d.alias("disease"), F.col(count).cast("bigint").alias("n")).groupBy("batch", "drug", "disease").agg(F.max("n").alias("n"))


def strong(found: DataFrame, least: int, lift: int) -> DataFrame:
    """Pairs seen at least ``least`` times, ``lift`` times as often as chance has it, and significantly so by the likelihood ratio.

    With E = u d / t the ratio is at least 2 (n ln(n / E) - n + E), so for 20 and 4 it is above 25 wherever the first two hold: significance
    then takes none of them away. Counts are compared exactly.
    """
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "nutd"}
    return found.where((F.col("n") >= least) & (wide["n"] * wide["t"] >= lift * wide["u"] * wide["d"]) & (F.col("llr") >= SIGNIFICANT))
