"""Agreement of predictions with truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column, digits: int = 6) -> list[Column]:
    return [F.round(_ratio(tp, tp + fp), digits).alias("precision"), F.round(_ratio(tp, tp + fn), digits).alias("recall"), F.round(_ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1")]


def by_label(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Precision, recall, F1 and support of each label. One pass: pairs are counted first."""
    pairs = df.where(F.col(truth).isNotNull() & F.col(said).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(said).alias("s")).agg(F.count("*").alias("n"))
    hit = F.col("t") == F.col("s")
    long = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(~hit, F.col("n")).otherwise(0).alias("fn")), F.struct(F.col("s").alias("label"), F.lit(0).alias("tp"), F.when(~hit, F.col("n")).otherwise(0).alias("fp"), F.lit(0).alias("fn")))).alias("x")).select("x.*")
    g = long.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return g.select("label", (F.col("tp") + F.col("fn")).alias("support"), *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def multilabel(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Micro scores, subset accuracy, mean Jaccard and share with any overlap, of arrays of labels."""
    t, s = F.array_distinct(truth), F.array_distinct(said)
    both, either = F.size(F.array_intersect(t, s)), F.size(F.array_union(t, s))
    rows = df.where(F.col(truth).isNotNull() & F.col(said).isNotNull()).select(both.alias("tp"), (F.size(s) - both).alias("fp"), (F.size(t) - both).alias("fn"), F.coalesce(F.try_divide(both, either), F.lit(1.0)).alias("j"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return rows.agg(F.count("*").alias("n"), *prf(tp, fp, fn), F.round(F.avg(((F.col("fp") + F.col("fn")) == 0).cast("double")), 6).alias("subset_accuracy"), F.round(F.avg("j"), 6).alias("jaccard"), F.round(F.avg((F.col("tp") > 0).cast("double")), 6).alias("any_overlap"))


def multilabel_averages(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Macro and weighted precision, recall and F1 of arrays of labels: average, labels and scores. Counts per label are summed first."""
    t, s = F.array_distinct(truth), F.array_distinct(said)
    rows = df.where(F.col(truth).isNotNull() & F.col(said).isNotNull()).select(F.explode(F.array_union(t, s)).alias("label"), t.alias("t"), s.alias("s"))
    a, b = F.array_contains("t", F.col("label")), F.array_contains("s", F.col("label"))
    g = rows.groupBy("label").agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"))
    one = g.select((F.col("tp") + F.col("fn")).alias("w"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f"))
    mean = lambda c: F.round(F.avg(c), 6)
    weighted = lambda c: F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 6)
    both = one.agg(F.count("*").alias("labels"), F.array(*[F.struct(F.lit(n).alias("average"), f("p").alias("precision"), f("r").alias("recall"), f("f").alias("f1")) for n, f in (("macro", mean), ("weighted", weighted))]).alias("x"))
    return both.select("labels", F.inline("x"))


def sweep(df: DataFrame, distance: str, right: str, thresholds: list[float]) -> DataFrame:
    """Scores if links beyond each threshold are undone. ``right`` says whether a link is right. One scan for all thresholds."""
    rows = df.select(F.col(distance).alias("d"), F.col(right).alias("ok"))
    per = []
    for t in thresholds:
        tp, fp, fn = F.count_if((F.col("d") <= t) & F.col("ok")), F.count_if((F.col("d") <= t) & ~F.col("ok")), F.count_if((F.col("d") > t) & F.col("ok"))
        per.append(F.struct(F.lit(float(t)).alias("threshold"), *prf(tp, fp, fn)))
    return rows.agg(F.array(*per).alias("x")).select(F.inline("x"))


def bootstrap(df: DataFrame, row_id: str, value: str, times: int, seed: int = 7) -> DataFrame:
    """Mean and its 95 % interval from ``times`` Poisson resamples, drawn by the hash of row and resample.

    Each batch of rows gives its weighted sums of every resample, by one matrix product; rows are not copied. Weights are Poisson(1) by the
    inverse of its distribution. Null values take no part.
    """
    steps = np.array([0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582])
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.col(row_id), F.lit(seed)).alias("h"), F.col(value).cast("double").alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, times + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        total = np.zeros((times, 2))
        for batch in batches:
            every, v = batch.column("h").to_numpy().view(np.uint64), batch.column("v").to_numpy()
            for a in range(0, len(v), 1024):
                x = every[a : a + 1024, None] ^ salt[None, :]
                for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
                u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
                w = np.searchsorted(steps, u.ravel(), side="right").reshape(u.shape).astype(np.float64)
                total += np.stack([w.sum(axis=0), w.T @ v[a : a + 1024]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(times), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["b", "w", "v"])

    means = rows.mapInArrow(sums, "b int, w double, v double").groupBy("b").agg((F.sum("v") / F.sum("w")).alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))
