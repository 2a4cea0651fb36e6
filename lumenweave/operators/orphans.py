"""References to records that don't exist, were deleted, or arrive later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweave.session import width

#: Keys in a range: no more parents than that stand in one sorted array.
RANGE = 4096
#: A range with more than this share of an average partition's references is cut into blocks of about that size.
SHARE = 20

OUT = "ref_table string, row_id bigint, key bigint, at timestamp, reason string, parent_year int"


def parents(df: DataFrame, key: str, at: str, deleted: str, year: str | None = None) -> DataFrame:
    """One row for each key: earliest arrival, whether its latest version is deleted, and the latest known year.

    Null ``deleted`` means not deleted; of versions with one time the deleted one counts. Null keys are no parents. Exact
    repeats don't matter. The aggregate is partial before its shuffle, so a key with a third of all rows is no burden.
    """
    when = F.col(at).cast("timestamp")
    y = F.col(year).cast("int") if year else F.lit(None).cast("int")
    return (
        df.select(F.col(key).alias("k"), when.alias("w"), F.coalesce(F.col(deleted), F.lit(False)).alias("d"), y.alias("y"))
        .where("k is not null")
        .groupBy("k")
        .agg(F.min("w").alias("earliest"), F.max(F.struct("w", "d")).alias("last"), F.max(F.when(F.col("y").isNotNull(), F.struct("w", "y"))).alias("dated"))
        .select("k", "earliest", F.col("last.d").alias("gone"), F.col("dated.y").alias("year"))
    )


def _ranges(df: DataFrame) -> DataFrame:
    """Parents as sorted arrays, one row for each range of keys."""
    micros = F.unix_micros("earliest")
    one = F.struct("k", F.coalesce(micros, F.lit(-(2**62))).alias("e"), F.col("gone").alias("g"), F.coalesce("year", F.lit(-1)).alias("y"))
    return (
        df.select(F.floor(F.col("k") / RANGE).alias("rng"), one.alias("one"))
        .groupBy("rng")
        .agg(F.sort_array(F.collect_list("one")).alias("all"))
        .select("rng", *(F.col(f"all.{f}").alias(f"p_{f}") for f in "kegy"))
    )


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Looks each block of references up in the sorted keys of its range and gives the misses."""
    schema = pa.schema([("ref_table", pa.string()), ("row_id", pa.int64()), ("key", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("reason", pa.string()), ("parent_year", pa.int32())])

    def flat(column: pa.Array, i: int) -> np.ndarray:
        return column[i].values.to_numpy(zero_copy_only=False) if column[i].is_valid else np.empty(0, np.int64)

    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            have, key, at = flat(c["p_k"], i), flat(c["r_k"], i), flat(c["r_w"], i)
            if len(have):
                place = np.minimum(np.searchsorted(have, key), len(have) - 1)
                there = have[place] == key
                gone = there & flat(c["p_g"], i).astype(bool)[place]
                late = there & ~gone & (flat(c["p_e"], i)[place] > at)
                year = np.where(there, flat(c["p_y"], i)[place], -1)
            else:
                there = gone = late = np.zeros(len(key), bool)
                year = np.full(len(key), -1)
            miss = np.flatnonzero(~there | gone | late)
            if not len(miss):
                continue
            reason = np.where(gone, "deleted", np.where(late, "later", "missing"))[miss]
            known, y = at[miss] < 2**62, year[miss]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c["ref_table"][i].as_py()] * len(miss), pa.string()),
                    pa.array(flat(c["r_id"], i)[miss], pa.int64()),
                    pa.array(key[miss], pa.int64()),
                    pa.array(at[miss], pa.int64(), mask=~known).cast(pa.timestamp("us", "UTC")),
                    pa.array(reason.tolist(), pa.string()),
                    pa.array(y.astype(np.int32), pa.int32(), mask=y < 0),
                ],
                schema=schema,
            )


def orphans(references: DataFrame, known: DataFrame) -> DataFrame:
    """References without a usable parent: ref_table, row_id, key, at, reason (missing, deleted, later), parent_year.

    ``references``: ref_table, row_id, key, at; a null key refers to nothing and gives no row; a null ``at`` counts as after
    every arrival. ``known``: what ``parents`` gives. Keys are cut into fixed ranges of ``RANGE``; each range's parents are one
    sorted array, and references meet it in blocks that are looked up by binary search. Ranges with many references (at most
    ``SHARE`` times the partitions in number, whatever the input) get several blocks, so no task has more than its share.
    Repeated references stay, each with its own row. Empty tables give no rows or, without parents, all references.
    """
    spark = references.sparkSession
    refs = references.where("key is not null").select("ref_table", F.col("row_id").cast("bigint").alias("row_id"), F.col("key").alias("k"), F.floor(F.col("key") / RANGE).alias("rng"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(2**62)).alias("w"))
    blocks = SHARE * width(spark)
    counted = refs.groupBy("rng").count()
    total = counted.agg(F.sum("count").alias("total"))
    hot = (
        counted.crossJoin(F.broadcast(total))  # one row
        .where(F.col("count") * blocks > F.col("total"))
        .select("rng", F.ceil(F.col("count") * blocks / F.col("total")).cast("int").alias("salts"))
    )
    hot = F.broadcast(hot)  # fewer than ``blocks`` rows: each has more than one part in ``blocks`` of all references
    salted = refs.join(hot, "rng", "left").withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_table"), F.coalesce("salts", F.lit(1))))
    packed = salted.groupBy("rng", "salt", "ref_table").agg(F.collect_list(F.struct("k", "w", "row_id")).alias("r")).select("rng", "salt", "ref_table", F.col("r.k").alias("r_k"), F.col("r.w").alias("r_w"), F.col("r.row_id").alias("r_id"))
    arrays = _ranges(known).join(hot, "rng", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)).cast("bigint") - 1))).drop("salts")
    met = packed.join(arrays, ["rng", "salt"], "left")
    return met.select("ref_table", "r_k", "r_w", "r_id", "p_k", "p_e", "p_g", "p_y").mapInArrow(_probe, OUT)


def report(found: DataFrame) -> DataFrame:
    """Orphans per referring table and year: the article's year where known, else that of the reference's time."""
    year = F.coalesce("parent_year", F.year("at"))
    return found.groupBy("ref_table", year.cast("int").alias("year")).agg(F.count("*").alias("orphans"), F.count_if(F.col("reason") == "missing").alias("missing"), F.count_if(F.col("reason") == "deleted").alias("deleted"), F.count_if(F.col("reason") == "later").alias("later"))
