"""Entity linking: dictionaries, nearest neighbours and near strings."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a block; a block of queries meets a block of the base in one matrix product.
BLOCK = 2048


def dictionary_lookup(mentions: DataFrame, term: str, names: DataFrame) -> DataFrame:
    """Canonical names of each mention (``names``: variant, canonical), all of them if several; the mention itself if none."""
    key = F.lower(F.trim(F.col(term)))
    return mentions.withColumn("__k", key).join(names.select(F.lower(F.trim("variant")).alias("__k"), "canonical").distinct(), "__k", "left").withColumn("canonical", F.coalesce("canonical", "__k")).drop("__k")


def _blocks(df: DataFrame, row_id: str, vector: str, names: tuple[str, str]) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), BLOCK):
                part = b.iloc[a : a + BLOCK]
                yield pd.DataFrame({names[0]: [part["i"].tolist()], names[1]: [np.concatenate(part["v"].to_list()).astype(np.float64)]})

    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(row_id).alias("i"), F.col(vector).alias("v"))
    return rows.mapInPandas(pack, f"{names[0]} array<bigint>, {names[1]} array<double>")


def nearest(queries: DataFrame, base: DataFrame, row_id: str, vector: str, k: int, same: bool = False) -> DataFrame:
    """The k nearest base rows of each query by Euclidean distance, exactly: query_id, base_id, distance, rank.

    A stated query set against all rows, in blocks of ``BLOCK``: each pair of blocks is one matrix product that yields k rows a
    query at most; the best k of all blocks are kept. Ties go to the lesser id. A row is no neighbour of itself unless ``same``.
    """

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qv, bi, bv in zip(b["qi"], b["qv"], b["bi"], b["bv"]):
                q, x = np.asarray(qv).reshape(len(qi), -1), np.asarray(bv).reshape(len(bi), -1)
                d2 = np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0)
                ids = np.asarray(bi)
                out = []
                for r, query in enumerate(qi):
                    row = d2[r] if same else np.where(ids == query, np.inf, d2[r])
                    top = np.flatnonzero(row <= np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1] + 1e-9)
                    exact = np.sqrt(((x[top] - q[r]) ** 2).sum(1))
                    keep = np.lexsort((ids[top], exact))[:k]
                    out += [(query, int(ids[top[j]]), float(exact[j])) for j in keep if np.isfinite(row[top[j]])]
                yield pd.DataFrame(out, columns=["query_id", "base_id", "distance"])

    pairs = _blocks(queries, row_id, vector, ("qi", "qv")).crossJoin(_blocks(base, row_id, vector, ("bi", "bv")))
    found = pairs.mapInPandas(meet, "query_id bigint, base_id bigint, distance double")
    best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "base_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", "x.base_id", "x.distance", (F.col("p") + 1).alias("rank"))


def similarity(a: Column, b: Column) -> Column:
    """Levenshtein similarity in [0, 1]."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _sharing(left: DataFrame, right: DataFrame, edits: float, longer: float) -> DataFrame:
    """Pairs of different tables' names (a, b) that may be near: all pairs within the bounds, and others.

    ``edits``: the most edits to any partner, as a share of the name's length; below one. ``longer``: the most that the longer
    name may be of the shorter. Cut into e + 1 parts, one of them stands whole in any partner; so parts are the join key.
    """

    def parts(n: str) -> Column:
        e = F.floor(F.length(n) * edits + 1e-9).cast("int")  # the product may fall just short of a whole number
        begin = lambda i: F.floor(i * F.length(n) / (e + 1))
        return F.transform(F.sequence(F.lit(0), e), lambda i: F.struct(F.substring(F.col(n), (begin(i) + 1).cast("int"), (begin(i + 1) - begin(i)).cast("int")).alias("p"), (begin(i + 1) - begin(i)).cast("int").alias("w")))

    a = left.select(F.col("name").alias("a")).where("a is not null and a <> ''").distinct()
    b = right.select(F.col("name").alias("b")).where("b is not null and b <> ''").distinct()
    short = a.select("a", F.explode(parts("a")).alias("x")).select("a", F.col("x.p").alias("p"), F.col("x.w").alias("w")).where("w > 0").distinct()
    widths = short.select("w").distinct().agg(F.array_sort(F.collect_set("w")).alias("ws"))  # as many as there are part lengths
    grams = F.flatten(F.transform("ws", lambda w: F.when(F.length("b") >= w, F.transform(F.sequence(F.lit(1), F.length("b") - w + 1), lambda i: F.substring(F.col("b"), i, w))).otherwise(F.array().cast("array<string>"))))
    probe = b.crossJoin(F.broadcast(widths)).select("b", F.explode(F.array_distinct(grams)).alias("p"))  # one row
    return short.join(probe, "p").where(F.greatest(F.length("a"), F.length("b")) <= longer * F.least(F.length("a"), F.length("b")) + 1e-9).select("a", "b").distinct()


def near_strings(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Best ``right.name`` for each ``left.name`` with at least that similarity, ties by name: name, match, score.

    No pair of that similarity is lost: its lengths differ by a factor of ``1 / least`` at most, and its edits are at most
    ``1 - least`` of the longer. ``least`` must be above one half.
    """
    pairs = _sharing(left, right, (1 - least) / least, 1 / least)
    scored = pairs.withColumn("score", similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    return scored.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m")).select(F.col("a").alias("name"), F.col("m.b").alias("match"), (-F.col("m.s")).alias("score"))


def near_blocks(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Every best ``right.name`` for each ``left.name`` by the matching-blocks ratio, at least ``least``: name, match, ratio. Ties stay.

    Blocks are a common subsequence, so a pair of that ratio needs ``(1 - least)`` of both lengths together as insertions and
    deletions at most, and no more replacements; and its lengths differ by a factor of ``2 / least - 1`` at most. No pair is
    lost. ``least`` must be above two thirds.
    """
    both = F.length("a") + F.length("b")
    pairs = _sharing(left, right, 2 * (1 - least) / least, 2 / least - 1)
    near = pairs.where(F.levenshtein("a", "b") <= (1 - least) * both + 1e-9)
    scored = near.withColumn("ratio", ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)
    best = scored.groupBy("a").agg(F.max("ratio").alias("ratio"), F.collect_list(F.struct("ratio", "b")).alias("all"))
    return best.select(F.col("a").alias("name"), F.explode(F.filter("all", lambda x: x["ratio"] == F.col("ratio"))["b"]).alias("match"), "ratio")


def ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two texts."""

    @F.pandas_udf("double")
    def blocks(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else SequenceMatcher(None, u, v).ratio() for u, v in zip(x, y)], dtype="float64")

    return blocks(a, b)
