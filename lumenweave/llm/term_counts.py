"""Frequency of every distinct term, kept up to date by signed deltas."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.functions.text import term
from lumenweave.operators.unpack import values
from lumenweave.session import written

#: Pairs of term and article that a partition of the kept state should have; partitions are so many at least and at most.
PAIRS_EACH, LEAST_BUCKETS, MOST_BUCKETS = 200_000, 32, 8192
RARE, COMMON = 2, 20
KEYS = ["field_name", "term"]
MEMBERS = "field_name string, term string, article bigint, n bigint, d bigint, bucket int"
COUNTS = "field_name string, term string, occurrences bigint, articles bigint, bucket int"


def records(df: DataFrame, article: str, fields: dict[str, list[str]], change: int = 1) -> DataFrame:
    """Term occurrences of added (``change`` 1) or removed (-1) records: field_name, term, article, change.

    ``fields`` maps each label column to its dictionary. A record without values gives none; a record whose article is null
    counts as an occurrence of no article. One more row with a null field stands for the record's article itself.
    """
    one = [F.struct(F.lit(f).alias("f"), values(F.col(f"`{f}`"), known).alias("v")) for f, known in fields.items()]
    cut = df.select(F.col(article).alias("article"), F.array(*one).alias("cells"))
    said = cut.select("article", F.explode("cells").alias("c")).select("article", F.col("c.f").alias("field_name"), F.explode("c.v").alias("raw"))
    terms = said.select("field_name", term(F.col("raw")).alias("term"), "article", F.lit(change).cast("bigint").alias("change"))
    whole = df.where(F.col(article).isNotNull()).select(F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("term"), F.col(article).alias("article"), F.lit(change).cast("bigint").alias("change"))
    return terms.where("term <> ''").union(whole)


class TermCounts:
    """Persistent counts of terms under ``path``, in hash partitions of (field, term).

    Two stores: ``counts`` has the occurrences and articles of each term, ``members`` which articles have it how often, so that a change
    tells whether an article comes or goes. ``apply`` aggregates signed changes (partial before the shuffle, so that a hot term is no
    burden), adds them to the touched partitions of ``members``, and what that changes to those of ``counts``; only these are written
    anew, under the next version. The number of partitions is set by the first delta (``buckets`` sets it too); rows that stand for
    articles are dealt by article. A version is valid once its manifest is there, so a lost job leaves the last version whole; the
    manifest lists the deltas too, and one that was applied is not applied again. Only positive sums are articles. Terms that no record
    has any more vanish. ``vacuum`` removes what newer versions replaced.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.state: dict = {"version": 0, "buckets": buckets or 0, "homes": {}, "deltas": []}
        done = self._manifests()
        if done:
            stream = self._fs().open(self._path(f"manifest-{max(done)}.json"))
            try:
                self.state = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()

    @property
    def version(self) -> int:
        return self.state["version"]

    def _path(self, name: str = ""):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):  # noqa: ANN202
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        if not self._fs().exists(self._path()):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path())]
        return [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]

    def _seal(self) -> None:
        """Writes the manifest beside its place and moves it there in one step."""
        out = self._fs().create(self._path("manifest.tmp"), True)
        out.write(bytearray(json.dumps(self.state), "utf-8"))
        out.close()
        self._fs().rename(self._path("manifest.tmp"), self._path(f"manifest-{self.version}.json"))

    def _read(self, store: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """Kept rows of these partitions, or of all."""
        by_version: dict[int, list[int]] = {}
        for b, v in self.state["homes"].items():
            if buckets is None or int(b) in buckets:
                by_version.setdefault(v, []).append(int(b))
        out = self.spark.createDataFrame([], schema)
        for v, own in by_version.items():
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.path}/v{v}/{store}").where(F.col("bucket").isin(own)))
        return out

    def apply(self, changes: DataFrame, delta: str) -> TermCounts:
        """Merges signed changes (field_name, term, article, change) named ``delta``, unless a delta of that name was merged before."""
        if delta in self.state["deltas"]:
            return self
        staged = written(changes.groupBy(*KEYS, "article").agg(F.sum("change").alias("d")).where("d <> 0"), "term-delta")
        rows = staged.count()
        if not rows:
            self.state = self.state | {"version": self.version + 1, "deltas": [*self.state["deltas"], delta]}
            self._seal()
            return self
        buckets = self.state["buckets"] or min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(rows / PAIRS_EACH)))
        home = F.pmod(F.when(F.col("field_name").isNull(), F.xxhash64("article")).otherwise(F.xxhash64(*KEYS)), F.lit(buckets)).cast("int")
        fresh = staged.withColumn("bucket", home)
        touched = sorted(r[0] for r in fresh.select("bucket").distinct().collect())  # at most ``buckets`` rows
        at = f"{self.path}/v{self.version + 1}"
        new = fresh.select(*KEYS, "article", F.col("d").alias("n"), "d", "bucket")
        old = self._read("members", MEMBERS, touched).where("n <> 0").select(*KEYS, "article", "n", F.lit(0).cast("bigint").alias("d"), "bucket")
        both = new if not self.state["homes"] else old.union(new).groupBy(*KEYS, "article", "bucket").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where("n <> 0 or d <> 0")
        both.select(*KEYS, "article", "n", "d", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/members")
        moved = self.spark.read.schema(MEMBERS).parquet(f"{at}/members").where("d <> 0")
        come = (F.col("n") > 0).cast("bigint") - (F.col("n") - F.col("d") > 0).cast("bigint")
        change = moved.groupBy(*KEYS, "bucket").agg(F.sum("d").alias("occurrences"), F.coalesce(F.sum(F.when(F.col("article").isNotNull(), come)), F.lit(0)).alias("articles"))
        kept = self._read("counts", COUNTS, touched).select(*KEYS, "bucket", "occurrences", "articles")
        sums = kept.union(change).groupBy(*KEYS, "bucket").agg(F.sum("occurrences").alias("occurrences"), F.sum("articles").alias("articles")).where("occurrences <> 0 or articles <> 0")
        sums.select(*KEYS, "occurrences", "articles", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/counts")
        homes = self.state["homes"] | {str(b): self.version + 1 for b in touched}
        self.state = {"version": self.version + 1, "buckets": buckets, "homes": homes, "deltas": [*self.state["deltas"], delta]}
        self._seal()
        return self

    def vacuum(self) -> None:
        """Removes manifests before the last, and partitions that no longer belong to the state. Readers of older versions must have ended."""
        fs, live = self._fs(), {(v, int(b)) for b, v in self.state["homes"].items()}
        for v in self._manifests():
            if v < self.version:
                fs.delete(self._path(f"manifest-{v}.json"), False)
        for v in range(1, self.version + 1):
            for store in ("members", "counts"):
                folder = self._path(f"v{v}/{store}")
                for s in fs.listStatus(folder) if fs.exists(folder) else []:
                    name = s.getPath().getName()
                    if name.startswith("bucket=") and (v, int(name[7:])) not in live:
                        fs.delete(s.getPath(), True)

    def counts(self, rare: int = RARE, common: int = COMMON) -> DataFrame:
        """field_name, term, occurrences, articles, mark, read from the kept counts alone.

        ``rare``: at most that many articles (0 for terms of records that refer to none); ``common``: more than one in that
        many of all distinct articles; null otherwise. Occurrences count each value, records loaded again included.
        """
        kept = self._read("counts", COUNTS)
        total = kept.where("field_name is null").agg(F.coalesce(F.sum("articles"), F.lit(0)).alias("total"))
        mark = F.when(F.col("articles") <= rare, "rare").when(F.col("articles") * common > F.col("total"), "common")
        return kept.where("field_name is not null").crossJoin(F.broadcast(total)).select(*KEYS, "occurrences", "articles", mark.alias("mark"))  # one row
