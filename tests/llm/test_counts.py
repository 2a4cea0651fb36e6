import random
from collections import defaultdict

from pyspark.sql import functions as F

from lumenweave.llm.cooccurrence import associations, pair_records
from lumenweave.llm.term_counts import TermCounts, records
from lumenweave.session import fresh_path

KNOWN = {"a": ["x, type 1", "y"], "b": ["x, type 1"]}


def brute(rows):
    occ, arts, every = defaultdict(int), defaultdict(set), set()
    for art, a, b in rows:
        if art is not None:
            every.add(art)
        for f, cell in (("a", a), ("b", b)):
            for v in (cell or "").split("|"):
                t = " ".join(v.lower().split())
                if t and cell.strip() not in ("nan", "-1", ""):
                    occ[f, t] += 1
                    if art is not None:
                        arts[f, t].add(art)
    out = {}
    for k, n in occ.items():
        m = len(arts[k])
        out[k] = (n, m, "rare" if m <= 2 else "common" if m * 20 > len(every) else None)
    return out


def test_deltas_equal_a_full_count(spark):
    rnd = random.Random(2)
    cell = lambda: rnd.choice([None, "", "nan", "-1", "x, Type 1", "y|x,  type 1", "z|y", f"t{rnd.randrange(30)}|hot", "hot"])
    rows = [(rnd.choice([None, rnd.randrange(40)]), cell(), cell()) for _ in range(400)]
    df = lambda rs: spark.createDataFrame(rs, "article bigint, a string, b string").withColumn("term", F.lit("clash"))
    start = lambda **k: TermCounts(spark, fresh_path(spark, "t"), **k)
    whole = start().apply(records(df(rows), "article", KNOWN), "all")
    read = lambda c: {(r.field_name, r.term): (r.occurrences, r.articles, r.mark) for r in c.counts().collect()}
    assert read(whole) == brute(rows)
    steps = start(buckets=5)
    second = records(df(rows[150:]), "article", KNOWN).union(records(df(rows[:50]), "article", KNOWN, -1))
    steps.apply(records(df(rows[:150]), "article", KNOWN), "one").apply(second, "two")
    assert read(steps) == brute(rows[50:])
    assert steps.apply(second, "two").version == 2 and read(steps) == brute(rows[50:])
    again = TermCounts(spark, steps.path)
    again.vacuum()
    assert again.version == steps.version and read(again) == brute(rows[50:])
    again.apply(records(df(rows[50:]), "article", KNOWN, -1), "three")
    assert read(again) == {}
    assert read(again.apply(records(df(rows).limit(0), "article", KNOWN), "four")) == {}


def test_a_small_delta_rewrites_its_terms_alone(spark):
    many = spark.range(5000).select(F.col("id").alias("article"), F.concat(F.lit("t"), F.col("id") % 900).alias("a"), F.lit(None).cast("string").alias("b"))
    kept = TermCounts(spark, fresh_path(spark, "t"), buckets=400).apply(records(many, "article", KNOWN), "base")
    few = spark.range(150).select((F.col("id") % 3).alias("article"), F.concat(F.lit("t"), F.col("id") % 4).alias("a"), F.lit(None).cast("string").alias("b"))
    kept.apply(records(few, "article", KNOWN), "few")
    assert sum(v == 2 for v in kept.state["homes"].values()) <= 4 + 3  # four terms and three articles


def test_negative_sums_are_no_articles(spark):
    change = [("a", "x", 1, -1), ("a", "x", 2, 1), ("a", "x", 3, 1), ("a", "x", 4, 1)]
    df = spark.createDataFrame(change, "field_name string, term string, article bigint, change bigint")
    kept = TermCounts(spark, fresh_path(spark, "t")).apply(df, "one")
    assert [(r.occurrences, r.articles) for r in kept.counts().collect()] == [(2, 3)]
    assert [(r.occurrences, r.articles) for r in kept.apply(df.where("article = 1").withColumn("change", -2 * F.col("change")), "two").counts().collect()] == [(4, 4)]


def test_empty(spark):
    df = spark.createDataFrame([], "article bigint, a string, b string")
    assert TermCounts(spark, fresh_path(spark, "t")).apply(records(df, "article", KNOWN), "none").counts().count() == 0


def test_pairs(spark):
    rows = [(1, None, "D1", "d1 ", 5), (1, None, "d1", "D1", 5), (2, "dis <> drug", None, "dis", 3), (2, None, "d1", "d1", None), (3, "dis <> drug", "drug", None, 4), (3, None, "d1", "dis", 0)]
    df = spark.createDataFrame(rows, "batch_id int, k string, u string, d string, n int").withColumn("item", F.lit(1))
    one = pair_records(df, "batch_id", "k", "u", "d", "n")
    got = {(r.item, r.other): (r.n, r.u, r.d, r.t) for r in associations(one, "batch", "drug", "disease", "n").collect()}
    assert got == {("d1", "d1"): (5, 5, 5, 12), ("drug", "dis"): (7, 7, 7, 12), ("d1", "dis"): (0, 5, 7, 12)}
    llr = {(r.item, r.other): r.llr for r in associations(one, "batch", "drug", "disease", "n").collect()}
    assert llr["drug", "dis"] > 10 and llr["d1", "d1"] > 10
    assert associations(one.limit(0), "batch", "drug", "disease", "n").count() == 0


def test_hot_item(spark):
    df = spark.range(3000).select(F.lit("hot").alias("a"), F.concat(F.lit("n"), F.col("id") % 700).alias("b"), F.lit(1).cast("bigint").alias("n"), (F.col("id") % 300).alias("r"))
    r = associations(df, "r", "a", "b", "n")
    assert r.count() == 700 and r.agg(F.sum("n"), F.max("u")).first()[:] == (3000, 3000)
