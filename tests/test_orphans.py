import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenweave.functions.text import article, label, term
from lumenweave.operators.orphans import orphans, parents, report

T0 = datetime(2020, 1, 1)


def brute(refs, meta):
    out = set()
    for table, row, key, at in refs:
        if key is None:
            continue
        own = [m for m in meta if m[0] == key]
        if not own:
            out.add((table, row, "missing"))
            continue
        last = max((m[1], bool(m[2])) for m in own)
        if last[1]:
            out.add((table, row, "deleted"))
        elif at is not None and min(m[1] for m in own) > at:
            out.add((table, row, "later"))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    meta = [(rnd.choice([7, rnd.randrange(1, 20000)]), T0 + timedelta(days=rnd.randrange(400)), rnd.choice([None, False, False, True])) for _ in range(800)]
    refs = [(rnd.choice("ab"), i, rnd.choice([None, 7, rnd.choice(meta)[0], rnd.randrange(1, 20000), -5]), rnd.choice([None, T0 + timedelta(days=rnd.randrange(400))])) for i in range(1500)]
    m = spark.createDataFrame([(k, t, d, 2000) for k, t, d in meta], "key bigint, at timestamp, gone boolean, year int")
    r = spark.createDataFrame(refs, "ref_table string, row_id bigint, key bigint, at timestamp")
    got = orphans(r, parents(m, "key", "at", "gone", "year"))
    assert {(x.ref_table, x.row_id, x.reason) for x in got.collect()} == brute(refs, meta)
    assert got.count() == len(brute(refs, meta))
    assert report(got).agg(F.sum("orphans")).first()[0] == len(brute(refs, meta))


def test_empty_tables(spark):
    m = spark.createDataFrame([], "key bigint, at timestamp, gone boolean")
    r = spark.createDataFrame([("a", 1, 5, T0), ("a", 2, None, T0)], "ref_table string, row_id bigint, key bigint, at timestamp")
    assert [(x.row_id, x.reason) for x in orphans(r, parents(m, "key", "at", "gone")).collect()] == [(1, "missing")]
    assert orphans(r.limit(0), parents(m, "key", "at", "gone")).count() == 0


def test_article_numbers(spark):
    said = ["8147128", " 8147128\t", "08147128.0", "PMID: 8147128", "pmid 8147128", "8,147,128", "８１４７１２８", "8.147128e6", "\xa08147128 ", "nan", "n/a", "", " ", None, "abc", "1" * 30, "0" + "1" * 30]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").coalesce(1).orderBy("i").select(article(F.col("x"))).collect()]
    assert got[:9] == [8147128] * 9 and got[9:15] == [None] * 6 and got[15] == got[16] < 0


def test_terms(spark):
    r = spark.createDataFrame([(" A\xa0 b ",), ("NaN",), ("-1",), (None,)], "x string").select(term(F.col("x")).alias("t"), label(F.col("x")).alias("l")).collect()
    assert [x.t for x in r] == ["a b", "nan", "-1", None] and [x.l for x in r] == ["a b", None, None, None]
